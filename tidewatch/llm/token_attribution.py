"""Token counts by offset-mapped attribution.

A document is encoded once, whole.  A byte-level token's span follows from the
byte lengths of the tokens before it, so spans need no second decode; they are
joined to the document's sections by binary search.  A token that crosses a
boundary goes by ``rule``:

- ``start``: to the section that holds its first byte;
- ``majority``: to the section with most of its bytes, the first among equals;
- ``split``: to each in proportion to its bytes.

Tokens, or parts of them under ``split``, that no section covers are counted
under the section number -1, so that counts add up to the document's tokens.
Sections are sorted, disjoint character spans.  Null texts have no rows, nor
have empty ones; a long text is encoded whole, and repeated rows each have
their own rows.  Keys may be null and of any type.  An empty table gives an
empty one.  Other columns are not looked at, whatever their names.  The
vocabulary is read on the driver and broadcast: its size is that of a
tokenizer file.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_schema, read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting rule of byte-level BPE with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")


def read_vocabulary(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


class Encoder:
    def __init__(self, ranks: list[tuple[bytes, int]]):
        self.tool = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
        self.size = np.zeros(max(i for _, i in ranks) + 1, np.int64)
        for token, i in ranks:
            self.size[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset of the end of each token of the text."""
        return np.cumsum(self.size[np.asarray(self.tool.encode_ordinary(text), np.int64)])


def byte_offsets(raw: bytes, chars: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.append(lead, len(raw))[np.minimum(chars, len(lead))]


def allocate(ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section [begin, end), and those outside all sections."""
    n = len(begin)
    out, outside = np.zeros(n), 0.0
    if not len(ends):
        return out, outside
    if not n:
        return out, float(len(ends))
    starts = np.append(0, ends[:-1])
    at = np.searchsorted(begin, starts, "right") - 1
    inside = (at >= 0) & (starts < end[at])
    if rule == "start":
        np.add.at(out, at[inside], 1)
        return out, float((~inside).sum())
    plain = inside & (ends <= end[at])
    np.add.at(out, at[plain], 1)
    for a, b, i in zip(starts[~plain], ends[~plain], at[~plain]):
        i, shares, used = max(i, 0), [], 0
        while i < n and begin[i] < b:
            if (w := min(b, end[i]) - max(a, begin[i])) > 0:
                shares.append((i, w))
                used += w
            i += 1
        rest = b - a - used
        if rule == "split":
            for i, w in shares:
                out[i] += w / (b - a)
            outside += rest / (b - a)
        else:
            best = max(shares, key=lambda s: s[1], default=(-1, 0))
            if best[1] >= rest and best[1]:
                out[best[0]] += 1
            else:
                outside += 1
    return out, outside


_made: dict[int, Encoder] = {}


def encoder(ranks) -> Encoder:
    """Built once for each worker and vocabulary."""
    if ranks.id not in _made:
        _made.clear()
        _made[ranks.id] = Encoder(ranks.value)
    return _made[ranks.id]


class Shared:
    def __init__(self, spark: SparkSession, path: str):
        self.id, self.held = path, spark.sparkContext.broadcast(read_vocabulary(path))

    @property
    def value(self):
        return self.held.value


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of a text; a line break belongs to the line before it."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    cut = np.unique(np.concatenate(([0], breaks, [len(text)])))
    return cut[:-1], cut[1:]


def _count(ranks, rule: str, sections):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            keys, number, first, last, counts = [], [], [], [], []
            spans = zip(*(batch.column(c).to_pylist() for c in ("begin", "end"))) if sections is None else None
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                begin, end = next(spans) if spans else (None, None)
                if text is None:
                    continue
                if sections is not None:
                    begin, end = sections(text)
                raw = text.encode("utf-8", "surrogatepass")
                begin = np.asarray([] if begin is None else begin, np.int64)
                end = np.asarray([] if end is None else end, np.int64)
                got, outside = allocate(enc.ends(text), byte_offsets(raw, begin), byte_offsets(raw, end), rule)
                number += range(len(begin))
                first += begin.tolist()
                last += end.tolist()
                counts += got.tolist()
                if outside:
                    number.append(-1)
                    first.append(None)
                    last.append(None)
                    counts.append(outside)
                keys += [key] * (len(begin) + bool(outside))
            yield pa.record_batch(
                {
                    "key": pa.array(keys, batch.schema.field("key").type),
                    "section": pa.array(number, pa.int32()),
                    "begin": pa.array(first, pa.int64()),
                    "end": pa.array(last, pa.int64()),
                    "n_tokens": pa.array(counts, pa.float64()),
                }
            )

    return run


def attribute(
    docs: DataFrame,
    sections: Callable[[str], tuple[np.ndarray, np.ndarray]] | tuple[str, str] = line_sections,
    key: str = "doc_id",
    text: str = "text",
    rule: str = "majority",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(key, section, begin, end, n_tokens) of each section of each row.

    ``sections`` makes the begins and ends of a text's sections, or names two
    array<bigint> columns that hold them; both count characters.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    named = not callable(sections)
    own = docs.select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        *([F.col(sections[0]).alias("begin"), F.col(sections[1]).alias("end")] if named else []),
    )
    ranks = Shared(docs.sparkSession, vocabulary)
    schema = keyed_schema(docs, key, "section int, begin long, end long, n_tokens double")
    out = own.mapInArrow(_count(ranks, rule, None if named else sections), schema)
    return out.select(F.col("key").alias(key), "section", "begin", "end", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, by majority."""
    return attribute(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_token_attribution": query}
ORACLE: dict[str, str] = {}
