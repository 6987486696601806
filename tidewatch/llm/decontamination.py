"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts are compared lower-cased, with every run of non-word characters as one
space.  An item of n characters may differ by k = floor(rate * n) edits.  Cut
into k + 1 pieces, a passage within k edits holds one piece unchanged, so an
Aho-Corasick pass over each whole document finds every candidate place, and
Myers' bit-parallel distance decides there.  It does so from the piece upward
in a binary tree of pieces: if the whole has at most k errors, then from some
unchanged piece up to the whole every part of j pieces has at most j - 1, so a
chance hit dies on a short part.  Nothing within the budget is missed and
nothing beyond it reported.

An item too short for one error must stand as whole words: "tiny" is not in
"destiny".

Documents are never shuffled, and each is searched whole, however long.  Items
are handled in blocks of about ``block_chars`` characters, each small enough to
broadcast; each block is one more pass over the documents.  Null, empty and
wordless items match nothing; null and empty texts hold nothing.  Items with
equal texts are all reported, null ids as null; repeated documents are all
reported.  Of ties the first best match counts.  Keys may be null and of any
type.  No documents give no rows, no items keep all documents.  Further columns
stay (``clean``) or are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_schema, read_table

RATE = 0.1
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def budget(n: int, rate: float) -> int:
    return math.floor(rate * n)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces, of equal length but for one character."""
    n = len(text)
    cut = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:])]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of text, and where that part ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diag | up))
        minus = up & diag
        if plus & high:
            now += 1
        elif minus & high:
            now -= 1
            if now < best:
                best, end = now, j
        plus = plus << 1 & full
        up = (minus << 1 & full) | (full & ~(diag | plus))
        down = plus & diag
    return best, end


def tree(cut: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each piece between cuts, its enclosing parts (begin, end, errors), smallest first."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in cut[:-1]]

    def split(low: int, high: int) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            split(low, middle)
            split(middle, high)
            for i in range(low, high):
                out[i].append((cut[low], cut[high], high - low - 1))

    split(0, len(cut) - 1)
    return out


class Matcher:
    """All items of one block, compiled."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.auto = ahocorasick.Automaton()
        places: dict[str, list[tuple]] = {}
        self.texts: list[tuple[list[int], str, int]] = []
        groups: dict[str, list[int | None]] = {}
        for item, raw in items:
            if text := normalise(raw):
                groups.setdefault(text, []).append(item)
        for n, (text, ids) in enumerate(groups.items()):
            k = budget(len(text), rate)
            text = text if k else f" {text} "
            self.texts.append((ids, text, k))
            parts = pieces(text, k)
            above = tree([at for at, _ in parts] + [len(text)])
            for (at, piece), parents in zip(parts, above):
                places.setdefault(piece, []).append((n, at, parents))
        for piece, where in places.items():
            self.auto.add_word(piece, (len(piece), where))
        if places:
            self.auto.make_automaton()
        self.bits: dict[tuple, dict[str, int]] = {}

    def _distance(self, n: int, begin: int, end: int, text: str) -> tuple[int, int]:
        key = (n, begin, end)
        if key not in self.bits:
            self.bits[key] = pattern_bits(self.texts[n][1][begin:end])
        return best_match(self.bits[key], end - begin, text)

    def find(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item, edits, end in the normalised text) of each item the text holds."""
        text = normalise(raw)
        if not text or not self.texts:
            return []
        text, size = f" {text} ", len(text)
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, list[int]] = {}
        for end, (size, where) in self.auto.iter(text):
            for n, at, parents in where:
                start, k = end + 1 - size - at, self.texts[n][2]
                if n in best and (not best[n][0] or any(abs(start - x) <= k for x in seen[n])):
                    continue
                for a, b, errors in parents:
                    low = max(0, start + a - errors)
                    if self._distance(n, a, b, text[low : start + b + errors])[0] > errors:
                        break
                else:
                    low, m = max(0, start - 2 * k), len(self.texts[n][1])
                    edits, stop = self._distance(n, 0, m, text[low : start + m + 2 * k])
                    best[n] = min(best.get(n, (m, 0)), (edits, low + stop))
                    seen.setdefault(n, []).append(start)
        return [(i, edits, min(stop - 1, size)) for n, (edits, stop) in best.items() for i in self.texts[n][0]]


_made: dict[str, Matcher] = {}


def _matcher(items, rate: float) -> Matcher:
    """Compiled once for each worker and block."""
    key = hashlib.sha256(repr((items.value, rate)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Matcher(items.value, rate)
    return _made[key]


def _report(items, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(items, rate)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                rows += [(k, *hit) for hit in m.find(t)]
            yield pa.record_batch(
                {
                    "key": pa.array([r[0] for r in rows], batch.schema.field("key").type),
                    "item_id": pa.array([r[1] for r in rows], pa.int64()),
                    "edits": pa.array([r[2] for r in rows], pa.int32()),
                    "match_end": pa.array([r[3] for r in rows], pa.int32()),
                }
            )

    return run


def _drop(items, rate: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(items, rate)
        for batch in batches:
            yield batch.filter(pa.array([not m.find(t) for t in batch.column(text).to_pylist()], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> list:
    """Broadcast item lists, each of bounded size."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    out = []
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out.append(benchmark.sparkSession.sparkContext.broadcast(rows))
    return out


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(key, item_id, edits, match_end) of each item that a document holds."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = keyed_schema(docs, key, "item_id long, edits int, match_end int")
    out = None
    for items in _blocks(benchmark, block_chars):
        part = own.mapInArrow(_report(items, rate), schema)
        out = part if out is None else out.union(part)
    return out.select(F.col("key").alias(key), "item_id", "edits", "match_end")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with their columns unchanged."""
    for items in _blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_drop(items, rate, text), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": query}
ORACLE: dict[str, str] = {}
