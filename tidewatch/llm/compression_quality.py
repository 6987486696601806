"""Compression classifier: zstandard dictionaries of good and bad texts.

Two dictionaries are trained on labelled texts, one for each label.  A text is
compressed in independent segments with either dictionary, and the difference
of the two sizes, divided by the larger, says which kind it resembles; the
division and the segments keep long and short texts on one scale.  A logistic
curve fitted on labelled texts that no dictionary has seen turns the
difference into a probability.  It also knows the smaller size as a share of
the text, for texts that repeat themselves are small under any dictionary.

Only the fit uses a sample: at most ``per_label`` labelled rows of either
label, picked by a hash of the key, of texts of at most ``fit_chars``
characters, so that what reaches the driver is bounded.  Every text is scored
whole, however long.  Nulls and empty texts get the share of good labels.
Keys with contradicting labels teach nothing, and of texts that share a key
the least one teaches; without labels of both kinds, or any rows, every score
is that share, or 0.5.  Repeated rows and ties score alike.  An empty table
gives an empty one.  Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

PER_LABEL = 2000
FIT_CHARS = 50_000
DICT_BYTES = 64 * 1024
SEGMENT = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def probability(self, x: tuple[float, ...]) -> float:
        z = self.weights[-1] + sum(w * v for w, v in zip(self.weights, x))
        return 1 / (1 + math.exp(-max(-35, min(35, z))))


def held_out(key: str) -> Column:
    """True for the third of the keys that the fit must not see."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Sizes:
    def __init__(self, model: Model):
        self.tools = []
        for raw in (model.good, model.bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.tools.append(
                zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def measure(self, text: str) -> tuple[float, float, float]:
        """The difference, over 0 if the good dictionary serves better; the share; its reciprocal."""
        raw = text.encode("utf-8", "surrogatepass")
        good, bad = (
            sum(len(tool.compress(raw[i : i + SEGMENT])) for i in range(0, len(raw), SEGMENT)) for tool in self.tools
        )
        share = min(good, bad) / len(raw)
        return (bad - good) / max(good, bad), share, min(1 / share, 50.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the offset by Newton steps, with a little ridge on standardised columns."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([0.1] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).sum() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def fit_texts(rows: list[tuple[str, int]], prior: float | None = None) -> Model:
    """A model from (text, label) rows; every second row of a label calibrates."""
    rows = [(t, int(q)) for t, q in rows if t]
    sides = {q: [t for t, k in rows if k == q] for q in (0, 1)}
    share = prior if prior is not None else (len(sides[1]) / len(rows) if rows else 0.5)
    learn = {q: [t.encode("utf-8", "surrogatepass") for t in ts[::2]] for q, ts in sides.items()}
    if min(map(len, sides.values())) < 4:
        return Model(b"", b"", (), share)
    dicts = {}
    for q, texts in learn.items():
        parts = [t[i : i + SEGMENT] for t in texts for i in range(0, len(t), SEGMENT)]
        try:
            dicts[q] = zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            dicts[q] = b"".join(parts)[-DICT_BYTES:]
    sizes = _Sizes(Model(dicts[1], dicts[0], (), share))
    x, y = [], []
    for q, texts in sides.items():
        for t in texts[1::2]:
            x.append(sizes.measure(t))
            y.append(q)
    w = _logistic(np.asarray(x), np.asarray(y, float))
    n1 = sum(y)
    base = math.log(max(share, 1e-3) / max(1 - share, 1e-3)) - math.log(max(n1, 1) / max(len(y) - n1, 1))
    return Model(dicts[1], dicts[0], (*w[:-1].tolist(), float(w[-1] + base)), share)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_label: int = PER_LABEL, fit_chars: int = FIT_CHARS
) -> Model:
    """Fit on at most per_label rows of each label, never on held-out keys."""
    known = labels.where(~held_out(key) & F.col("quality").isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r")
    share = known.agg(F.avg("q")).first()[0]
    order = F.xxhash64(F.col(key))
    pick = [known.where(F.col("q") == q).orderBy(order, key).limit(per_label).select(key, "q") for q in (0, 1)]
    rows = (
        docs.select(F.col(key), F.col(text).alias("_text"))
        .where(F.length("_text") <= fit_chars)
        .join(F.broadcast(pick[0].union(pick[1])), key)
        .groupBy(key)
        .agg(F.min("_text").alias("t"), F.min("q").alias("q"))
        .collect()
    )
    rows.sort(key=lambda r: r[key])
    return fit_texts([(r["t"], r["q"]) for r in rows], None if share is None else float(share))


def _rated(model, texts: list[str | None]) -> list[float]:
    sizes = _Sizes(model) if model.good else None
    return [model.probability(sizes.measure(t)) if t and sizes else model.prior for t in texts]


def _score(model, text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_rated(model.value, batch.column(text).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "_score") -> DataFrame:
    """docs with one more column; it must have a name that docs has not."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name!r}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(shared, text, name), schema)


def _keep(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([p >= 0.5 for p in _rated(model.value, batch.column(text).to_pylist())], pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that score 0.5 or more, with their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))
    return docs.mapInArrow(_keep(shared, text), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op2_compression_quality": query}
ORACLE: dict[str, str] = {}
