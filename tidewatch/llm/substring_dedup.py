"""Substring dedup: remove every word inside a passage that recurs anywhere.

Passages are windows of ``width`` consecutive words, compared unchanged.  The
work is linear in the corpus:

1. Anchors.  In any ``width`` words the winnowing rule picks one of the
   shorter ``anchor``-word grams by content alone, so equal windows pick equal
   grams.  About one word in twelve begins such a gram; only these hashes are
   counted, for each shard of documents, and grams seen twice go back to the
   shards they stand in.
2. Confirmation.  Each shard hashes the windows that picked a recurring gram.
   Windows seen twice, in one shard or in several, are confirmed.
3. Automata.  Each shard is told which of its windows are confirmed and
   compiles the grams that they pick, over word codes, into its Aho-Corasick
   automaton.  All of its documents with a recurring gram stream through it.
   A hit is lined up with each passage that the gram comes from and compared
   word by word as far as both agree; the confirmed windows of a stretch of at
   least ``width`` words are removed.  A gram of more than ``fan`` passages
   picks the one to compare by the words of the window.

So every removal comes from an automaton, each document passes exactly one of
them, and an automaton holds no more than its shard of about ``shard_chars``
characters.  What a third of all documents share is one row a shard in every
shuffle.  Confirmation trusts 64-bit window hashes; all else compares words.

Nulls and empty texts have no words and keep the digest of nothing.  Texts
shorter than ``width`` words stay whole; long ones are handled whole.  Rows
that repeat a key and its text are documents of their own, so their windows
recur; they are worked on once.  Ties cannot change a result.  An empty table
gives an empty one.  Other columns of ``docs`` are not looked at, whatever
their names; keys may be null and of any type.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_hot, materialise, read_table
from .textnum import Words, blocks, signed

WIDTH = 35
ANCHOR = 12
SHARD_CHARS = 8_000_000
FAN = 16
LETTERS = 3
_CHUNK = 1 << 16


def picked(words: Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, start of the gram that each window picks, hash of that gram)."""
    at, h = words.windows(anchor)
    span = width - anchor + 1
    if len(at) < span:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    inside = np.flatnonzero(words.doc[at[: len(view)]] == words.doc[at[span - 1 :]])
    gram = np.empty(len(inside), np.int64)
    for i in range(0, len(inside), _CHUNK):
        part = inside[i : i + _CHUNK]
        gram[i : i + _CHUNK] = part + view[part].argmin(1)
    return at[inside], at[gram], h[gram]


def _sums(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first row of each distinct key, sums of n)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _emit_anchors(width: int, anchor: int):
    """(h, shard, n) of the picked grams, added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h, shard, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            at, n = _sums((h, shard), n)
            return pa.record_batch({"h": signed(h[at]), "shard": shard[at], "n": n})

        for batch in batches:
            texts = batch.column("text").to_pylist()
            shard, n = (np.asarray(batch.column(c)) for c in ("shard", "n"))
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                start, gram, h = picked(words, width, anchor)
                # The windows of one gram are neighbours: each place counts once.
                new = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.zeros(0, bool)
                doc = a + words.doc[start[new]]
                held.append((h[new], shard[doc], n[doc]))
            if sum(len(x[0]) for x in held) > 1 << 20:
                yield flush()
        if held:
            yield flush()

    return run


class _Shard:
    """Rows of one shard: numbers told to it, and its documents."""

    def __init__(self, number: int):
        self.number = number
        self.told: list[tuple[np.ndarray, np.ndarray]] = []
        self.ref: list[int] = []
        self.n: list[int] = []
        self.texts: list[str] = []

    def numbers(self, i: int) -> np.ndarray:
        return np.concatenate([t[i] for t in self.told]) if self.told else np.zeros(0, np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """Shards one after the other; rows come sorted by shard."""
    now: _Shard | None = None
    for batch in batches:
        number = np.asarray(batch.column("shard"))
        cut = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            if now is None or now.number != number[a]:
                if now is not None:
                    yield now
                now = _Shard(int(number[a]))
            part = batch.slice(a, b - a)
            ref, n = np.asarray(part.column("ref")), np.asarray(part.column("n"))
            doc = np.asarray(part.column("text").is_valid())
            if not doc.all():
                now.told.append((ref[~doc], n[~doc]))
            if doc.any():
                now.ref += ref[doc].tolist()
                now.n += n[doc].tolist()
                now.texts += part.column("text").filter(pa.array(doc)).to_pylist()
    if now is not None:
        yield now


def _emit_windows(width: int, anchor: int):
    """Of each shard: the documents with a recurring gram, and its distinct candidate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            known = np.sort(shard.numbers(0))
            ref, n = np.asarray(shard.ref, np.int64), np.asarray(shard.n, np.int64)
            held = []
            for a, b in blocks(shard.texts) if len(known) else ():
                words = Words(shard.texts[a:b])
                start, _, h = picked(words, width, anchor)
                at = np.minimum(np.searchsorted(known, signed(h)), len(known) - 1)
                start = start[known[at] == signed(h)]
                if not len(start):
                    continue
                every, w = words.windows(width)
                doc = words.doc[start]
                held.append((signed(w[np.searchsorted(every, start)]), a + doc, (start - words.first[doc]).astype(np.int32)))
                some = a + np.unique(doc)
                yield _rows(shard.number, ref[some], n[some], [shard.texts[i] for i in some])
            if held:
                w, doc, start = (np.concatenate(c) for c in zip(*held))
                at, many = _sums((w,), n[doc])
                for i in range(0, len(at), _CHUNK):
                    own = at[i : i + _CHUNK]
                    yield _rows(shard.number, w=w[own], many=many[i : i + _CHUNK], ref_of=ref[doc[own]], start=start[own])

    return run


_WINDOWS = "shard int, ref long, n long, text string, w array<long>, many array<long>, ref_of array<long>, start array<int>"


def _rows(shard: int, ref=None, n=None, texts=None, **arrays) -> pa.RecordBatch:
    """Documents of a shard, or one row of arrays."""
    size = 1 if texts is None else len(texts)
    kinds = {"w": pa.int64(), "many": pa.int64(), "ref_of": pa.int64(), "start": pa.int32()}
    return pa.record_batch(
        {
            "shard": pa.array([shard] * size, pa.int32()),
            "ref": pa.array([None] if ref is None else ref, pa.int64()),
            "n": pa.array([None] if n is None else n, pa.int64()),
            "text": pa.array([None] if texts is None else texts, pa.string()),
            **{
                k: pa.ListArray.from_arrays(pa.array([0, len(arrays[k])], pa.int32()), pa.array(arrays[k], kind))
                if k in arrays
                else pa.nulls(size, pa.list_(kind))
                for k, kind in kinds.items()
            },
        }
    )


def _code(hashes: np.ndarray) -> str:
    """``LETTERS`` code points a word, each of an alphabet of its own.

    Nodes of the automaton are searched from end to end, so alphabets are
    small; as they differ, a match begins where a word begins.
    """
    out = np.empty((len(hashes), LETTERS), "<u4")
    for i in range(LETTERS):
        out[:, i] = (hashes >> np.uint64(7 * i)) % np.uint64(128) + np.uint64(0x10000 + 128 * i)
    return out.tobytes().decode("utf-32-le")


class Located:
    """Words of a shard's documents, its passages and their automaton."""

    def __init__(self, texts: list[str], width: int, anchor: int, fan: int):
        self.width, self.anchor, self.fan = width, anchor, fan
        self.parts, base, firsts, counts = [], 0, [], []
        starts, grams = [], []
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            start, gram, _ = picked(words, width, anchor)
            self.parts.append((base, words))
            firsts.append(base + words.first)
            counts.append(words.counts)
            starts.append(base + start)
            grams.append(base + gram)
            base += len(words)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.first, self.counts = join(firsts), join(counts)
        self.hashes = np.concatenate([w.hashes for _, w in self.parts]) if self.parts else np.zeros(0, np.uint64)
        self.code = _code(self.hashes)
        self.bases = np.asarray([b for b, _ in self.parts])
        # The gram that the window at a start picks; -1 where no window starts.
        self.gram = np.full(base + 1, -1, np.int64)
        self.gram[join(starts)] = join(grams)
        self.known = np.zeros(base + 1, bool)

    def text(self, a: int, b: int) -> bytes:
        """The text from word a to word b of one document."""
        i = int(np.searchsorted(self.bases, a, "right")) - 1
        base, words = self.parts[i]
        return words.buf[words.starts[a - base] : words.ends[b - 1 - base]]

    def compile(self, starts: np.ndarray) -> None:
        """Patterns are the grams that the confirmed windows pick, with all places where they do."""
        self.known[starts] = True
        self.automaton = ahocorasick.Automaton()
        self.windows: dict[int, dict[int, int]] = {}
        places: dict[str, list[tuple[int, int, int]]] = {}
        grams = np.unique(self.gram[starts])
        doc = np.searchsorted(self.first, grams, "right") - 1
        bounds = zip(grams.tolist(), self.first[doc].tolist(), (self.first[doc] + self.counts[doc]).tolist())
        for place in bounds:
            g = place[0]
            places.setdefault(self.code[LETTERS * g : LETTERS * (g + self.anchor)], []).append(place)
        for code, own in places.items():
            self.automaton.add_word(code, own)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _agree(self, p: int, g: int, step: int, limit: int) -> int:
        """Words that agree from p and g on, forwards or backwards, up to a limit."""
        done, size = 0, 32
        while done < limit:
            k = min(size, limit - done)
            if step > 0:
                same = self.hashes[p + done : p + done + k] == self.hashes[g + done : g + done + k]
            else:
                same = (self.hashes[p - done - k : p - done] == self.hashes[g - done - k : g - done])[::-1]
            if not same.all():
                return done + int(np.argmin(same))
            done, size = done + k, size * 4
        return done

    def _mark(self, begin: int, end: int, source: int, found: np.ndarray, low: int) -> None:
        """Marks the confirmed starts of a stretch whose words are those at source."""
        size = end - begin - self.width + 1
        if begin != source:
            one, other = self.text(begin, end), self.text(source, source + end - begin)
            if one != other and one.split() != other.split():
                return
        found[begin - low : begin - low + size] |= self.known[source : source + size]

    def _few(self, p: int, place: tuple[int, int, int], low: int, high: int, reached: dict[int, int], found: np.ndarray) -> None:
        """Lines the document up with the passage around a gram's place; a stretch is compared once."""
        g, a, b = place
        if reached.get(p - g, -1) > p:
            return
        if p == g:
            left, right = p - low, high - p
        else:
            left = self._agree(p, g, -1, min(p - low, g - a))
            right = self._agree(p, g, 1, min(high - p, b - g))
        reached[p - g] = p + right
        if left + right >= self.width:
            self._mark(p - left, p + right, g - left, found, low)

    def _many(self, p: int, sources: list[tuple[int, int, int]], low: int, high: int, found: np.ndarray) -> None:
        """Picks the passage by the window's words; one look-up for each window of this gram."""
        key = sources[0][0]
        if key not in self.windows:
            self.windows[key] = {}
            for g, _, _ in sources:
                for s in range(max(0, g - self.width + self.anchor), g + 1):
                    if self.known[s] and self.gram[s] == g:
                        self.windows[key].setdefault(hash(self.hashes[s : s + self.width].tobytes()), s)
        for s in range(max(low, p - self.width + self.anchor), min(p, high - self.width) + 1):
            if self.gram[s] == p and not found[s - low]:
                source = self.windows[key].get(hash(self.hashes[s : s + self.width].tobytes()))
                if source is not None:
                    self._mark(s, s + self.width, source, found, low)

    def locate(self, doc: int) -> np.ndarray:
        """Mark of each word of a document that a passage covers."""
        low, n = int(self.first[doc]), int(self.counts[doc])
        found = np.zeros(n + 1, bool)
        if len(self.automaton) and n >= self.width:
            reached: dict[int, int] = {}
            for end, sources in self.automaton.iter(self.code[LETTERS * low : LETTERS * (low + n)]):
                p = low + (end + 1) // LETTERS - self.anchor
                if len(sources) > self.fan:
                    self._many(p, sources, low, low + n, found)
                else:
                    for place in sources:
                        self._few(p, place, low, low + n, reached, found)
        change = found.astype(np.int64)
        change[self.width :] -= found[: max(0, len(found) - self.width)]
        return np.cumsum(change)[:n] > 0


def _remove(width: int, anchor: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if not shard.told or not shard.texts:
                continue
            own = Located(shard.texts, width, anchor, fan)
            # A place is told as the document's ref and the window's start in it.
            ref = np.asarray(shard.ref)
            order = np.argsort(ref)
            doc = order[np.searchsorted(ref, shard.numbers(0), sorter=order)]
            own.compile(own.first[doc] + shard.numbers(1))
            gone_from, removed, kept = [], [], []
            for i, text in enumerate(shard.texts):
                gone = own.locate(i)
                if gone.any():
                    words = text.encode("utf-8", "surrogatepass").split()
                    gone_from.append(shard.ref[i])
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone)]).decode("utf-8", "surrogatepass"))
            yield pa.record_batch({"ref": pa.array(gone_from, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for t in batch.column("text").to_pylist():
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch(
            {
                **{name: batch.column(name) for name in batch.schema.names if name != "text"},
                "n_words": pa.array(n, pa.int64()),
                "whole_sha256": pa.array(sha, pa.string()),
            }
        )


def _seen_twice(rows: DataFrame, key: str, count: str) -> DataFrame:
    """Rows, at most one a shard and key, whose key stands more than once in all."""
    return rows.withColumn("_all", F.sum(count).over(W.partitionBy(key))).where("_all > 1").drop("_all")


def _dealt(told: DataFrame, docs: DataFrame) -> DataFrame:
    """What a shard is told, and its documents, shard by shard."""
    told = told.select("shard", "ref", "n", F.lit(None).cast("string").alias("text"))
    return told.unionByName(docs.select("shard", "ref", "n", "text")).repartition("shard").sortWithinPartitions("shard")


def removals(
    docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, shard_chars: int = SHARD_CHARS, fan: int = FAN
) -> DataFrame:
    """(ref, n_removed, kept) of the documents that lose words.

    ``docs`` has ref, n and text, one row a ref: a document that stands n times.
    ``kept`` is the text of the remaining words joined by one space.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("ref", F.lit(1)), F.lit(shards)).cast("int"))
    anchors = docs.mapInArrow(_emit_anchors(width, anchor), "h long, shard int, n long")
    anchors = anchors.groupBy("h", "shard").agg(F.sum("n").alias("n"))
    again = materialise(_seen_twice(anchors, "h", "n").select("shard", F.col("h").alias("ref"), "n"), "recurring")
    some = materialise(_dealt(again, docs).mapInArrow(_emit_windows(width, anchor), _WINDOWS), "candidates")
    discard(again)
    windows = some.where("w is not null").select("shard", F.explode(F.arrays_zip("w", "many", "ref_of", "start")).alias("x"))
    windows = windows.select("shard", "x.w", "x.many", F.col("x.ref_of").alias("ref"), F.col("x.start").cast("long").alias("n"))
    sure = materialise(_seen_twice(windows, "w", "many").select("shard", "ref", "n"), "confirmed")
    gone = _dealt(sure, some.where("text is not null")).mapInArrow(_remove(width, anchor, fan), "ref long, n_removed long, kept string")
    gone = materialise(gone, "removed")
    discard(some, sure)
    return gone


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256."""
    base = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("ref"), F.col(text).alias("text")
    )
    counted = materialise(base.where("text is not null").groupBy("ref").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    own = base.where("text is not null").select("ref", "text")
    if counted.isEmpty():
        once, hot = own.withColumn("n", F.lit(1).cast("long")), counted.select("ref")
    else:
        twice = own.join(counted, "ref", "left_semi").groupBy("ref").agg(F.max("text").alias("text")).join(counted, "ref")
        once = own.join(counted, "ref", "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(twice)
        hot = hot_keys(counted, "ref", counted.agg(F.sum("n")).first()[0])
    cut = removals(once, **how).select("ref", "n_removed", F.sha2(F.col("kept"), 256).alias("sha"))
    whole = base.mapInArrow(
        _whole, f"key {docs.schema[key].dataType.simpleString()}, ref long, n_words long, whole_sha256 string"
    )
    return join_hot(whole, cut, "ref", hot).select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "whole_sha256").alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_substring_dedup": query}

ORACLE = {
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT rid, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
r AS (
  SELECT rid, s FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM r),
k AS (SELECT rid, list(i) AS gone FROM c GROUP BY rid),
u AS (SELECT rid, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
j AS (
  SELECT u.rid, count(c.i) AS n_removed,
         string_agg(u.x, ' ' ORDER BY u.i) FILTER (c.i IS NULL) AS kept
  FROM u LEFT JOIN c ON c.rid = u.rid AND c.i = u.i GROUP BY u.rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(j.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(j.kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON j.rid = d.rid
"""
}
