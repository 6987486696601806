"""MinHash near-dedup with BagMinHash signatures of word 5-gram multisets.

A text is the multiset of its word shingles, lower-cased; similarity is the
weighted Jaccard index sum(min) / sum(max).  Each shingle runs Poisson
processes over its discretised weight: node k of a dyadic hierarchy covers the
weight levels 2**k .. 2**(k+1)-1 at rate 2**k, every point carries a level
inside the node and a slot, and counts only if the level does not exceed the
weight.  The points up to weight w are then one process of rate w shared by
all texts with that shingle, so slot minima agree with probability equal to
the weighted Jaccard index.  Points beyond a per-text horizon are never drawn,
so a text costs O(shingles + m log m), not O(shingles * m).

Candidates are texts that share a band.  Equal texts are one node throughout,
known by two 64-bit hashes.

1. Every text of a band is compared exactly with the least node of the band,
   its hub, each pair once however many bands share it.  That links copies of
   one original in time linear in their number.
2. Bands whose texts are not all linked by then are compared inside the band,
   bands of the same texts once: all pairs of different parts whose signatures
   do not rule it out; in bands of more than ``block`` texts only what stayed
   outside the largest part, in blocks, with all of the band.

Classes are the components of verified links only.  No pair is emitted but
verified links, and no partner is capped.  What the second step costs grows
with the texts of a band that are not near copies of its largest part.

Nulls and texts without a word are their own class.  Texts of one to four
words have one shingle, the whole text; long texts are shingled whole.  Rows
with a repeated key each keep their row; keys may be null and of any type that
has an order.  Among ties the least key names the class.  An empty table gives
an empty one.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, hot_keys, join_hot, materialise, read_table
from .textnum import Words, blocks, mix, signed, span_hash

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
BLOCK = 256
STAR = 512
#: So many bands at most meet a broadcast; the places of any other are no more than their share of all.
HOT_BANDS = 20_000
#: Draws of a node at once at most, which bounds the memory of a round.
_DRAWS = 64
_G = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD1B54A32D192ED03)


def shingles(texts: list[str | None], width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, shingle, weight), sorted by both; shingles are 44-bit hashes."""
    words = Words([t.lower() if t else t for t in texts])
    at, h = words.windows(width)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        first = words.first[short]
        doc = np.concatenate((doc, short))
        h = np.concatenate((h, span_hash(words.hashes, first, first + words.counts[short])))
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), weight


def bag_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m slot minima; rows of texts without items are infinite.

    Each draw gives a time by its upper 40 bits and a slot by its lower 24.  A
    text's horizon sinks to its latest slot minimum as soon as all slots are
    taken, as no later point can count.  Draws of a node are numbered, and
    times are summed in their order, so it does not matter how many are made
    at once: about as many as are still ahead.
    """
    total = np.bincount(doc, weight, n)
    least = np.full(n * m, np.inf)
    table = least.reshape(n, m)
    begin = np.where(total > 0, m * (math.log(m) + 4) / np.maximum(total, 1), 0)
    rows = np.arange(len(doc))
    while len(rows):
        horizon = np.minimum(begin, table.max(1))
        k, nodes = 0, rows
        while len(nodes):
            d, w = doc[nodes], weight[nodes]
            seed = mix(item[nodes] * _G + np.uint64(k + 1))
            time, drawn = np.zeros(len(nodes)), 0
            while len(d):
                end = horizon[d]
                many = int(min(max((end - time).mean() * (1 << k), 1), _DRAWS))
                r = mix(seed[:, None] + np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * _G)
                drawn += many
                gap = np.log(((r >> np.uint64(24)) + np.uint64(1)) * 2.0**-40) * (-1.0 / (1 << k))
                gap[:, 0] += time
                at_time = np.cumsum(gap, 1) if many > 1 else gap
                on = np.flatnonzero(at_time <= end[:, None])
                point, r = at_time.ravel()[on], r.ravel()[on]
                whose = on // many if many > 1 else on
                at = d[whose] * m + ((r & np.uint64((1 << 24) - 1)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
                if k:
                    low = (mix(r ^ _SLOT) & np.uint64((1 << k) - 1)).astype(np.int64) + (1 << k) <= w[whose]
                    at, point = at[low], point[low]
                np.minimum.at(least, at, point)
                if len(d) > n:
                    np.minimum(horizon, table.max(1), out=horizon)
                ahead = np.flatnonzero(at_time[:, -1] <= horizon[d])
                d, w, seed, time = d[ahead], w[ahead], seed[ahead], at_time[ahead, -1]
            k += 1
            nodes = nodes[weight[nodes] >= 1 << k]
        short = np.isinf(table).any(1) & (total > 0)
        begin *= 2
        rows = np.flatnonzero(short[doc])
    return table


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task: copies are signed once
        for batch in batches:
            node = np.asarray(batch.column("node"))
            new = [i for i, x in enumerate(node.tolist()) if not (x in seen or seen.add(x))]
            texts, node = batch.column("text").take(pa.array(new, pa.int64())).to_pylist(), node[new]
            for a, b in blocks(texts):
                n = b - a
                doc, item, weight = shingles(texts[a:b])
                least = bag_minhash(doc, item, weight, n, m)
                full = np.isfinite(least[:, 0])
                value = mix(least.astype(np.float32).view(np.uint32).astype(np.uint64) + _SLOT)
                band = np.zeros((n, bands), np.uint64)
                for i in range(rows):
                    band = mix(band * _G + value[:, i::rows] + np.arange(bands, dtype=np.uint64))
                code = (value >> np.uint64(48)).astype(np.uint16)
                ends = np.cumsum(np.where(full, bands, 0))
                yield pa.record_batch(
                    {
                        "node": pa.array(node[a:b], pa.int64()),
                        "bands": pa.ListArray.from_arrays(
                            np.append(0, ends).astype(np.int32), pa.array(signed(band[full].ravel()), pa.int64())
                        ),
                        "code": pa.array([c.tobytes() for c in code], pa.binary()),
                    }
                )

    return run


def _overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard index of two (sorted items, weights, total)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return both / (a[2] + b[2] - both)


def _bags(texts: list[str]) -> list[tuple]:
    """(sorted items, weights, total) of each text."""
    out = []
    for a, b in blocks(texts):
        doc, item, weight = shingles(texts[a:b])
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        for x, y in zip(cut, cut[1:]):
            out.append((item[x:y], weight[x:y], weight[x:y].sum()))
    return out


def _alike(a: tuple, b: tuple, similarity: float) -> bool:
    small, large = sorted((a[2], b[2]))
    return small >= similarity * large and _overlap(a, b) >= similarity


def _floor(similarity: float, slots: int) -> float:
    """Share of equal slots below which two texts cannot be alike, but for four standard deviations."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / slots)


def _star(similarity: float):
    """Links of each group's hub with its members; rows come sorted by group, the hub first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, hub, code, bag = None, 0, None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("gid", "side", "node", "code", "text")}
            own, out = [], []
            for i, g in enumerate(cols["gid"]):
                mine = np.frombuffer(cols["code"][i], np.uint16)
                if cols["side"][i] == 0:
                    gid, hub, code, bag = g, cols["node"][i], mine, _bags([cols["text"][i]])[0]
                elif g == gid and (mine == code).mean() >= _floor(similarity, len(code)):
                    own.append((cols["node"][i], hub, bag, cols["text"][i]))
            for (node, to, center, _), mine in zip(own, _bags([o[3] for o in own])):
                if _alike(mine, center, similarity):
                    out.append((to, node))
            yield _pairs(out)

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _links(nodes: list[int], sides: list[int], parts: list[int], codes: list[bytes], texts: list[str], similarity: float) -> list:
    """Verified links that join the parts of side 0 with those of side 1; side 2 is both."""
    code = np.frombuffer(b"".join(codes), np.uint16).reshape(len(nodes), -1)
    floor = _floor(similarity, code.shape[1])
    side, part = np.asarray(sides), np.asarray(parts)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    root: dict[int, int] = {p: p for p in parts}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = []
    for i in left:
        other = right[part[right] != part[i]]
        near = (code[other] == code[i]).mean(1)
        for j, x in zip(other[near >= floor], near[near >= floor]):
            if not (side[i] == 2 and side[j] == 2 and j <= i):
                pairs.append((-x, int(i), int(j)))
    if not pairs:
        return []
    pairs.sort()
    need = sorted({i for p in pairs for i in p[1:]})
    bags = dict(zip(need, _bags([texts[i] for i in need])))
    out = []
    for _, i, j in pairs:
        x, y = find(parts[i]), find(parts[j])
        if x != y and _alike(bags[i], bags[j], similarity):
            root[x] = y
            out.append((nodes[i], nodes[j]))
    return out


def _compare(similarity: float):
    """Verified links of each group of rows with one gid; rows come sorted by gid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ("gid", "node", "side", "part", "code", "text")}
        out: list = []

        def flush():
            if len(held["gid"]) > 1:
                out.extend(_links(*(held[c] for c in ("node", "side", "part", "code", "text")), similarity))
            for c in held.values():
                c.clear()

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in held}
            for i, gid in enumerate(cols["gid"]):
                if held["gid"] and held["gid"][0] != gid:
                    flush()
                for c in held:
                    held[c].append(cols[c][i])
            if out:
                yield _pairs(out)
                out.clear()
        flush()
        yield _pairs(out)

    return run


def _verified(rows: DataFrame, func, label: str) -> DataFrame:
    spread = rows.repartition("gid").sortWithinPartitions("gid", "side")
    return materialise(spread.mapInArrow(func, "a long, b long"), label)


def _blocked(bands: DataFrame, part: DataFrame, block: int, total: int) -> DataFrame:
    """(gid, side, node, part): what to compare inside bands of (band, node) that have several parts."""
    own = bands.join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_ = own.groupBy("band").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("part").alias("p"), F.max("part").alias("q")
    )
    open_ = materialise(open_.where("p <> q").groupBy("n", "low", "x").agg(F.min("band").alias("band")).select("band", "n"), "open-bands")
    hot = hot_keys(open_, "band", total, most=HOT_BANDS)
    own = materialise(join_hot(own, open_, "band", hot, "inner"), "open-places")
    pick = lambda df, gid, side: df.select(gid.alias("gid"), F.lit(side).alias("side"), "node", "part")
    small = pick(own.where(F.col("n") <= block), F.col("band"), 2)
    big = own.where(F.col("n") > block)
    main = big.groupBy("band", "part").agg(F.count("*").alias("m"))
    main = main.groupBy("band").agg(F.max_by("part", F.struct("m", "part")).alias("main"), (F.sum("m") - F.max("m")).alias("rest"))
    big = join_hot(big, materialise(main, "main-parts"), "band", hot, "inner").withColumns({"all": F.ceil(F.col("n") / block), "others": F.ceil(F.col("rest") / block)})
    # Each block of the others meets each block of the band.
    stray = big.where("part <> main").withColumn("i", F.pmod(F.xxhash64("node", F.lit(2)), F.col("others")))
    stray = stray.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)))
    each = big.withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("all")))
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    gid = F.xxhash64("band", F.col("i").cast("long"), F.col("j").cast("long"))
    return small.unionByName(pick(stray, gid, 0)).unionByName(pick(each, gid, 1))


def links(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, star: int = STAR
) -> DataFrame:
    """Verified links (a, b) that connect the near-duplicate classes; docs has node and text, a node as often as it likes."""
    sign = docs.mapInArrow(_sign(bands, rows), "node long, bands array<long>, code binary")
    sign = materialise(sign.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("code").alias("code")), "signatures")
    placed = sign.select(F.explode("bands").alias("band"), "node")
    shared = placed.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared, "bands")
    total = bands * sign.count()
    hot = hot_keys(shared, "band", total, most=HOT_BANDS)
    placed = materialise(join_hot(placed, shared.select("band", "low"), "band", hot, "inner"), "placed")
    near = materialise(placed.where("low <> node").select("low", "node").distinct(), "stars")
    if near.isEmpty():
        return near.select(F.col("low").alias("a"), F.col("node").alias("b"))
    # Equal texts become one row before they are dealt out; only candidates go on.
    some = near.select("node").union(near.select("low")).distinct()
    text = docs.groupBy("node").agg(F.max("text").alias("text")).join(some, "node").join(sign.select("node", "code"), "node")
    text = materialise(text, "texts")

    size = near.groupBy("low").agg(F.ceil(F.count("*") / star).alias("blocks"))
    hub = size.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = size.where("blocks > 1")
    member = near.join(many, "low", "left_anti").withColumn("i", F.lit(0).cast("long"))
    if not many.isEmpty():
        spread = near.join(F.broadcast(many), "low").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
        member = member.unionByName(spread)
    gid = F.xxhash64("low", "i")
    stars = hub.select(gid.alias("gid"), F.lit(0).alias("side"), F.col("low").alias("node"))
    stars = stars.unionByName(member.select(gid.alias("gid"), F.lit(1).alias("side"), "node"))
    found = _verified(stars.join(text, "node"), _star(similarity), "star-links")

    part = connected_components(found, "parts").select(F.col("id").alias("node"), F.col("component").alias("part"))
    rest = _verified(_blocked(placed.select("band", "node"), part, block, total).join(text, "node"), _compare(similarity), "band-links")
    discard(sign, shared, placed, near, text)
    return found.unionByName(rest)


def near_components(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """(id, component) of each text with a near copy; id is xxhash64 of the text."""
    wordy = docs.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(F.xxhash64(text).alias("node"), F.col(text).alias("text"))
    return connected_components(links(wordy, **how), "classes")


def _told(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """One row per row of docs: key, node (null without a word), root, class_id and class_size."""
    wordy = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    base = docs.select(
        F.col(key).alias("key"),
        F.when(wordy, F.xxhash64(text)).alias("node"),
        F.when(wordy, F.xxhash64(F.lit(7), F.col(text))).alias("second"),
        F.col(text).alias("text"),
    )
    counted = base.where("node is not null").groupBy("node", "second").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    counted = materialise(counted, "nodes")
    # Different texts with one first hash: all but one of them go by both hashes.
    clash = counted.groupBy("node").agg(F.min("second").alias("own"), F.count("*").alias("c")).where("c > 1").drop("c")
    if not (clash := materialise(clash, "clashes")).isEmpty():
        apart = lambda df: df.join(clash, "node", "left").withColumn(
            "node", F.when(F.col("second") == F.coalesce("own", "second"), F.col("node")).otherwise(F.xxhash64("node", "second"))
        ).drop("own")
        base, counted = apart(base), apart(counted)
    comp = connected_components(links(base.where("node is not null").select("node", "text"), **how), "classes")
    counted = counted.select("node", "least", "n").join(comp.withColumnRenamed("id", "node"), "node", "left")
    counted = materialise(counted.select("node", "least", "n", F.coalesce("component", "node").alias("root")), "rooted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    group = counted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    told = join_hot(counted.select("node", "root"), group, "root", hot_keys(group, "root", total, "class_size"))
    return join_hot(base.select("key", "node"), materialise(told, "told"), "node", hot_keys(counted, "node", total))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: key, class_id (least key of the class) and class_size."""
    return _told(docs, key, text, **how).select(
        F.col("key").alias(key),
        F.coalesce("class_id", "key").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs without all but the first key of each class; columns stay.

    Rows go by key and text, so other texts of a repeated key stay.  Of rows
    that repeat one key inside a class, one stays.  Rows without a key cannot
    be told apart and stay.
    """
    told = _told(docs, key, text, **how).where("class_size > 1 and key is not null")
    gone = told.where("key <> class_id").select("key", "node").distinct()
    again = told.where("key = class_id").groupBy("key", "root").agg(F.count("*").alias("n"), F.collect_set("node").alias("nodes")).where("n > 1")
    again = again.select("key", "root", F.explode("nodes").alias("node"))
    mark = lambda df, name: df.select(
        F.col("key").alias(f"_{name}_key"), F.col("node").alias(f"_{name}_node"), *[F.col(c).alias(f"_{name}_{c}") for c in df.columns[2:]]
    )
    own = F.xxhash64(docs[text])
    gone, again = mark(gone, "gone"), mark(again.select("key", "node", "root"), "again")
    kept = docs.join(gone, (docs[key] == gone["_gone_key"]) & (own == gone["_gone_node"]), "left_anti")
    same = (kept[key] == again["_again_key"]) & (F.xxhash64(kept[text]) == again["_again_node"])
    twice = kept.join(again, same).groupBy(key, "_again_root")
    rest = [c for c in docs.columns if c != key]
    once = twice.agg(F.min(F.struct(*rest)).alias("_once")).select(key, *[F.col(f"_once.`{c}`").alias(c) for c in rest])
    return kept.join(again, same, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_minhash_dedup": query}

ORACLE: dict[str, str] = {}
