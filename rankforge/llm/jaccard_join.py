"""Exact self-join of word-shingle sets by Jaccard similarity, as a join in the metric space of Jaccard distance.

A set with more shingles of its own, which no other set has, than a similar set may lack is alone and leaves first. Pivots are then
drawn from all other sets, thinned to lie apart, and every set is measured to them. A set in the ball of a pivot belongs to the Voronoi
region of its nearest one; by the triangle inequality whatever is within distance r of it is at most r outside that ball and at most
2r farther from it than from its own nearest one, so boundary sets are copied to the regions within that window and no pair is lost.
Sets that no pivot is near meet in outer regions, which hold whatever rare shingles connect (sets that agree share one of their rarest
shingles). Regions are joined recursively: a small one in one task, pivot by pivot; a large one is divided by pivots of its own, at last in
blocks within rings of distance that are one r wide. Only what links don't connect yet is compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import CACHES, bounded_batches, materialise, own_worker, text_batches
from rankforge.llm.components import components

#: Sets and shingles of a region that one task joins; radius of a pivot's ball; levels of division and pivots a divided region.
LEAF_SETS, LEAF_SHINGLES, BALL, LEVELS, PIVOTS = 1024, 1_500_000, 0.7, 3, 8
#: Bounds of the first level: sets drawn as pivots, and their shingles, which are broadcast.
MOST_PIVOTS, PIVOT_SHINGLES = 2048, 1_500_000
#: A level of division that leaves more than this share of what the one before it left in large regions is the last one.
DIVIDES = 0.8
#: Rows of ids that may be broadcast; more are joined by a shuffle.
MOST_IDS = 200_000
#: Shingles are counted in a share of their hash range, so many times the share of shingles that similar sets may lack.
RATE = 1.6


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; A-Z lower-cased, words between ASCII white space.

    A text of fewer words than `width` is one shingle; none without words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(WORDS) > 150_000:
        WORDS.clear()
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out.view(np.int64))


CACHES.append(WORDS.clear)


def lacks(n: int, percent: int) -> int:
    """How many shingles of a set of n a similar one may lack."""
    return n - -(-n * percent // 100)


def counted(s: np.ndarray, percent: int) -> np.ndarray:
    """Whether shingles lie in the part of the hash range where they are counted."""
    return s.view(np.uint64) < np.uint64(min(2**64 - 1, int(RATE * (1 - percent / 100) * 2**64)))


def digest_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Arrow batches of few rows, for rows that hold sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few(rows: DataFrame) -> DataFrame:
    """Rows of ids, to be broadcast while there are few of them."""
    return F.broadcast(rows) if rows.count() <= MOST_IDS else rows


def as_sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in column]


def described_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, k, counted) of each document: size and digest of its set, 64 bits of the digest, and the shingles to be counted.

    Equal sets of a batch hold them once. 48 bits of a shingle are enough: two that fall together only make a set look less alone.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("jaccard")
        for b in batches:
            ids, texts, seen = b.column(0), b.column(1).to_pylist(), set()
            for part in text_batches(texts):
                n, digests, some = [], [], []
                for t in texts[part]:
                    s = shingle_set(t, width)
                    n.append(len(s))
                    digests.append(digest_of(s))
                    some.append(s[:0] if digests[-1] in seen else s[counted(s, percent)] >> 16)
                    seen.add(digests[-1])
                flat = pa.array(np.concatenate([np.empty(0, np.int64), *some]))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), flat)
                k = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(n)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(k), lists], names=["doc_id", "n", "digest", "k", "counted"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n long, digest binary, k long, counted array<long>")


def own_shingles(rows: DataFrame) -> DataFrame:
    """(k, own): how many of the shingles in rows (s, k) no other set k has."""
    once = rows.groupBy("s").agg(F.min("k").alias("k"), F.max("k").alias("last")).where("k = last")
    return once.groupBy("k").agg(F.count(F.lit(1)).alias("own"))


def not_alone(members: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The members (cid, n, ...) that don't have more shingles of their own among all members than a similar set may lack."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = as_sets(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets])), pa.array(np.repeat(b.column(0).to_numpy(), [len(s) for s in sets]))], names=["s", "k"])

    wanted = materialise(members.select("cid", "n").distinct(), "large-ids")
    with small_batches(placed.sparkSession):
        own = own_shingles(placed.join(few(wanted), "cid", "left_semi").select("cid", "set").mapInArrow(each, "s long, k long"))
        own = materialise(own.withColumnRenamed("k", "cid"), "own")
    alone = materialise(own.join(wanted, "cid").where(F.col("own") > may_lack(percent)).select("cid"), "alone")
    return members.join(few(alone), "cid", "left_anti")


def may_lack(percent: int):
    return F.expr(f"n - (n * {percent} + 99) div 100")


def similar(inter: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * union


class PivotIndex:
    """Distances from a set to all pivots that it shares a shingle with."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *sets])
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order].astype(np.int32)
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def measure(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivots, common shingles, sizes of the unions)."""
        if not len(self.keys) or not len(s):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        count = self.first[at + 1] - self.first[at]
        spread = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        p, inter = np.unique(self.owners[spread], return_counts=True)
        return p, inter, len(s) + self.sizes[p] - inter


def apart(ids: list[int], sets: list[np.ndarray], percent: int) -> PivotIndex:
    """Of the drawn sets those that lie outside the balls of the ones before them."""
    index, taken = PivotIndex(ids, sets), np.zeros(len(ids), bool)
    for i, s in enumerate(sets):
        p, inter, union = index.measure(s)
        taken[i] = not (taken[p] & (inter >= (1 - BALL) * union)).any()
    keep = np.nonzero(taken)[0]
    return PivotIndex([ids[i] for i in keep], [sets[i] for i in keep])


def cells_of(ids: np.ndarray, d: np.ndarray, percent: int) -> tuple[np.ndarray, bool]:
    """(which of the pivots' regions a set belongs to, whether it is an outer set), from its distances."""
    if not len(ids):
        return np.zeros(0, bool), True
    nearest, r = d.min(), 1 - percent / 100
    within = d <= min(BALL + r, nearest + 2 * r) + 1e-9
    return within, bool(nearest > BALL)


def place(docs: DataFrame, index: PivotIndex, width: int, percent: int) -> DataFrame:
    """(cid, n, set, outer, cells array<struct<g, d, linked>>) of each document: the regions it belongs to."""
    known = docs.sparkSession.sparkContext.broadcast(index)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("jaccard")
        index = known.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in text_batches(texts, 1_000_000):
                sets = [shingle_set(t, width) for t in texts[part]]
                outer, g, d, linked, size = [], [], [], [], [0]
                for s in sets:
                    p, inter, union = index.measure(s)
                    away = 1 - inter / np.maximum(union, 1)
                    within, out = cells_of(p, away, percent)
                    outer.append(out)
                    g.append(index.ids[p[within]])
                    d.append(away[within])
                    linked.append(similar(inter, union, percent)[within])
                    size.append(len(g[-1]))
                cell = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *g])), pa.array(np.concatenate([np.empty(0), *d])), pa.array(np.concatenate([np.empty(0, bool), *linked]))], names=["g", "d", "linked"])
                cells = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), cell)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(outer), cells], names=["cid", "n", "set", "outer", "cells"])

    return docs.select("doc_id", "text").mapInArrow(each, "cid long, n long, set binary, outer boolean, cells array<struct<g: long, d: double, linked: boolean>>")


def outer_groups(placed: DataFrame, percent: int) -> DataFrame:
    """(cid, g): outer sets, grouped by whatever shared shingles of their prefixes connect; sets that share none are alone.

    The common order of shingles is: those in the counted part of the hash range by the number of outer sets that have them, then the
    others by hash. A prefix holds one shingle more than a similar set may lack.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shingles, late, spare = [], [], []
            for s in as_sets(b.column(1)):
                first, more = s[counted(s, percent)], lacks(len(s), percent) + 1
                rest = s[~counted(s, percent)][: max(0, more - len(first))]
                shingles.append(np.concatenate([first, rest]))
                late.append(np.repeat([False, True], [len(first), len(rest)]))
                spare.append(more - len(shingles[-1]))
            k = [len(x) for x in shingles]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(np.concatenate(shingles)), pa.array(np.concatenate(late)), pa.array(np.repeat(spare, k).astype(np.int64))], names=["cid", "s", "late", "spare"])

    rows = placed.where("outer").select("cid", "set").mapInArrow(each, "cid long, s long, late boolean, spare long")
    with small_batches(placed.sparkSession):
        often = materialise(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-shingles")
        shared = rows.join(few(often), "s").groupBy("cid").agg(F.first("spare").alias("spare"), F.sort_array(F.collect_list(F.struct("late", "df", "s"))).alias("x"))
        prefix = shared.select("cid", F.explode(F.slice("x", 1, F.greatest(F.lit(0), F.col("spare") + F.size("x")).cast("int"))).alias("x")).select("cid", "x.s")
        prefix = materialise(prefix, "prefixes")
    owners = prefix.groupBy("s").agg(F.min("cid").alias("owner"), F.count(F.lit(1)).alias("k")).where("k > 1").select("s", "owner")
    edges = prefix.join(few(materialise(owners, "owners")), "s").where("cid <> owner").select(F.col("cid").alias("a"), F.col("owner").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("cid"), F.xxhash64("component", F.lit("outer")).alias("g"))


def region_links(cid: np.ndarray, part: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs of a region connect, sets of one part being connected already.

    Only pairs with a set that asks count. Sets that share too few shingles with all others leave at once. Then one set after the other is
    the pivot and is measured to all others, those of small parts first, until all that are left belong to one part.
    """
    n = np.array([len(s) for s in sets])
    least = -(-n * percent // 100)
    owner, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    alive = np.ones(len(sets), bool)
    for _ in range(4):
        shared = (times > 1)[column] & alive[owner]
        now = alive & (np.bincount(owner[shared], minlength=len(sets)) >= least)
        if (now == alive).all():
            break
        alive = now
        times = np.bincount(column[alive[owner]], minlength=len(times))
    here = alive[owner] & (times > 1)[column]
    owner, column = owner[here], column[here]
    start = np.searchsorted(owner, np.arange(len(sets) + 1))
    label = np.unique(part, return_inverse=True)[1]
    out, left = [], alive.copy()
    while True:
        ready = np.nonzero(left & asks)[0]
        labels = np.bincount(label[left], minlength=1) if left.any() else np.zeros(1, int)
        if not len(ready) or (labels > 0).sum() < 2:
            return out
        p = ready[labels[label[ready]].argmin()]
        mark = np.zeros(len(times), bool)
        mark[column[start[p] : start[p + 1]]] = True
        inter = np.bincount(owner, mark[column], len(sets)).astype(np.int64)
        found = np.nonzero(left & similar(inter, n + n[p] - inter, percent) & (label != label[p]))[0]
        _, one = np.unique(label[found], return_index=True)
        for x in found[one]:
            out.append((int(cid[p]), int(cid[x])))
            label[label == label[x]] = label[p]
        left[p] = False


def join_regions(members: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within regions (g, cid, part, asks) that one task can hold."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cid", "ascending"), ("asks", "descending")])
        cid = table.column("cid").to_numpy()
        first = np.append(True, cid[1:] != cid[:-1])
        table, cid = table.filter(pa.array(first)), cid[first]
        links = region_links(cid, table.column("part").to_numpy(), table.column("asks").to_numpy(), as_sets(table.column("set")), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    rows = placed.select("cid", "set").join(few(materialise(members.select("g", "cid", "part", "asks"), "leaves")), "cid")
    return rows.groupBy("g").applyInArrow(join, "a long, b long")


def measured(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(g, cid, p, d, linked) of pairs (g, cid, p), the pivots p being few a region."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, p = as_sets(b.column(3)), as_sets(b.column(4))
            inter = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, p, strict=True)], np.int64)
            union = np.array([len(s) + len(t) for s, t in zip(x, p, strict=True)], np.int64) - inter
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(1 - inter / np.maximum(union, 1)), pa.array(similar(inter, union, percent))], names=["g", "cid", "p", "d", "linked"])

    pairs = materialise(pairs, "pairs")
    pivots = placed.join(few(pairs.select(F.col("p").alias("cid")).distinct()), "cid", "left_semi").select(F.col("cid").alias("p"), F.col("set").alias("pivot_set"))
    pivots = materialise(pivots, "pivot-sets")
    near = F.broadcast(pivots) if pivots.agg(F.sum(F.length("pivot_set"))).first()[0] <= 8 * PIVOT_SHINGLES else pivots
    both = placed.select("cid", "set").join(few(pairs), "cid").join(near, "p").select("g", "cid", "p", "set", "pivot_set")
    with small_batches(placed.sparkSession):
        return materialise(both.mapInArrow(measure, "g long, cid long, p long, d double, linked boolean"), "distances")


def divide(large: DataFrame, placed: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """(links to pivots, members (g, cid, n, d) of the regions within large ones). large: g, cid, n, part, asks.

    Pivots are drawn from sets outside the largest part of their region; those near another one open no region of their own.
    """
    drawn = [F.min_by("cid", F.xxhash64("cid", F.lit(100 * level + i))) for i in range(PIVOTS)]
    pivots = materialise(large.where("asks").groupBy("g").agg(F.array_distinct(F.array(*drawn)).alias("p")).select("g", F.explode("p").alias("p")), "pivots")
    near = measured(large.select("g", "cid").join(few(pivots), "g"), placed, percent)
    close = near.join(few(pivots.select("g", F.col("p").alias("cid"))), ["g", "cid"]).where((F.col("p") < F.col("cid")) & (F.col("d") <= BALL))
    heads = pivots.join(close.select("g", F.col("cid").alias("p")).distinct(), ["g", "p"], "left_anti")
    r = 1 - percent / 100
    kept = materialise(near.join(few(heads), ["g", "p"]), "heads")
    least = kept.groupBy("g", "cid").agg(F.min("d").alias("least"))
    cells = kept.join(least, ["g", "cid"]).where((F.col("d") <= F.col("least") + 2 * r + 1e-9) & (F.col("d") <= BALL + r + 1e-9))
    inner = cells.select(F.xxhash64("g", "p", F.lit(level)).alias("g"), "cid", "d")
    outer = least.where(F.col("least") > BALL).select(F.xxhash64("g", F.lit(f"outer {level}")).alias("g"), "cid", F.lit(0.0).alias("d"))
    return near.where("linked and cid <> p").select(F.col("cid").alias("a"), F.col("p").alias("b")), inner.union(outer)


def blocks(large: DataFrame, percent: int) -> DataFrame:
    """(g, cid, part, asks): what asks in a region against all of it, in blocks within rings of the distance to its pivot."""
    ring = 1 - percent / 100 + 1e-9
    x = large.withColumn("r", F.floor(F.col("d") / ring).cast("int"))

    def pieces(count, size):
        return F.greatest(F.ceil(2 * count / LEAF_SETS), F.ceil(2 * size / LEAF_SHINGLES), F.lit(1)).cast("long")

    asked = x.where("asks").groupBy("g", "r").agg(pieces(F.count(F.lit(1)), F.sum("n")).alias("bi"))
    near = x.withColumn("r", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)))
    rings = materialise(near.groupBy("g", "r").agg(pieces(F.count(F.lit(1)), F.sum("n")).alias("bj")).join(asked, ["g", "r"]), "rings")
    i, j = F.pmod(F.xxhash64("cid"), "bi"), F.pmod(F.xxhash64("cid", F.lit(1)), "bj")
    left = x.where("asks").join(few(rings), ["g", "r"]).select("g", "r", "cid", "part", "asks", i.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bj") - 1)).alias("j"))
    right = near.join(few(rings), ["g", "r"]).select("g", "r", "cid", "part", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bi") - 1)).alias("i"), j.alias("j"))
    return left.union(right).select(F.xxhash64("g", "r", "i", "j").alias("g"), "cid", "part", "asks")


def similar_links(docs: DataFrame, described: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): one class a distinct set (digest, cid, n), and links (a, b) between classes.

    The links connect whatever similar pairs of different sets connect; pairs that links connect already aren't compared.
    """
    spark = docs.sparkSession
    classes = described.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "k")).alias("c"))
    classes = materialise(classes.select("digest", F.col("c.doc_id").alias("cid"), "c.n", "c.k"), "classes")
    own = own_shingles(described.select(F.explode("counted").alias("s"), "k"))
    some = materialise(classes.join(own, "k", "left").where(F.coalesce("own", F.lit(0)) <= may_lack(percent)).select("cid", "n"), "candidates")
    if described.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        texts = docs
    else:
        texts = docs.join(few(some.select(F.col("cid").alias("doc_id"))), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    texts = texts.join(few(some.select(F.col("cid").alias("doc_id"))), "doc_id", "left_semi")
    index = draw_pivots(texts, some, width, percent)
    placed = materialise(place(texts, index, width, percent), "placed")
    # Counted in full, among those left, shingles tell more sets that are alone.
    near = materialise(not_alone(placed.select("cid", "n"), placed, percent).select("cid"), "near")
    near = placed.join(few(near), "cid", "left_semi")
    cells = near.select("cid", "n", F.explode("cells").alias("c")).select("c.g", "cid", "n", "c.d", "c.linked")
    links = materialise(cells.where("linked and cid <> g").select(F.col("cid").alias("a"), F.col("g").alias("b")), "links")
    outer = outer_groups(near, percent).join(some, "cid").select("g", "cid", "n", F.lit(0.0).alias("d"))
    members = materialise(cells.select("g", "cid", "n", "d").union(outer), "members")
    level, before = 0, float("inf")
    while True:
        of = components(links)
        small, large = by_size(with_parts(members, of))
        found = [join_regions(small, placed, percent)]
        count = large.count()
        if count:
            # What is alone among all sets of large regions needs no comparison; that may make regions small.
            small, large = by_size(not_alone(large, placed, percent))
            found.append(join_regions(small, placed, percent))
            count = large.count()
        divided = count and level < LEVELS and count <= DIVIDES * before
        if divided:
            more, members = divide(large, placed, percent, level)
            members = materialise(members.join(some, "cid").select("g", "cid", "n", "d"), "members")
            found.append(more)
        elif count:
            found.append(join_regions(blocks(large, percent), placed, percent))
        links = materialise(reduce(DataFrame.union, [links, *found]), "links")
        if not divided:
            return classes, links
        level, before = level + 1, count


def draw_pivots(texts: DataFrame, some: DataFrame, width: int, percent: int) -> PivotIndex:
    """Pivots of the first level: a bounded draw from all sets, thinned."""
    ids = some.orderBy(F.xxhash64("cid", F.lit(3)), "cid").limit(MOST_PIVOTS).toPandas()
    ids = ids[(ids["n"].cumsum() - ids["n"]) < PIVOT_SHINGLES]
    wanted = texts.sparkSession.createDataFrame([(int(i),) for i in ids["cid"]], "doc_id long")
    # At most MOST_PIVOTS texts, of at most PIVOT_SHINGLES shingles but for the last one.
    rows = texts.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id", "text").collect()
    known = {r.doc_id: r.text for r in rows}
    order = [int(i) for i in ids["cid"] if int(i) in known]
    return apart(order, [shingle_set(known[i], width) for i in order], percent)


def with_parts(members: DataFrame, of: DataFrame) -> DataFrame:
    """Members (g, cid, n, d) of regions with `part`, their component (of: node, component) of the links so far."""
    of = of.select(F.col("node").alias("cid"), "component")
    return materialise(members.join(few(of), "cid", "left").select("g", "cid", "n", "d", F.coalesce("component", "cid").alias("part")), "parts")


def by_size(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of regions that one task holds, members of larger ones), with `asks`: whether a set is outside the largest part of its region.

    Regions within one part are left out. live: g, cid, n, d, part.
    """
    sizes = live.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"), (F.min("part") < F.max("part")).alias("apart")).where("apart")
    parts = live.groupBy("g", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.max_by("part", F.struct("m", "part")).alias("most"))
    sizes = materialise(sizes.join(parts, "g").select("g", "most", ((F.col("k") <= LEAF_SETS) & (F.col("size") <= LEAF_SHINGLES)).alias("small")), "sizes")
    live = live.join(few(sizes), "g").withColumn("asks", F.col("part") != F.col("most"))
    return live.where("small").drop("small", "most"), materialise(live.where("not small").drop("small", "most"), "large")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its shingle set and the smallest doc_id that links reach.

    docs: doc_id, text; other columns are ignored. Null and empty texts and texts without words have no shingles and are alone.
    Rows with a null doc_id join the component of an equal set, if it has one, and are null otherwise. Repeated rows stay; an id
    names one text (of rows that give it several, any may stand for it). Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialise(described_sets(docs, width, percent), "described")
    classes, links = similar_links(docs, described, width, percent)
    reach = components(links)
    by_digest = materialise(classes.select("digest", "cid").join(few(reach), F.col("cid") == F.col("node"), "left").select("digest", F.coalesce("component", "cid").alias("component")), "by-digest")
    out = described.select("doc_id", "n", "digest").join(few(by_digest), "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with all its columns, of each component: the smallest doc_id of it, a null one only if there is no other.

    Rows are keyed one by one, so rows with a null doc_id and repeated rows are compared as all others are. Rows without words are
    alone; of those that have one doc_id (or none) and one text, one stays.
    """
    bounded_batches(docs.sparkSession)
    # A name that no column of the caller has, in any spelling.
    row = "_row" + "_" * max(map(len, docs.columns))
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-rows")
    parts = jaccard_components(keyed.select(F.col(row).alias("doc_id"), "text"), width, percent).withColumnRenamed("doc_id", row)
    blank = F.when(~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("text"))
    named = keyed.select(row, F.col("doc_id").alias("_id"), blank.alias("_blank")).join(parts, row)
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")), *[F.when(F.col("n_shingles") == 0, F.col(c)) for c in ("_id", "_blank")]]
    first = F.min(F.struct(F.col("_id").isNull(), "_id", row)).getField(row)
    keep = materialise(named.groupBy(*[g.alias(f"_g{i}") for i, g in enumerate(group)]).agg(first.alias(row)).select(row), "kept-rows")
    # What goes is less than what stays, as a rule.
    gone = materialise(keyed.select(row).join(keep, row, "left_anti"), "gone-rows")
    return keyed.join(few(gone), row, "left_anti").select(*docs.columns)
