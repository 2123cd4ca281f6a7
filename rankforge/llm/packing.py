"""Packing by cutting-stock column generation.

Documents are cut at multiples of the sequence length; what remains of each has a length, counted in classes of `UNIT` tokens.
Only this histogram, of a fixed number of classes, reaches the driver. There a linear program over patterns (how many pieces of
each class fill a sequence) is solved by column generation: knapsack dynamic programming prices new patterns with the dual values.
Patterns are rounded down, the few pieces left over are packed best fit first, and documents, ranked within their class, are dealt
to the patterns by ranges of ranks, all of it in Spark. Short pieces, which would suffer from the rounding of lengths, are strung into
bundles first, and a bundle is one item of the program.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import bounded_batches, give_back, materialise, own_worker, piece_encoder, text_batches

END_ID, UNIT = 1, 8
#: Rows that one task ranks at once, roughly.
RANK_ROWS = 4000
#: Shares of a sequence: pieces up to 1/SHORT are bundled, a bundle is closed at 1/BUNDLE.
SHORT, BUNDLE = 32, 4
#: Encoded words that a worker holds where its table isn't lasting.
FEW_WORDS = 200_000


def cut_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", lasting: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids binary) of every piece: a document's ids and the end id, cut at multiples of `length`.

    Null texts are empty: one piece of the end id alone. Null ids and repeated rows stay as they are; other columns are ignored.
    A worker's table of encoded words is lasting, or it is smaller and goes as a task ends: that takes more time, but idle workers then
    leave their memory to the steps that follow. The rows are the same.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("packing")
        encoder = piece_encoder(tokenizer) if lasting else piece_encoder(tokenizer, FEW_WORDS)
        end, step = END_ID.to_bytes(4, "little"), 4 * length
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in text_batches(texts, 2_000_000):
                owner, start, ids, total = [], [], [], []
                for i, x in enumerate(encoder.encode(texts[part]), part.start):
                    x += end
                    for k in range(0, len(x), step):
                        owner.append(i)
                        start.append(k // 4)
                        ids.append(x[k : k + step])
                        total.append(len(x) // 4)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])
        if not lasting:
            encoder.forget()
            give_back()

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The pattern of the highest value, by dynamic programming over the filled capacity; pieces may repeat. sizes ascend."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for w in range(1, capacity + 1):
        n = fitting[w]
        best[w] = best[w - 1]
        if n:
            gain = best[w - sizes[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], took[w] = gain[k], k
    pattern, w = Counter(), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[int(took[w])] += 1
            w -= int(sizes[took[w]])
    return float(best[capacity]), pattern


def solve(demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} with how often each is used, so that every piece of `demand` ({class: pieces}) has a place.

    Revised simplex with column generation; it ends when the objective is within `gap` of the bound that the duals give.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], float)
    m = len(sizes)
    columns = [Counter({i: int(capacity // sizes[i])}) for i in range(m)]
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = inverse @ need
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(dual, 0), sizes, capacity)
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * (dual @ need) / value:
            break
        entering = np.zeros(m)
        for i, n in pattern.items():
            entering[i] = n
        step = inverse @ entering
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = pattern
        x -= ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left = need.astype(int)
    patterns: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-x):
        times = min([int(np.floor(x[k] + 1e-7)), *(left[i] // n for i, n in columns[k].items())])
        if times > 0:
            for i, n in columns[k].items():
                left[i] -= times * n
            patterns.append(({int(sizes[i]): n for i, n in columns[k].items()}, times))
    return patterns + [(dict(p), n) for p, n in Counter(map(tuple, best_fit({int(c): int(n) for c, n in zip(sizes, left, strict=True)}, capacity))).items()]


def best_fit(demand: dict[int, int], capacity: int) -> list[list[tuple[int, int]]]:
    """Best fit, the largest first, for what rounding leaves: no more pieces than the patterns of one basis hold."""
    room: dict[int, list[Counter]] = {}
    for size in sorted(demand, reverse=True):
        for _ in range(demand[size]):
            free = min((r for r, bins in room.items() if r >= size and bins), default=capacity)
            bin_ = room[free].pop() if room.get(free) else Counter()
            bin_[size] += 1
            room.setdefault(free - size, []).append(bin_)
    return [sorted(b.items()) for bins in room.values() for b in bins]


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...), so that no sequence holds more than `length` tokens.

    Sequences are numbered from 0 without gaps, pieces stand in them without gaps from 0. Pieces of equal length are
    interchangeable, so a hot length is split over buckets of rows and needs no task of its own. Rows with null ids and repeated rows
    are pieces as all others are. An empty table gives no rows.
    """
    capacity, spark = length // UNIT, pieces.sparkSession
    buckets = max(1, -(-pieces.count() // RANK_ROWS))
    ties = [F.col(c) for c in pieces.columns if c not in ("doc_id", "start", "ids")]
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    strung = Window.partitionBy("_bucket").orderBy("doc_id", "start", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    short = rows.where(F.col("length") <= length // SHORT).withColumn("_upto", F.sum("length").over(strung))
    short = materialise(short.withColumn("_bundle", F.floor((F.col("_upto") - F.col("length")) / (length // BUNDLE))), "short-pieces")
    bundles = short.groupBy("_bucket", "_bundle").agg(F.sum("length").alias("length"))
    items = rows.where(F.col("length") > length // SHORT).unionByName(bundles, allowMissingColumns=True)
    items = items.withColumn("_class", F.ceil(F.col("length") / UNIT).cast("int"))
    demand = {r["_class"]: r["count"] for r in items.groupBy("_class").count().collect()}
    deal, ranks, sequence = [], dict.fromkeys(demand, 0), 0
    for pattern, times in solve(demand, capacity):
        for slot, (c, n) in enumerate(sorted(pattern.items(), reverse=True)):
            deal.append((c, ranks[c], ranks[c] + n * times, sequence, times, slot))
            ranks[c] += n * times
        sequence += times
    assert ranks == demand, "every piece has a place"
    # At most one row a class and pattern, however many documents there are.
    table = spark.createDataFrame(deal, "_class int, _from long, _to long, _first long, _times long, _slot int")
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_class", "_bucket").orderBy("_bundle", "doc_id", "start", *ties)
    ranked = items.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["_class", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    dealt = ranked.join(F.broadcast(table), "_class").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    dealt = dealt.withColumn("sequence_id", F.col("_first") + (F.col("_rank") - F.col("_from")) % F.col("_times"))
    about = ["sequence_id", "_slot", "_rank"]
    alone = dealt.where("_bundle is null").select(*pieces.columns, *about, F.lit(0).cast("long").alias("_upto"))
    places = dealt.where("_bundle is not null").select("_bucket", "_bundle", *about)
    dealt = alone.unionByName(short.join(places, ["_bucket", "_bundle"]).select(*pieces.columns, *about, "_upto"))
    earlier = Window.partitionBy("sequence_id").orderBy("_slot", "_rank", "_upto").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, lasting: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, placements without them) of all documents; ids are written once, to the shared folder.

    Null texts are empty documents of the end id alone; rows with null ids and repeated rows are packed each, told apart by piece_id;
    other columns are ignored; an empty table gives no rows. lasting is that of cut_pieces.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, length, lasting=lasting).withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    return pieces, pack(pieces.select("piece_id", "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")), length)


def fill_sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids binary) of whole sequences, joined from pieces and their placements by piece_id.

    Pieces of null and repeated ids each keep their place; no pieces, no rows.
    """
    rows = placed.select("piece_id", "sequence_id", "offset").join(pieces.select("piece_id", "ids"), "piece_id")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.aggregate("_p", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids")).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
