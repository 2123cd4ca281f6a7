"""Phrase collocation mining with pivot partitions, in two rounds.

Every phrase belongs to its rarest word, the pivot. In the first round each pair of neighbours goes to the partition of its rarer word and
is counted there. Hashed counters of runs of three words, of those that hold no rare pair, then tell which of these may be frequent. In the
second round each occurrence of a word that is frequent enough sends the fragment around it to that word's partition: the neighbours that
are more frequent, as far as a phrase can reach and no pair or run of three is rare. Phrases are counted there, locally, and only those
that the pivot owns: those that hold no rarer word, counted at the pivot's first occurrence in them. The fragments of hot pivots are dealt
to several partitions, and their counts are added up afterwards.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import bounded_batches, materialise, own_worker, text_batches

#: Characters that end a piece become a full stop, tabs a blank, small and capital letters one.
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"......... abcdefghijklmnopqrstuvwxyz")
#: Words whose places in the order of rarity are broadcast, at most, in all languages together.
MOST_WORDS = 200_000
#: Occurrences of a pivot that one partition gets, about.
PIVOT_ROWS = 200_000
#: Frequent pairs of neighbouring words are marked in two to that power bits (15 at least), frequent runs of three in as many.
SLOT_BITS = 27
#: Blocks that the counters of runs of three are added up in.
BLOCK_BITS = 10
#: Distinct words or fragments that a task holds before it sends them on.
HELD = 300_000
#: The mark of a word that the broadcast order lacks, and the first place behind all that it has.
UNKNOWN, BEHIND = -2, 1 << 40
#: Parts that the candidates of a language are dealt to before its best ones meet in one task.
SHARES = 32


def tokens(text: str) -> list[bytes]:
    """Words of a text in order, and b"." where a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(PIECES).replace(b".", b" . ").split()


def by_language(texts: DataFrame, column: str = "text") -> DataFrame:
    """(lang, text) with `und` for a null language and the empty text for a null one."""
    return texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(column, F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of every word of texts (lang, text); the row whose word is null counts all occurrences of the language."""

    def sent(held: dict[str, Counter]) -> pa.RecordBatch:
        langs, words, ns = [], [], []
        for lang, own in held.items():
            langs += [lang] * (len(own) + 1)
            words += [*own, None]
            ns += [*own.values(), own.total()]
        held.clear()
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "f"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations")
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, Counter())
                own.update(tokens(text))
                own.pop(b".", None)
            if sum(map(len, held.values())) > HELD:
                yield sent(held)
        if held:
            yield sent(held)

    each = texts.mapInArrow(count, "lang string, word string, f long")
    return each.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def rarity(words: DataFrame, most_words: int) -> tuple[dict[str, dict[bytes, int]], int | None]:
    """({lang: {word: f}} of the most frequent words, their least f): at most most_words of them; the least is None if words is all there.

    The least f is a power of two, so that one count of words by the size of f finds it.
    """
    words = words.where("word is not null")
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.floor(F.log2("f")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = None, sum(sizes.values())
    for size in sorted(sizes):
        if held <= most_words:
            break
        held -= sizes[size]
        least = 2 ** (size + 1)
    known: dict[str, dict[bytes, int]] = {}
    for r in words.where(F.col("f") >= (least or 0)).collect():
        known.setdefault(r["lang"], {})[r["word"].encode("utf-8", "surrogatepass")] = r["f"]
    return known, least


class Places:
    """The order of words by rarity that all tasks share. A word beyond the broadcast is rarer than all in it; such words are ordered by
    a checksum, as any order that all tasks share gives the same phrases."""

    def __init__(self, known: dict[str, dict[bytes, int]], least: int | None, pivot_rows: int):
        self.known, self.least, self.pivot_rows = known, least, pivot_rows
        self.orders: dict[str, dict[bytes, int]] = {}
        #: Words that languages before this one have, and words of all; one at least.
        sizes = [len(known[lang]) for lang in sorted(known)]
        self.before = dict(zip(sorted(known), np.cumsum([0, *sizes]).tolist(), strict=False))
        self.size = max(1, sum(sizes))

    def order(self, lang: str) -> dict[bytes, int]:
        if lang not in self.orders:
            own = self.known.get(lang, {})
            self.orders[lang] = {w: i for i, w in enumerate(sorted(own, key=lambda w: (-own[w], w)))} | {b".": -1}
        return self.orders[lang]

    def at(self, lang: str, toks: list[bytes]) -> np.ndarray:
        """The place of each token; -1 where a piece ends and for words that no phrase can hold."""
        missing = -1 if self.least is None else UNKNOWN
        out = np.fromiter(map(self.order(lang).get, toks, repeat(missing)), np.int64, len(toks))
        if missing == UNKNOWN:
            for i in np.flatnonzero(out == UNKNOWN).tolist():
                out[i] = BEHIND + zlib.crc32(toks[i])
        return out

    def parts(self, lang: str, pivot: bytes) -> int:
        """Partitions that a pivot's fragments are dealt to."""
        return 1 + self.known.get(lang, {}).get(pivot, self.least or 0) // self.pivot_rows


def joined_tokens(texts: list[str]) -> list[bytes]:
    toks: list[bytes] = []
    for text in texts:
        toks += tokens(text)
        toks.append(b".")
    return toks


def pairs(places: Places, lang: str, at: np.ndarray) -> np.ndarray:
    """A number for each place and the next one. Where the order has both words it tells the pivot, the other word and which comes first;
    else it is negative, and a checksum."""
    ids = at.view(np.uint64)
    out = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] + np.uint64(zlib.crc32(lang.encode()))) * np.uint64(0xBF58476D1CE4E5B9)
    hashed = ((out ^ (out >> np.uint64(29))) | np.uint64(1 << 63)).view(np.int64)
    first, second = at[:-1], at[1:]
    pivot, other = (np.maximum(first, second) + places.before.get(lang, 0), np.minimum(first, second) + places.before.get(lang, 0))
    return np.where((first < BEHIND) & (second < BEHIND), (pivot * places.size + other) * 2 + (first > second), hashed)


def slots(numbers: np.ndarray, bits: int) -> np.ndarray:
    """The slot, of two to the power of bits, of each number."""
    out = numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the slot of each number has its bit."""
    at = slots(numbers, (bits.size * 8).bit_length() - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def links(places: Places, bits: np.ndarray, lang: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a place and the next one are a pair that may be frequent; whether it and the next two hold only such pairs; a number for these)."""
    numbers = pairs(places, lang, at)
    linked = (at[:-1] >= 0) & (at[1:] >= 0) & marked(bits, numbers)
    ids = numbers.view(np.uint64)
    return linked, linked[:-1] & linked[1:], (ids[:-1] * np.uint64(0xD6E8FEB86659FD93) + ids[1:]).view(np.int64)


def cut_out(places: Places, bits: np.ndarray, lang: str, texts: list[str], reach: int, threes: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """(words before the pivot, words after it, fragment) of every pivot with a neighbour. Rare pairs end a fragment as rare words do.

    With the bits of runs of three, rare ones end a fragment too, also between the words before the pivot and those after it, and
    fragments of two words are left out where the order has the pivot: their pairs are counted already.
    """
    toks = joined_tokens(texts)
    n = len(toks)
    own = places.at(lang, toks)
    two, three, numbers = links(places, bits, lang, own)
    linked, run = np.zeros(n + 2 * reach, bool), np.ones(n + 2 * reach, bool)
    linked[reach : reach + n - 1] = two
    if threes is not None:
        run[reach : reach + n - 2] = three & marked(threes, numbers)
    at = np.full(n + 2 * reach, -1, np.int64)
    at[reach : n + reach] = own
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    open_left = open_right = own >= 0
    for d in range(1, reach + 1):
        # At the pivot's first occurrence: no equal word may stand before it.
        open_left = open_left & linked[reach - d : n + reach - d] & (at[reach - d : n + reach - d] < own)
        open_right = open_right & linked[reach + d - 1 : n + reach + d - 1] & (at[reach + d : n + reach + d] <= own)
        if d > 1:
            open_left, open_right = open_left & run[reach - d : n + reach - d], open_right & run[reach + d - 2 : n + reach + d - 2]
        left += open_left
        right += open_right
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    text = b" ".join(toks)
    nothing, fewest = np.zeros(n, np.int8), np.where((own < BEHIND) & (threes is not None), 2, 1)
    parted = (left > 0) & (right > 0) & ~run[reach - 1 : n + reach - 1]
    out: list[tuple[int, int, bytes]] = []
    for some, before, after in ((~parted, left, right), (parted, left, nothing), (parted, nothing, right)):
        pivots = np.flatnonzero(some & (before + after >= fewest))
        lefts, rights = before[pivots], after[pivots]
        cuts = zip(lefts.tolist(), rights.tolist(), starts[pivots - lefts].tolist(), (ends[pivots + rights] - 1).tolist(), strict=True)
        out += [(b, a, text[s:e]) for b, a, s, e in cuts]
    return out


def counted_pairs(texts: DataFrame, known: Broadcast, least: int) -> DataFrame:
    """(pivot, other, n) of pairs of neighbours that occur `least` times or more, counted in the partitions of their rarer words.

    A pivot's pairs hold more frequent words only, so there are few for frequent pivots and few occurrences for rare ones: no pivot is hot.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations")
        places, held = Places(*known.value), []

        def sent() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            told = found >= 0
            return pa.record_batch([pa.array(np.where(told, found // (2 * places.size), found)), pa.array(np.where(told, found % (2 * places.size), -1)), pa.array(n)], ["pivot", "other", "n"])

        for lang, some in language_parts(batches):
            at = places.at(lang, joined_tokens(some))
            held.append(pairs(places, lang, at)[(at[:-1] >= 0) & (at[1:] >= 0)])
            if sum(map(len, held)) > 8 * HELD:
                yield sent()
        if held:
            yield sent()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(count, "pivot long, other long, n long").repartition(parts, "pivot")
    return dealt.groupBy("pivot", "other").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_pairs(counted: DataFrame, known: Broadcast, slot_bits: int) -> np.ndarray:
    """A bit for each slot that a pair of counted (pivot, other, n) has; other pairs that share such a slot merely aren't sorted out yet.
    2^slot_bits bits, whatever the data."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = Places(*known.value).size
        for batch in batches:
            pivot, other = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            numbers = np.where(pivot >= 0, pivot * (2 * size) + other, pivot)
            yield pa.record_batch([pa.array(slots(numbers, slot_bits).view(np.int64))], ["slot"])

    slot = F.col("slot") + 1
    placed = counted.select("pivot", "other").mapInArrow(place, "slot long")
    blocks = placed.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (slot_bits - 3), np.uint8)
    for r in blocks.collect():
        size = len(r["bits"])
        out[(r["block"] - 1) * size : r["block"] * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_threes(texts: DataFrame, known: Broadcast, bits: Broadcast, least: int, slot_bits: int) -> np.ndarray:
    """A bit for each slot that runs of three words without a rare pair have `least` times or more together, so for every frequent run.

    Tasks send their counters by blocks of slots. Where many runs share slots fewer are sorted out, and nothing else changes.
    """
    inner = slot_bits - BLOCK_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations")
        places, held = Places(*known.value), []

        def sent() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            blocks, starts = np.unique(found >> np.uint64(inner), return_index=True)
            inside, n = (found & np.uint64((1 << inner) - 1)).astype("<u4"), np.minimum(n, least).astype("<u4")
            parts = [slice(s, e) for s, e in zip(starts, [*starts[1:], len(found)], strict=True)]
            return pa.record_batch([pa.array(blocks.astype(np.int32)), pa.array([inside[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())], ["block", "inside", "n"])

        for lang, some in language_parts(batches):
            _, three, numbers = links(places, bits.value, lang, places.at(lang, joined_tokens(some)))
            held.append(slots(numbers[three], slot_bits))
            if sum(map(len, held)) > 4 * HELD:
                yield sent()
        if any(map(len, held)):
            yield sent()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(1 << inner, np.int64)

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for k, inside, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != block:
                    if block is not None and (sums >= least).any():
                        yield told()
                    block = k
                    sums[:] = 0
                sums[np.frombuffer(inside, "<u4")] += np.frombuffer(n, "<u4")
        if block is not None and (sums >= least).any():
            yield told()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(count, "block int, inside binary, n binary").repartition(parts, "block").sortWithinPartitions("block")
    out = np.zeros(1 << (slot_bits - 3), np.uint8)
    for r in dealt.mapInArrow(add, "block int, bits binary").collect():
        size = len(r["bits"])
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def named_pairs(counted: DataFrame, known: Broadcast) -> DataFrame:
    """(lang, phrase, f) of the pairs of counted (pivot, other, n) of which the order has both words."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*known.value)
        langs = sorted(places.known)
        words = [w for lang in langs for w in list(places.order(lang))[: len(places.known[lang])]]
        of = [lang for lang in langs for _ in places.known[lang]]
        for batch in batches:
            pivots, others, ns = (c.to_pylist() for c in batch.columns)
            phrases = [words[p] + b" " + words[o >> 1] if o & 1 else words[o >> 1] + b" " + words[p] for p, o in zip(pivots, others, strict=True)]
            yield pa.record_batch([pa.array([of[p] for p in pivots], pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["lang", "phrase", "f"])

    return counted.where("pivot >= 0").select("pivot", "other", "n").mapInArrow(name, "lang string, phrase string, f long")


def language_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(lang, some texts) of batches (lang, text), of a bounded number of characters each."""
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            for part in text_batches(own):
                yield lang, own[part]


def fragments(texts: DataFrame, known: Broadcast, bits: Broadcast, threes: Broadcast, longest: int) -> DataFrame:
    """(lang, pivot, parts, paired, before, after, fragment, weight) of texts (lang, text); equal fragments of a task are one row mostly.
    paired: the order has the pivot, so all words, and phrases of two words are counted already."""

    def sent(places: Places, held: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, before, after, piece, n) for lang, own in held.items() for (before, after, piece), n in own.items()]
        held.clear()
        langs, befores, afters, pieces, weights = zip(*rows, strict=True)
        pivots = [p.split(b" ", b + 1)[b] for b, p in zip(befores, pieces, strict=True)]
        parts = [places.parts(lang, p) for lang, p in zip(langs, pivots, strict=True)]
        paired = [p in places.known.get(lang, {}) for lang, p in zip(langs, pivots, strict=True)]
        columns = [pa.array(langs, pa.string()), pa.array(pivots, pa.binary()).cast(pa.string()), pa.array(parts, pa.int32()), pa.array(paired, pa.bool_()), pa.array(befores, pa.int32()), pa.array(afters, pa.int32()), pa.array(pieces, pa.binary()).cast(pa.string()), pa.array(weights, pa.int64())]
        return pa.record_batch(columns, ["lang", "pivot", "parts", "paired", "before", "after", "fragment", "weight"])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("collocations")
        places = Places(*known.value)
        held: dict[str, Counter] = {}
        for lang, some in language_parts(batches):
            held.setdefault(lang, Counter()).update(cut_out(places, bits.value, lang, some, longest - 1, threes.value))
            if sum(map(len, held.values())) > HELD:
                yield sent(places, held)
        if any(held.values()):
            yield sent(places, held)

    return texts.mapInArrow(route, "lang string, pivot string, parts int, paired boolean, before int, after int, fragment string, weight long")


def words_of(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def phrases(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, f) of phrases of two words (three where paired) to longest, found least times or more.

    Counting stays in the partitions of the pivots, where equal fragments of all tasks become one before their phrases are cut out. What
    an undivided pivot counts is final, so rare phrases end there; the counts of divided pivots are added up in a second, small exchange.
    """
    n = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = routed.withColumn("share", F.pmod(F.xxhash64("fragment"), F.col("parts"))).repartition(n, "lang", "pivot", "share")
    once = dealt.groupBy("lang", "pivot", "share", "parts", "paired", "before", "after", "fragment").agg(F.sum("weight").alias("weight"))
    own = [
        F.when((F.col("before") >= i) & (F.col("after") >= j) & (F.lit(i + j > 1) | ~F.col("paired")), F.expr(f"substring_index(substring_index(fragment, ' ', before + {j + 1}), ' ', {-(i + j + 1)})"))
        for i in range(longest)
        for j in range(longest - i)
        if i + j
    ]
    each = once.select("lang", "pivot", "share", "parts", "weight", F.explode(F.array_compact(F.array(*own))).alias("phrase"))
    local = each.groupBy("lang", "pivot", "share", "parts", "phrase").agg(F.sum("weight").alias("f")).where((F.col("parts") > 1) | (F.col("f") >= least))
    return local.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each phrase of found (lang, phrase, f) at its lowest-scoring cut, the first of equal ones.

    words (lang, word, f) holds at least all words of found, and the null word with the size of the language.
    """
    size = words_of(F.col("phrase"))
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), size.alias("m"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - m)").alias("rest"))
    known = found.select("lang", "phrase", "f").union(words.where("word is not null").select("lang", F.col("word").alias("phrase"), "f"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words.where("word is null").select("lang", F.col("f").alias("n")), "lang")

    def whole(c: str) -> Column:
        return F.col(c).cast("decimal(38,0)")

    above = F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n")
    cuts = cuts.withColumn("above", above).withColumn("below", whole("l") * whole("r")).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def covered(found: DataFrame) -> DataFrame:
    """(lang, phrase, a) of each phrase of found that occurs no oftener than a longer one around it.

    If any longer phrase around it is as frequent, one that is longer by one word is.
    """
    parts = found.where(words_of(F.col("phrase")) > 2).select("lang", F.col("f").alias("a"), F.explode(F.array(F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))).alias("phrase"))
    return parts.select("lang", "phrase", "a").distinct()


def best(candidates: DataFrame, most: int) -> DataFrame:
    """candidates with rank: the first `most` of each language. Shares of a language are cut first, so no task sees all of it."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = candidates.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("share")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, most_words: int = MOST_WORDS, pivot_rows: int = PIVOT_ROWS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of docs (lang, text).

    Null texts are empty, a null language is `und`; repeated rows count as often as they are there; other columns are ignored; a table
    without phrases of that many occurrences, or without rows, gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = by_language(docs)
    words = materialise(word_counts(texts).where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    known = spark.sparkContext.broadcast((*rarity(words, most_words), pivot_rows))
    counted = materialise(counted_pairs(texts, known, least), "pairs")
    bits = spark.sparkContext.broadcast(frequent_pairs(counted, known, slot_bits))
    threes = spark.sparkContext.broadcast(frequent_threes(texts, known, bits, least, slot_bits))
    longer = phrases(fragments(texts, known, bits, threes, longest), least, longest)
    found = materialise(longer.union(named_pairs(counted, known)) if longest > 1 else longer, "phrases")
    kept = scored(found, words).join(covered(found), ["lang", "phrase", "a"], "left_anti")
    return best(kept, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 100, longest: int = 5, most: int = 2000) -> str:
    """The same in DuckDB SQL."""
    runs = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(ws[i:i + {m - 1}], ' ') AS phrase FROM placed WHERE i + {m - 1} <= len(ws)" for m in range(1, longest + 1))
    return f"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
    placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
    sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY 1),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM ({runs}) GROUP BY ALL HAVING count(*) >= {least}),
    candidates AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
    valued AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN sizes s ON s.lang = c.lang),
    lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, array_to_string(ws[:m - 1], ' ') AS phrase, a FROM candidates WHERE m > 2 UNION SELECT lang, array_to_string(ws[2:], ' '), a FROM candidates WHERE m > 2)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest ANTI JOIN inside USING (lang, phrase, a) QUALIFY rank <= {most}
    """
