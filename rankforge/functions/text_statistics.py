"""Statistical embeddings of texts: weighted character n-grams of words, projected onto their leading singular vectors.

Weights are a sparse matrix with a row a text, and a text's row stays in one piece: its n-grams are counted where it is read, their inverse
frequencies are broadcast, so nothing of the matrix is shuffled. Its leading vectors come from subspace iteration: a task multiplies its
rows with a few dozen numbers a term, and back, and only its sums by term are shuffled. A vocabulary too large to broadcast has its weights
as (key, term, weight) rows, which are joined with the vectors instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from rankforge.sources.stored import bounded_batches, stored

#: Lengths of n-grams, and dimensions of an embedding.
GRAMS, DIMENSIONS = (3, 4), 32
#: Vectors beside the wanted ones, and rounds of the iteration.
SPARE, ROUNDS = 8, 5
#: Terms that are broadcast with their numbers, at most.
MOST_TERMS = 300_000
#: Tasks whose sums by term are added up, at most, and terms or characters that go into one batch, about.
SUMS, PORTION = 64, 300_000
#: What the split of texts into words takes for white space.
SPACE = re.compile(r"\s+", re.ASCII)


def term_counts(rows: DataFrame, key: list[str], text: str, missing: str = "NA") -> DataFrame:
    """(*key, term, n): how often each n-gram of each word, with a space on both sides, occurs in lower case; null texts are `missing`.

    A word shorter than an n-gram counts once. Rows of one key are one text; texts without words have no rows.
    """
    words = rows.select(*key, F.explode(F.split(F.lower(F.coalesce(text, F.lit(missing))), r"\s+")).alias("word")).where("word <> ''")
    counted = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    padded, size = F.concat(F.lit(" "), "word", F.lit(" ")), F.length("word")
    short, long = GRAMS
    # A padded word is two longer than the word; the longer n-grams need a word of two letters.
    pieces = [F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(padded, i, F.lit(short)))]
    pieces.append(F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(padded, i, F.lit(long)))).otherwise(F.array().cast("array<string>")))
    return counted.select(*key, "n", F.explode(F.concat(*pieces)).alias("term")).groupBy(*key, "term").agg(F.sum("n").alias("n"))


def inverse_frequencies(counts: DataFrame, key: list[str], texts: int) -> DataFrame:
    """(term, idf): ln((1 + texts) / (1 + texts with the term)) + 1."""
    return counts.groupBy("term").agg((F.log((F.lit(1.0) + texts) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))


def term_weights(counts: DataFrame, frequencies: DataFrame, key: list[str]) -> DataFrame:
    """(*key, term, weight): counts times idf, of unit length a key; terms without an idf are left out."""
    raw = counts.join(frequencies.select("term", "idf"), "term").withColumn("weight", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*key)))
    return raw.select(*key, "term", (F.col("weight") / norm).alias("weight"))


def columns_of(rows: DataFrame, key: list[str], **more) -> StructType:
    out = StructType([rows.schema[c] for c in key])
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def grams(text: str) -> Counter:
    """How often each n-gram of each word, with a space on both sides, occurs in a text."""
    out: Counter = Counter()
    for word, n in Counter(SPACE.split(text)).items():
        if word:
            padded = f" {word} "
            own = [padded[i : i + size] for size in GRAMS for i in range(len(padded) - size + 1)]
            out.update(own * n)
    return out


def tallies(rows: DataFrame, key: list[str], text: str, missing: str = "NA") -> tuple[DataFrame, int]:
    """((*key, terms, ns), number of texts): what term_counts() has of a text as arrays in one row.

    A text that is one row is counted where it is read. Only rows of keys that come more than once meet, by key and term.
    """
    bounded_batches(rows.sparkSession)
    lowered = rows.select(*key, F.lower(F.coalesce(text, F.lit(missing))).alias("_text"))
    schema = columns_of(rows, key, terms=ArrayType(StringType()), ns=ArrayType(LongType()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, ends, terms, ns = [], [0], [], []

            def sent(b=b):
                kept = [b.column(i).take(pa.array(owner, pa.int64())) for i in range(len(key))]
                ends_ = pa.array(ends, pa.int32())
                arrays = [pa.ListArray.from_arrays(ends_, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends_, pa.array(ns, pa.int64()))]
                return pa.RecordBatch.from_arrays([*kept, *arrays], names=schema.names)

            for i, x in enumerate(b.column(len(key))):
                own = grams(x.as_py())
                if own:
                    owner.append(i)
                    terms += own.keys()
                    ns += own.values()
                    ends.append(len(terms))
                if len(terms) > PORTION:
                    yield sent()
                    owner, ends, terms, ns = [], [0], [], []
            if owner:
                yield sent()

    copies = lowered.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    seen = copies.agg(F.count(F.lit(1)).alias("texts"), F.max("_rows").alias("most")).first()
    if (seen["most"] or 0) <= 1:
        return lowered.mapInArrow(count, schema), seen["texts"]
    again = copies.where("_rows > 1").select(*[F.col(c).alias(f"_{c}") for c in key])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    parts = counts_of(lowered.join(again, same, "left_semi").mapInArrow(count, schema), key).groupBy(*key, "term").agg(F.sum("n").alias("n"))
    merged = parts.groupBy(*key).agg(F.collect_list(F.struct("term", "n")).alias("_t")).select(*key, F.col("_t.term").alias("terms"), F.col("_t.n").alias("ns"))
    return lowered.join(again, same, "left_anti").mapInArrow(count, schema).unionByName(merged), seen["texts"]


def counts_of(bags: DataFrame, key: list[str]) -> DataFrame:
    """(*key, term, n) of bags (*key, terms, ns)."""
    return bags.select(*key, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ns").alias("n"))))


def known_terms(frequencies: DataFrame) -> Broadcast | None:
    """(terms, idf) as arrays for all tasks, or nothing if there are more than MOST_TERMS."""
    if frequencies.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        return None
    table = frequencies.select("term", "idf").toArrow().combine_chunks()
    return frequencies.sparkSession.sparkContext.broadcast((pa.array(table["term"].to_pylist(), pa.string()), table["idf"].to_numpy()))


def located(b: pa.RecordBatch, names: pa.Array) -> pa.RecordBatch:
    """(*key, at, ns) of a batch (*key, terms, ns): places of the terms among names. Other terms go, and texts without any that stay."""
    at = pc.index_in(b.column("terms").flatten(), value_set=names)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
    sizes = np.bincount(owner[known], minlength=b.num_rows)
    keep = np.flatnonzero(sizes)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]), pa.int32())
    key = [c for c in b.schema.names if c not in ("terms", "ns")]
    lists = [pa.ListArray.from_arrays(ends, x) for x in (at.drop_null(), b.column("ns").flatten().filter(pa.array(known)))]
    return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(keep)) for c in key], *lists], names=[*key, "at", "ns"])


def weighted(b: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text of a batch (*key, at, ns) starts and the last one ends, at, weight)."""
    at = b.column("at").flatten().to_numpy(zero_copy_only=False)
    w = b.column("ns").flatten().to_numpy(zero_copy_only=False) * idf[at]
    sizes = pc.list_value_length(b.column("at")).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if len(w):
        w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, ends[:-1])), sizes)
    return ends, at, w


def bag_weights(bags: DataFrame, frequencies: DataFrame, key: list[str]) -> DataFrame:
    """(*key, term, weight) of bags (*key, terms, ns), as term_weights() has them."""
    known = known_terms(frequencies)
    if known is None:
        return term_weights(counts_of(bags, key), frequencies, key)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = known.value
        for b in batches:
            b = located(b, names)
            ends, at, w = weighted(b, idf)
            owner = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            for i in range(0, len(w), PORTION):
                part = owner[i : i + PORTION]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(part) for c in key], names.take(pa.array(at[i : i + PORTION])), pa.array(w[i : i + PORTION])], names=[*key, "term", "weight"])

    return bags.mapInArrow(weigh, columns_of(bags, key, term=StringType(), weight=DoubleType()))


def lists_of(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def aligned(vectors: DataFrame, known: Broadcast, k: int) -> Broadcast:
    """The vectors (term, v) as a matrix for all tasks, a row a known term."""
    table = vectors.select("term", "v").toArrow().combine_chunks()
    out = np.zeros((len(known.value[0]), k))
    for b in table.to_batches():
        out[pc.index_in(b.column("term"), value_set=known.value[0]).to_numpy(zero_copy_only=False)] = matrix_of(b, k)
    return vectors.sparkSession.sparkContext.broadcast(out)


def there_and_back(bags: DataFrame, known: Broadcast, vectors: DataFrame, k: int) -> DataFrame:
    """(term, v): vectors of terms times the weights of bags (*key, at, ns), summed by text, times the weights again, summed by term.

    A task adds up its own texts; at most SUMS tasks send each term's sum on.
    """
    matrix = aligned(vectors, known, k)

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, idf), m = known.value, matrix.value
        total = np.zeros_like(m)
        for b in batches:
            ends, at, w = weighted(b, idf)
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                own, x = at[i:j], w[i:j]
                total[own] += np.outer(x, x @ m[own])
        met = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(met), PORTION // k):
            part = met[i : i + PORTION // k]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(part)), lists_of(total[part])], names=["term", "v"])

    sums = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k)]
    each = bags.select("at", "ns").coalesce(SUMS).mapInArrow(turn, "term string, v array<double>")
    return each.groupBy("term").agg(*sums).select("term", F.array(*[f"v{i}" for i in range(k)]).alias("v"))


def placed_bags(bags: DataFrame, known: Broadcast, vectors: DataFrame, key: list[str], k: int) -> DataFrame:
    """(*key, v): vectors of terms times the weights of bags, (*key, at, ns) or (*key, terms, ns), summed by text."""
    matrix = aligned(vectors, known, k)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, idf), m = known.value, matrix.value
        for b in batches:
            b = b if "at" in b.schema.names else located(b, names)
            ends, at, w = weighted(b, idf)
            v = np.array([w[i:j] @ m[at[i:j]] for i, j in zip(ends[:-1], ends[1:], strict=True)]).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in key], lists_of(v)], names=[*key, "v"])

    return bags.mapInArrow(place, columns_of(bags, key, v=ArrayType(DoubleType())))


def numbered_bags(bags: DataFrame, known: Broadcast, key: list[str]) -> DataFrame:
    """(*key, at, ns) of bags (*key, terms, ns)."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield located(b, known.value[0])

    return bags.mapInArrow(number, columns_of(bags, key, at=ArrayType(IntegerType()), ns=ArrayType(LongType())))


def projected(weights: DataFrame, vectors: DataFrame, by: list[str], to: list[str], k: int) -> DataFrame:
    """(*to, v): the vectors of `by`, (*by, v), times the weights, summed by `to`."""
    sums = [F.sum(F.col("weight") * F.col("v")[i]).alias(f"v{i}") for i in range(k)]
    return weights.join(vectors, by).groupBy(*to).agg(*sums).select(*to, F.array(*[f"v{i}" for i in range(k)]).alias("v"))


def matrix_of(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def gram(vectors: DataFrame, k: int) -> np.ndarray:
    """The k by k matrix of inner products of the columns; k squared rows reach the driver."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            m = matrix_of(b, k)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    found = vectors.select("v").mapInArrow(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(k * k)
    for r in found:
        out[r["at"]] = r["x"]
    return out.reshape(k, k)


def rotated(vectors: DataFrame, k: int, matrix: np.ndarray) -> DataFrame:
    """vectors with v times the matrix, whose size the number of vectors bounds."""

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = lists_of(matrix_of(b, k) @ matrix)
            yield pa.RecordBatch.from_arrays([v if n == "v" else b.column(n) for n in b.schema.names], names=b.schema.names)

    return vectors.mapInArrow(turn, vectors.schema)


def start(term: str, k: int) -> Column:
    """k numbers between -1 and 1 that the term's hash gives."""
    return F.array(*[(F.xxhash64(F.lit(i), term) / F.lit(2.0**63)) for i in range(k)])


def spectrum(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a Gram matrix that are more than rounding errors, the largest first, and their vectors."""
    values, vectors = np.linalg.eigh(matrix)
    keep = np.argsort(-values)
    keep = keep[values[keep] > 1e-12 * max(values.max(), 0)] if len(values) else keep
    return values[keep], vectors[:, keep]


@dataclass(frozen=True)
class TextStatistics:
    """A fitted embedding: `vocabulary` (term, idf, v), singular values, and the number all dimensions are divided by."""

    vocabulary: DataFrame
    singular: tuple[float, ...]
    scale: float

    def transform(self, rows: DataFrame, key: list[str], text: str) -> DataFrame:
        """(*key, v): an array of numbers for each key of rows; zeros for texts without a known term and for null keys."""
        k = len(self.singular)
        if not k:
            return rows.select(*key).distinct().withColumn("v", F.array().cast("array<double>"))
        bags, _ = tallies(rows.dropna(subset=key), key, text)
        known = known_terms(self.vocabulary)
        if known is None:
            weights = term_weights(counts_of(bags, key), self.vocabulary, key)
            found = projected(weights, self.vocabulary.select("term", "v"), ["term"], key, k)
        else:
            found = placed_bags(bags, known, self.vocabulary, key, k)
        zeros = F.array(*[F.lit(0.0)] * k).cast("array<double>")
        out = rows.select(*key).distinct().join(found, key, "left")
        return out.select(*key, F.coalesce(F.transform("v", lambda x: x / self.scale), zeros).alias("v"))


def passes(bags: DataFrame, frequencies: DataFrame, key: list[str]) -> tuple[Callable, Callable]:
    """Two functions of vectors (term, v) and their length: what the weights of bags make of them by text and back by term, and by text."""
    terms = known_terms(frequencies)
    if terms is not None:
        numbered = stored(numbered_bags(bags, terms, key), "numbered-bags")
        return lambda v, k: there_and_back(numbered, terms, v, k), lambda v, k: placed_bags(numbered, terms, v, key, k)
    weights = stored(term_weights(counts_of(bags, key), frequencies, key), "term-weights")
    return lambda v, k: projected(weights, projected(weights, v, ["term"], key, k), key, ["term"], k), lambda v, k: projected(weights, v, ["term"], key, k)


def fit_text_statistics(rows: DataFrame, key: list[str], text: str, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> TextStatistics:
    """The embedding of the texts of rows in at most `dimensions` numbers, fewer if the weights have a lower rank.

    Dimensions are the leading ones, the strongest first; a dimension's sign is the one that gives its third powers a positive sum over all
    keys. All of them are divided by the root of their summed variances. Null texts are the text NA; tables without a word give no
    dimensions. Null keys have no embedding.
    """
    k = dimensions + SPARE
    known = rows.dropna(subset=key)
    bags, texts = tallies(known, key, text)
    frequencies = stored(inverse_frequencies(counts_of(bags, key), key, texts), "inverse-frequencies")
    back, place = passes(bags, frequencies, key)
    vectors = frequencies.select("term", start("term", k).alias("v"))
    for _ in range(rounds):
        found = stored(back(vectors, k), "term-vectors")
        values, basis = spectrum(gram(found, k))
        if not len(values):
            return TextStatistics(frequencies.withColumn("v", F.array().cast("array<double>")), (), 1.0)
        vectors, k = rotated(found, k, basis / np.sqrt(values)), len(values)
    placed = stored(place(vectors, k), "text-vectors")
    values, basis = spectrum(gram(placed, k))
    values, basis = values[:dimensions], basis[:, :dimensions]
    turned = rotated(placed, k, basis)
    sums = turned.agg(*[f.alias(f"{n}{i}") for i in range(len(values)) for n, f in (("s", F.sum(F.col("v")[i])), ("c", F.sum(F.pow(F.col("v")[i], 3))))]).first()
    signs = np.array([-1.0 if (sums[f"c{i}"] or 0) < 0 else 1.0 for i in range(len(values))])
    variance = sum(values[i] / texts - ((sums[f"s{i}"] or 0) / texts) ** 2 for i in range(len(values)))
    vocabulary = stored(rotated(vectors, k, basis * signs).join(frequencies, "term").select("term", "idf", "v"), "vocabulary")
    return TextStatistics(vocabulary, tuple(np.sqrt(values).tolist()), float(np.sqrt(variance)) if variance > 1e-12 else 1.0)
