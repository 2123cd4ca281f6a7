"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language's Bloom filter holds its most frequent n-grams. All filters share their hash functions, and slot i of one array holds
bit i of every filter, a bit a language (64 to a word, as many words as there are languages for): the AND of an n-gram's slots is the set
of languages that contain it. A text's languages
are counted bit by bit over its n-grams, each count is corrected for the filter's false positives, and the highest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import bounded_batches, own_worker, text_batches

#: Bounds of the model: documents that it is fitted on, a language and in all; n-grams a language, slots, hash functions. The slots take
#: one bit a language each, 128 KB a language.
LANGUAGE_DOCS, SAMPLE_DOCS, GRAMS, SLOTS, HASHES, N = 5_000, 20_000, 30_000, 1 << 20, 3, 4
#: How much rarer than in its most typical language an n-gram of a language may be.
RARER = 0.2
NO_LETTER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of the n-grams of the lower-cased words of a text, each with a space on either side; none without letters."""
    words = NO_LETTER.sub(" ", text.lower()).strip() if text else ""
    if not words:
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < N:
        c = np.concatenate([c, np.full(N - len(c), 32, np.uint64)])
    h = np.zeros(len(c) - N + 1, np.uint64)
    for i in range(N):
        h = h * np.uint64(0x100000001B3) + c[i : len(c) - N + 1 + i]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@dataclass
class Filters:
    languages: list[str]
    #: (words, SLOTS): word w holds the bits of languages 64 w to 64 w + 63.
    slots: np.ndarray
    false_rate: np.ndarray
    #: Share of a language's own n-grams that its filter holds.
    coverage: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, a bit each: (words, n-grams)."""
        out = self.slots[:, positions(h, 0)]
        for k in range(1, HASHES):
            out = out & self.slots[:, positions(h, k)]
        return out

    def decide(self, h: np.ndarray) -> tuple[str, float, float]:
        """(language, score, share): score is its weight among all languages, share how many of its expected n-grams are there."""
        if not len(h) or not self.languages:
            return "und", 0.0, 0.0
        masks = self.masks(h)
        hits = np.array([np.count_nonzero(masks[b // 64] & np.uint64(1 << b % 64)) for b in range(len(self.languages))]) / len(h)
        share = np.maximum((hits - self.false_rate) / (1 - self.false_rate), 1e-6) / self.coverage
        weight = (share / share.max()) ** 6
        best = int(weight.argmax())
        return self.languages[best], float(weight[best] / weight.sum()), float(share[best])


def positions(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def fit(docs: DataFrame) -> Filters:
    """Filters from rows (doc_id, text, lang) with a known language: a bounded sample of each language, drawn by a hash of the id.

    Rows with a null text or lang teach nothing, repeated rows are drawn together, and texts of any length are taken whole, a few million
    characters at a time; without rows there are no languages.
    """
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).withColumn("langs", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    # A row a language: as many as the model has bits a slot. Rare languages are drawn whole, frequent ones up to their share of the bound.
    most = F.least(F.lit(float(LANGUAGE_DOCS)), F.greatest(F.lit(SAMPLE_DOCS) / F.col("langs"), F.lit(50.0)))
    sizes = sizes.select("lang", (most / F.col("docs")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(11)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    some = known.join(F.broadcast(sizes), "lang").where(draw < F.col("share"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in text_batches(texts):
                by: dict[str, list[np.ndarray]] = {}
                for t, lang in zip(texts[part], langs[part], strict=True):
                    by.setdefault(lang, []).append(grams(t))
                for lang, parts in by.items():
                    h, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    counts = some.select("text", "lang").mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    # A language's n-grams in a bounded sample are a bounded group.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    # An n-gram far rarer than in another language comes from quotations and belongs to that one only.
    own = rates.withColumn("most", F.max("rate").over(Window.partitionBy("h"))).where(F.col("rate") >= RARER * F.col("most"))
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).where(F.col("r") <= GRAMS)
    rows = top.select("lang", "h", "n", "all").toPandas()
    languages = rows.groupby("lang")["n"].sum().sort_values(ascending=False).index.tolist()
    slots = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    by = {lang: part["h"].to_numpy(np.int64).view(np.uint64) for lang, part in rows.groupby("lang")}
    for b, lang in enumerate(languages):
        for k in range(HASHES):
            slots[b // 64, positions(by[lang], k)] |= np.uint64(1 << b % 64)
    fill = np.array([np.count_nonzero(slots[b // 64] & np.uint64(1 << b % 64)) / SLOTS for b in range(len(languages))])
    own = rows.groupby("lang").agg(n=("n", "sum"), all=("all", "max"))
    return Filters(languages, slots, fill**HASHES, np.array([own.loc[lang, "n"] / own.loc[lang, "all"] for lang in languages]))


def predict(docs: DataFrame, filters: Filters, *keep: str) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score of every whole text; `und` and 0 where it is null or has no letter."""
    known = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(*keep, "text")
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("language")
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for part in text_batches(texts):
                got = [known.value.decide(grams(t)) for t in texts[part]]
                here = b.slice(part.start, len(got))
                yield pa.RecordBatch.from_arrays([*here.columns[:-1], pa.array([g[0] for g in got]), pa.array([g[1] for g in got])], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(each, schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang); learns from the folds other than 2 of 4.

    Rows with a null id belong to no fold: they are predicted, not learned from, and not held out. Repeated rows stay; other columns
    are ignored. Without any known language every prediction is `und`.
    """
    part = fold(F.col("doc_id"), 4)
    filters = fit(docs.where(part != 2).select("doc_id", "text", "lang"))
    return predict(docs, filters, "doc_id").select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """The rows of docs, whole and with all their columns, that hold at least this share of the n-grams expected of some language.

    Learned from all rows with a known lang. Null texts, and texts without a letter, go: they have no language. Rows with null ids and
    repeated rows are judged as all others are; an empty table gives no rows. Where no row has a lang nothing is known, and all rows with a
    letter stay. Only texts go to Python.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))

    @F.pandas_udf("double")
    def share(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_worker("language")
        filters = known.value
        for t in texts:
            if filters.languages:
                yield pd.Series([filters.decide(grams(x))[2] for x in t], dtype=float)
            else:
                yield pd.Series([float(len(grams(x)) > 0) for x in t], dtype=float)

    return docs.where(share(F.col("text")) >= least)
