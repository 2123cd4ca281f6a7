"""Packing: what a worker is sent at once, and patterns against brute force."""

import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from rankforge.llm import packing
from rankforge.llm.common import PieceEncoder, own_worker, tokenizer_path


def test_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        packing.cut_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"))
        assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)


def test_best_pattern():
    sizes, value = np.array([2, 3, 7]), np.array([0.3, 0.5, 1.3])
    for capacity in range(13):
        best = max(float(np.dot(n, value)) for n in product(range(7), repeat=3) if np.dot(n, sizes) <= capacity)
        got, pattern = packing.best_pattern(value, sizes, capacity)
        assert abs(got - best) < 1e-9 and sum(sizes[i] * n for i, n in pattern.items()) <= capacity


def test_encoder_meets_new_pieces_between_known_ones():
    encoder = PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    encoder.encode(["known words"])
    texts = ["known newly words newly", None, "", "words <|endoftext|> é x"]
    assert encoder.encode(texts) == [encoder.whole([t])[0] if t else b"" for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("most", [2, 40, 1_000_000])
def test_encoder_cuts_at_blanks_and_line_feeds_like_the_library(name, most):
    encoder, rng = PieceEncoder(tokenizer_path(name), most), random.Random(5)
    parts = [" ", " ", " ", "\n", "\n", "  ", "\t", "\r", "\x0b", "\x00", "\x1c", "\x85", "\xa0", "\u200b", "\u180e", "a", "Word", "naïve", "ÿÀ", "'s", "it's", "x***", "&&&", "%'ll", "12", "<", "<|endoftext|>", "漢", "ª", "e\u0301", "-_-", "~", "/b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(20000)]
    assert encoder.encode(texts) == encoder.whole(texts)


def test_encoder_splits_a_text_once_and_keeps_a_bounded_table():
    encoder, found = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), 200), []
    make = encoder.table.make
    encoder.table.make = lambda key: found.append(key) or make(key)
    texts = [f"often {i:b}".translate({48: "o", 49: "i"}) + " word" for i in range(2000)]
    encoder.encode(texts)
    assert len(encoder.table) + len(encoder.table.earlier) <= 220
    assert len(found) == len(set(found)) == 2000 + 2, "what is met again stays while the table turns over"


def held_words(spark):
    """The most words that a Python worker's encoders hold, as far as idle workers take up the tasks."""

    def count(batches):
        import gc

        for b in batches:
            n = sum(len(o.table) + len(o.table.earlier) for o in gc.get_objects() if type(o).__name__ == "PieceEncoder")
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], names=["n"])

    return spark.range(0, 64, 1, 16).mapInArrow(count, "n long").agg({"n": "max"}).first()[0]


def test_words_go_as_a_task_ends(spark):
    docs = spark.createDataFrame([(i, f"some word{chr(97 + i % 26)} of {i}\n\nand more") for i in range(200)], "doc_id long, text string").repartition(4)
    path = tokenizer_path("byte_bpe_50k.json")
    kept = sorted(packing.cut_pieces(docs, path).collect())
    assert held_words(spark) > 0
    spark.range(0, 64, 1, 16).mapInArrow(lambda batches: (own_worker("another") or b for b in batches), "id long").count()
    assert held_words(spark) == 0
    assert sorted(packing.cut_pieces(docs, path, lasting=False).collect()) == kept
    assert held_words(spark) == 0
