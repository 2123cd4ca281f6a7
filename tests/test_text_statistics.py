"""Weights and embeddings of texts that are counted where they are read, against joined rows."""

import numpy as np
import pytest

from rankforge.functions import text_statistics
from rankforge.plans import sourced

ROWS = [(1, 0, "spark Joins spark"), (1, 1, None), (2, 0, "a skewed key"), (2, 0, "a b"), (2, 0, "a b"), (None, 3, "no key"), (None, 3, "key"), (4, None, "naïve"), (5, 5, " "), (6, 6, "spark")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def conversations(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_weights_of_repeated_and_null_keys(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from rankforge.plans import registry

    d = conversations(spark, tmp_path, ROWS)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
    want = {r[:3]: r[3] for r in duck.execute("SELECT conv_id, turn, term, weight FROM (" + registry.ORACLE_SQL["text_term_weights"] + ")").fetchall()}
    for most in (text_statistics.MOST_TERMS, 0):
        monkeypatch.setattr(text_statistics, "MOST_TERMS", most)
        got = sourced.text_term_weights(spark, d).collect()
        assert len(got) == len(want) and {tuple(r[:3]): r.weight for r in got} == pytest.approx(want)


def test_weights_are_not_shuffled(spark, tmp_path):
    d = conversations(spark, tmp_path, [(i, 0, f"text {i} of some words") for i in range(50)])
    assert exchanges(sourced.text_term_weights(spark, d)) == 0


def test_rounds_send_a_term_once_a_task(spark):
    rows = spark.createDataFrame([(i, "the same few words") for i in range(400)], "id int, text string").repartition(4)
    bags, texts = text_statistics.tallies(rows, ["id"], "text")
    frequencies = text_statistics.inverse_frequencies(text_statistics.counts_of(bags, ["id"]), ["id"], texts)
    known = text_statistics.known_terms(frequencies)
    vectors = frequencies.select("term", text_statistics.start("term", 3).alias("v"))
    numbered = text_statistics.numbered_bags(bags, known, ["id"])
    assert texts == 400 and exchanges(numbered) == 1  # that of the rows above
    back = text_statistics.there_and_back(numbered, known, vectors, 3)
    weights = text_statistics.bag_weights(bags, frequencies, ["id"])
    joined = text_statistics.projected(weights, text_statistics.projected(weights, vectors, ["term"], ["id"], 3), ["id"], ["term"], 3)
    got, want = ({r.term: r.v for r in x.collect()} for x in (back, joined))
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in want)


def test_embeddings_by_either_way(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["spark", "shuffle", "join", "a", "go", "partition", "skew"]
    rows = spark.createDataFrame([(i // 2, " ".join(rng.choice(words[i % 3 :], size=4))) for i in range(40)] + [(90, "")], "id int, text string")
    found = []
    for most in (text_statistics.MOST_TERMS, 3):
        monkeypatch.setattr(text_statistics, "MOST_TERMS", most)
        fit = text_statistics.fit_text_statistics(rows, ["id"], "text", dimensions=4, rounds=3)
        out = {r.id: r.v for r in fit.transform(rows, ["id"], "text").collect()}
        found.append((fit.singular, np.array([out[i] for i in sorted(out)])))
    assert found[0][0] == pytest.approx(found[1][0]) and found[0][1].shape == (21, 4)
    assert np.abs(found[0][1] - found[1][1]).max() < 1e-6
