"""Collocations in two rounds: the second sends no fragment with a rare run of three words, and cuts equal fragments once."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from rankforge.llm import collocations


def mixed(copies):
    """Texts whose pairs are frequent and whose runs of three are mostly rare, and a passage that is repeated."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 12, 60)) for _ in range(40)]
    return [("en" if i % 3 else None, t + (" of the one and only" if i % 4 == 0 else "")) for i, t in enumerate(texts)] * copies


@pytest.mark.parametrize(("most_words", "slot_bits"), [(200_000, 27), (200_000, 15), (6, 20)])
def test_rare_runs_end_fragments(spark, monkeypatch, most_words, slot_bits):
    routed, inner = [], collocations.phrases
    monkeypatch.setattr(collocations, "phrases", lambda rows, *rest: routed.extend(rows.select("lang", "fragment").collect()) or inner(rows, *rest))
    rows, least = mixed(1), 6
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=least, most=500, most_words=most_words, slot_bits=slot_bits)
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["lang", "text"]))
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(collocations.collocations_sql(least, 5, 500)).fetchall())
    threes = Counter((lang or "und", *ws[i : i + 3]) for lang, text in rows for ws in [text.split()] for i in range(len(ws) - 2))
    sent = [(r["lang"], r["fragment"].split(" ")) for r in routed]
    assert sent
    if slot_bits > 15:
        assert all(threes[lang, *ws[i : i + 3]] >= least for lang, ws in sent for i in range(len(ws) - 2))
    if most_words > 6:
        assert min(len(ws) for _, ws in sent) == 3, "pairs are counted in the first round"
    if (most_words, slot_bits) == (200_000, 27):
        assert len(sent) < 0.1 * sum(len(text.split()) for _, text in rows)


def test_a_rare_run_parts_the_words_before_and_after():
    words = [b"a", b"b", b"c", b"d", b"e"]
    places = collocations.Places({"en": dict(zip(words, (90, 80, 10, 70, 60), strict=True))}, None, 200_000)
    every, none = np.full(1 << 12, 255, np.uint8), np.zeros(1 << 12, np.uint8)
    assert collocations.cut_out(places, every, "en", ["a b c d e"], 4, every).count((2, 2, b"a b c d e")) == 1
    assert collocations.cut_out(places, every, "en", ["a b c d e"], 4, none) == []
    behind = collocations.Places({"en": dict.fromkeys(words[:2], 90)}, 64, 200_000)
    assert sorted(collocations.cut_out(behind, every, "en", ["a c b"], 4, none)) == [(0, 1, b"c b"), (1, 0, b"a c")]


def test_equal_fragments_of_tasks_are_cut_once(spark):
    schema = "lang string, pivot string, parts int, paired boolean, before int, after int, fragment string, weight long"
    routed = spark.createDataFrame([("en", "c", 1, True, 2, 1, "a b c d", 3), ("en", "c", 1, False, 0, 1, "c e", 1)] * 4, schema)
    got = {r["phrase"]: r["f"] for r in collocations.phrases(routed, 4, 5).collect()}
    assert got == {"a b c": 12, "b c d": 12, "a b c d": 12, "c e": 4}
    plan = collocations.phrases(routed, 4, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "fragment" in plan[plan.index("Generate") :].split("Aggregate [", 1)[1].split("]")[0], "fragments are added up before"
