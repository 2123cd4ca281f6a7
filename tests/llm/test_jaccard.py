"""The metric-space join against brute force, with regions large enough to be divided."""

import random

import numpy as np
import pytest

from rankforge.llm import jaccard_join
from rankforge.llm.components import components


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def varied(seed, n, edits):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(80)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        out.append(" ".join(t))
    return out


def some_rows():
    texts = varied(1, 60, 8) + varied(2, 15, 3) + ["a b c d e"] * 30 + ["short one", "SHORT one", "short\tone", "x", "", None, "  \n", "a b c d"]
    texts += [f"u{i} v{i} w{i} common passage of words here z{i}" for i in range(25)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("leaf", "pivots", "levels"), [(1024, 2048, 3), (8, 2048, 3), (8, 3, 1), (8, 3, 0), (1024, 0, 3)])
def test_against_brute_force(spark, monkeypatch, leaf, pivots, levels):
    monkeypatch.setattr(jaccard_join, "LEAF_SETS", leaf)
    monkeypatch.setattr(jaccard_join, "MOST_PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_regions_carry_the_join(spark, monkeypatch):
    """Without the regions of pivots links of sf0.01 are lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == want
    monkeypatch.setattr(jaccard_join, "cells_of", lambda ids, d, percent: (np.zeros(len(ids), bool), not len(ids) or bool(d.min() > 0.7)))
    none = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    lost = {i for i in want if none[i] != want[i]}
    # All links between different sets of sf0.01 come from the regions of pivots.
    assert lost and {none[i][1] for i in lost} == lost


def test_windows_at_borders(spark, monkeypatch):
    """Chains of edits run from one pivot to another; sets in between lie in the region of one and the window of the other."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{k}" if k < i else w for k, w in enumerate(base)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == want and len({c for _, c in want.values()}) == 1
    whole = jaccard_join.cells_of

    def home_only(ids, d, percent):
        within, outer = whole(ids, d, percent)
        return within & (np.arange(len(d)) == (d.argmin() if len(d) else 0)) & (not outer), outer

    monkeypatch.setattr(jaccard_join, "cells_of", home_only)
    cut = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert len(set(cut.values())) > 1


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None), (None, "z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(odd).collect())
    assert got == sorted([("None", 1, "4"), ("4", 1, "4"), ("4", 1, "4"), ("None", 0, "None"), ("None", 1, "None")])
    kept = jaccard_join.one_of_each(spark.createDataFrame([(1, "a b c", "k"), (2, "a b c", "l"), (3, "", "m")], "doc_id long, text string, lang string"))
    assert sorted(r.lang for r in kept.collect()) == ["k", "m"]


def test_one_row_of_each_component(spark):
    """Rows with null ids, and rows repeated as a whole, are copies as others are."""
    long = [f"w{i}" for i in range(60)]
    near = " ".join([*long[:-1], "other"])
    long = " ".join(long)
    rows = [(1, "a b c", "k"), (1, "a b c", "k"), (None, "a b c", "l"), (None, "x y", "m"), (None, "x y", "n"), (None, long, "o"), (9, near, "p"), (None, near, "q"), (8, near, "r"), (7, " ".join([near, *(f"z{i}" for i in range(40))]), "s")]
    rows += [(None, "", "t"), (None, "", "t"), (None, None, "u"), (None, None, "u"), (5, " ", "v"), (5, " ", "v"), (6, " ", "w"), (-4, "x y z", "x")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    got = sorted((str(r.doc_id), r.lang) for r in kept.collect())
    assert [g for g in got if g[1] not in "mn"] == sorted([("1", "k"), ("8", "r"), ("7", "s"), ("None", "t"), ("None", "u"), ("5", "v"), ("6", "w"), ("-4", "x")])
    assert len([g for g in got if g[1] in "mn"]) == 1 and kept.columns == ["doc_id", "text", "lang"]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c", "r1", "i1"), (2, "a b c", "r2", "i2"), (3, "x y", "r3", None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _row string, _id string"))
    assert kept.columns == ["doc_id", "text", "_row", "_id"]
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
