"""Group features, calibration over classes and decision thresholds against brute force."""

import numpy as np
import pandas as pd
import pytest

from rankforge.functions import grouping
from rankforge.operators import calibration


def test_group_features(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"g{i % 4}" if i % 9 else None, int(rng.integers(0, 5)), float(rng.normal(i % 4 * 10, 2)) if i % 5 else None, "abc"[int(rng.integers(0, 3))] if i % 7 else None, bool(i % 3 == 0)) for i in range(60)]
    rows += [(100 + i, f"lone{i}", 1, 2.0, "z", True) for i in range(2)]
    df = spark.createDataFrame(rows, "id int, g string, at int, x double, word string, flag boolean")
    found = grouping.fit_group_features(df, "g", ["at", "id"], most=8, ignore=["id", "at"])
    pdf = pd.DataFrame(rows, columns=["id", "g", "at", "x", "word", "flag"]).sort_values(["at", "id"])
    want = {}
    for c, aggs in (("x", grouping.NUMERIC), ("flag", grouping.NUMERIC), ("word", grouping.OTHER)):
        for a in aggs:
            s = pdf["g"].map((pdf.assign(flag=pdf["flag"].astype(int))).groupby("g")[c].agg(a))
            if c == "word" and a == "last":
                s = s.astype("category").cat.codes.astype(float).where(lambda v: v >= 0)
            want[f"{c}_{a}"] = float(s.astype(float).var())
    assert set(found.variances) == set(want) and {k: v for k, v in found.variances.items() if v is not None} == pytest.approx(want)
    assert list(found.selected) == sorted(want, key=lambda f: (-round(want[f], 9), f))[:8]
    out = found.transform(df)
    assert "g" not in out.columns and out.count() == len(rows)
    got = {r.id: r for r in out.collect()}
    means = pdf.groupby("g")["x"].mean()
    for i, g, *_ in rows:
        if g is None:
            assert got[i].x_mean is None
        else:
            assert got[i].x_mean == pytest.approx(means[g])


def test_group_features_keys_and_limits(spark, monkeypatch):
    df = spark.createDataFrame([("a", None, 1, 1.0), ("a", None, 2, 3.0), ("a", 1, 1, 9.0)], "g string, h int, at int, x double")
    found = grouping.fit_group_features(df, ["g", "h"], "at", most=2, ignore=["at"])
    monkeypatch.setattr(grouping, "MOST_GROUPS", 0)
    assert sorted(r.x_max for r in grouping.GroupFeatures(("g", "h"), ("at",), ("x_max",), {}).transform(df).collect()) == [3.0, 3.0, 9.0]
    assert len(found.selected) == 2
    empty = grouping.fit_group_features(df.where("false"), "g", "at", ignore=["at"])
    assert set(empty.variances.values()) == {None} and empty.transform(df.where("false")).count() == 0
    bare = grouping.fit_group_features(df.select("g", "at"), "g", "at", ignore=["at"])
    assert bare.selected == () and bare.transform(df.select("g", "at")).columns == ["at"]


def softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def test_temperatures(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, sharp in (("a", 3.0), ("b", 0.4)):
        p = softmax(rng.normal(size=(300, 4)))
        y = [rng.choice(4, p=q) for q in softmax(sharp * np.log(p))]
        rows += [(key, [float(x) for x in q], int(k)) for q, k in zip(p, y, strict=True)]
    rows += [("a", None, 1), ("a", [0.5, 0.5], None), ("a", [0.5, 0.5], 7), ("none", None, 1), ("c", [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "k string, p array<double>, y int")
    got = {r.k: r.invtemp for r in calibration.temperatures(df, "k").collect()}
    assert set(got) == {"a", "b", "c"}
    for key in "ab":
        z = np.log(np.array([r[1] for r in rows if r[0] == key and r[1] and r[2] is not None and r[2] < len(r[1])]) + 1e-10)
        y = [r[2] for r in rows if r[0] == key and r[1] and r[2] is not None and r[2] < len(r[1])]

        def loss(t, z=z, y=y):
            return -np.log(softmax(t * z)[np.arange(len(y)), y]).mean()

        assert loss(got[key]) <= min(loss(got[key] * 1.001), loss(got[key] * 0.999)) + 1e-12
    assert got["c"] == pytest.approx(np.exp(16.0), rel=1e-6)
    out = {r.k: r.p for r in calibration.calibrated(df.where("k in ('c', 'none') or k = 'a' and size(p) = 2"), spark.createDataFrame([("a", 2.0)], "k string, invtemp double"), "k").collect()}
    assert out["none"] is None and out["c"] == [0.0, 1.0] and out["a"] == pytest.approx([0.5, 0.5])


def test_thresholds(spark):
    rng = np.random.default_rng(4)
    rows = [("k", int(rng.random() < 0.4), float(rng.integers(0, 11)) / 10) for _ in range(80)] + [("one", 1, 0.2), ("one", 1, 0.7), ("gap", None, 0.1)]
    df = spark.createDataFrame(rows, "k string, y int, score double")
    for metric in calibration.THRESHOLD_METRICS:
        got = {r.k: r for r in calibration.decision_thresholds(df, "k", metric).collect()}
        best = []
        for t in sorted({s for k, _, s in rows if k == "k"}):
            tp, fp, fn, tn = (sum(k == "k" and (s >= t) == hit and (y == 1) == pos for k, y, s in rows) for hit, pos in ((True, True), (True, False), (False, True), (False, False)))
            part = lambda a, b: a / b if b else 0.0
            best.append((-round({"accuracy": (tp + tn) / 80, "f1": part(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (part(tp, tp + fn) + part(tn, tn + fp)) / 2}[metric], 12), abs(t - 0.5), t))
        assert (got["k"].threshold, got["k"].value) == (min(best)[2], pytest.approx(-min(best)[0]))
        assert got["one"].threshold == 0.2 and "gap" not in got
        error = {r.k: r.metric_error for r in calibration.class_metric_at(df.where("y is not null"), calibration.decision_thresholds(df, "k", metric), "k", metric).collect()}
        assert error["k"] == pytest.approx(1 - got["k"].value)
    with pytest.raises(ValueError):
        calibration.decision_thresholds(df, "k", "nope")
