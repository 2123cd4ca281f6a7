"""Importance resampling, collocations and URL verdicts: SQL, brute force and edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import collocations, resampling, url_filter

DATA = "/root/testdata/sf0.001"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_resampling_sql(spark, duck):
    got = resampling.resample(table(spark, "documents"), table(spark, "benchmark"))
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(resampling.resample_sql()).fetchall())


def grams_of(text):
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS)) if w]
    return ws, [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def test_resampling_brute_force(spark):
    long = " ".join(f"w{i % 37}" for i in range(3000))
    rows = [(1, "Écoute ÉCOUTE a-b c" * 8), (2, long), (None, long), (3, None), (4, ""), (2, long), (5, "x\x00y z " * 9), (6, "one two")]
    rows += [(i, f"{'alpha beta ' * 10} t{i}") for i in range(10, 60)]
    target = [("alpha beta gamma",), (None,), ("w1 w2 w3",)]
    docs = spark.createDataFrame([(*r, "c", "r") for r in rows], "doc_id long, text string, row string, b1 string")
    got = resampling.resample(docs, spark.createDataFrame(target, "text string")).collect()
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams_of(text)[1])
    for (text,) in target:
        t.update(grams_of(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    want = []
    for i, text in rows:
        ws, bs = grams_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        want.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= 20])
    drawn = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    take = 5 * len(drawn) // 100
    assert take >= 2
    ranks = Counter((r[0], *r[1:4], k + 1) for k, r in enumerate(drawn[:take]))
    key = Counter(tuple(r[:4]) for r in want)
    assert Counter(tuple(r)[:4] for r in got) == key
    assert Counter(tuple(r) for r in got if r["rank"] is not None) == ranks


def test_resampling_empty(spark):
    docs = table(spark, "documents")
    assert resampling.resample(docs.where("false"), table(spark, "benchmark")).count() == 0
    assert resampling.resample(docs, table(spark, "benchmark").where("false")).where("rank is not null").count() > 0


def test_collocations_sql(spark, duck):
    got = collocations.collocations(table(spark, "documents"))
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(collocations.collocations_sql()).fetchall())


def mined(rows, least, longest, most):
    """All contiguous phrases of every piece, counted outright."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        if any(lang == other and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in candidates.items()):
            continue
        score, k = min(((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    return [(lang, i + 1, *r[1:]) for lang, own in itertools.groupby(out, key=lambda r: r[0]) for i, r in enumerate(list(own)[:most])]


@pytest.mark.parametrize("most_words", [200_000, 4])
@pytest.mark.parametrize("pivot_rows", [200_000, 7])
def test_collocations_brute_force(spark, most_words, pivot_rows):
    words = "a b c d É é x\x1cy the The of".split(" ")
    texts = [" ".join(words[(i * i + j * (i % 5 + 1) + j // 3) % 10] for j in range(40)) for i in range(60)]
    rows = [("en", t) for t in texts] + [(None, "of the of the, of the\tof  the\nof") for _ in range(9)]
    rows += [("en", None), ("en", ""), ("de", "a a a a a a a a"), ("de", "a a a. a a a a"), ("de", "solo"), ("en", " ".join(texts) * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    got = collocations.collocations(docs, least=5, longest=5, most=30, most_words=most_words, pivot_rows=pivot_rows)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows, 5, 5, 30))


def test_collocations_full_bitmap(spark, monkeypatch):
    """Where every pair's bit is set nothing is sorted out before, and nothing changes."""
    monkeypatch.setattr(collocations, "frequent_pairs", lambda *_: np.full(1 << 12, 255, np.uint8))
    rows = [("en", "to be or not to be that is the question " * 4), ("en", "be to the is question not")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=3, most=50).collect())) == sorted(mined(rows, 3, 5, 50))
    assert collocations.collocations(docs.where("false")).count() == 0


URLS = [
    ("https://A.Example.ORG/x", "a.example.org", "/x", "org/", "allow"),
    ("https://example.org/es/1?a=b", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://www.example.org/en/12#top", "www.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
    ("http://b.com/de/x?y#z", "b.com", "/de/x", "com/de/", "block"),
    ("http://b.com/de", "b.com", "/de", None, None),
    ("http://b.org", "b.org", "", None, None),
    ("http://b.org?x=/es/", "b.org", "", None, None),
    ("no scheme.org/es/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("x://y.com/fr/://z.com/de/", "y.com", "/fr/://z.com/de/", "com/fr/", "allow"),
    ("http://É.COM/fr/", "É.com", "/fr/", "com/fr/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, rule string")
    got = url_filter.judge(pages).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.where("false")).count() == 0
    alone = url_filter.judge(pages.where("rule is not null and url is null"))
    assert {r["verdict"] for r in alone.collect()} == {"allow"}


def test_url_trees_held_out(spark):
    """Trees that learn from four fifths of the labelled URLs judge the others; what they must beat is always saying the commoner label."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    labelled = url_filter.ruled(pages, url_filter.RULES).where("ruling is not null").withColumn("y", (F.col("ruling") == "block").cast("int")).drop("rule", "ruling")
    held = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(5)) == 0
    model, known = url_filter.fit(labelled.where(~held))
    assert model.trees
    rows = url_filter.lexical(labelled.where(held))
    for t in url_filter.TOKENS:
        rows = rows.join(known[t].where("fold = 0").select(t, F.col("whole").alias(f"{t}_rate")), t, "left").na.fill({f"{t}_rate": model.prior})
    right, blocked, n = rows.agg(F.avg(((model.blocked() > 0.5).cast("int") == F.col("y")).cast("int")), F.avg("y"), F.count("*")).first()
    assert n > 100 and right >= 0.9 and right > max(blocked, 1 - blocked)


def test_url_features(spark):
    rows = [("https://ab-c.d.org/x1/y2.html?p=1&q=&&r#f",), (None,)]
    urls = spark.createDataFrame(rows, "url string").select("url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    a, b = sorted(url_filter.lexical(urls).collect(), key=lambda r: r["url"] is None)
    u = rows[0][0]
    assert (a["length"], a["host_length"], a["path_length"], a["host_depth"], a["path_depth"], a["parameters"], a["hyphens"]) == (len(u), 10, 11, 3, 2, 3, 1)
    assert a["digit_ratio"] == pytest.approx(3 / len(u))
    assert a["entropy"] == pytest.approx(-sum(n / len(u) * math.log2(n / len(u)) for n in Counter(u).values()))
    assert (a["suffix"], a["domain"], a["directory"], a["extension"]) == ("org", "d.org", "x1", "html")
    assert b["length"] == b["entropy"] == b["digit_ratio"] == 0


def test_best_split_is_the_best():
    """Against all splits of a small histogram, by the gain of two leaves over one."""
    unit = url_filter.UNIT
    hist = {0: [(5, 9), (-4, 7), (3, 8), (-9, 6)], 1: [(1, 10), (-6, 10), (0, 10), (0, 0)]}
    rows = [{"feature": k, "bin": b, "g": g * unit, "h": h * unit} for k, own in hist.items() for b, (g, h) in enumerate(own)]
    got = url_filter.best_split(rows, {"p": [1.0, 2.0, 3.0], "q": [1.0, 2.0, 3.0]}, ["p", "q"])
    gains = {}
    for k, name in enumerate("pq"):
        for cut in (1, 2, 3):
            (lg, lh), (rg, rh) = (tuple(map(sum, zip(*hist[k][a:b], strict=True))) for a, b in ((0, cut), (cut, 4)))
            if lh >= 1 and rh >= 1:
                gains[name, float(cut)] = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (lg + rg) ** 2 / (lh + rh + 1)
    assert got[:2] == max(gains, key=gains.get)
