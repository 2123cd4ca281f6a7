"""Extraction, language ID, toxicity and fingerprints: fixtures, held-out accuracy, edge cases."""

import html
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import html_extract, imatch, language_id, toxicity
from rankforge.llm.queries import ORACLE_SQL

DATA = "/root/testdata/sf0.01"


def test_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
    <div id="main-content"><article><h1>Title &amp; more</h1><p>First   para,\n with <b>bold</b>&nbsp;text.<p>Second one. It is, I think, longer than the first.
    <ul><li>An item, of a list.<li>Another item.</ul><div class="ad">Buy now, cheap. Really.</div><form><label>Mail</label><input></form></article>
    <section id="comments"><p>I, as a reader, disagree. Strongly. With all of this.</p></section></div>
    <aside><p>Related: things, you may like.</p></aside><footer>&copy; someone</footer></body></html>"""
    text, paths = html_extract.main_text(page)
    assert text.split("\n") == ["Title & more", "First para, with bold text.", "Second one. It is, I think, longer than the first.", "An item, of a list.", "Another item."]
    assert paths


@pytest.mark.parametrize("page", ["", None, "<", "<<<>>>", "<p", "<!-- never closed", "<script>x", "</p></div>", "&amp", "<nav>only menu</nav>", "<b>" * 3000, "\x00"])
def test_odd_pages(page):
    assert isinstance(html_extract.main_text(page)[0], str)


def test_plain_and_div_pages():
    assert html_extract.main_text("just text, no tags")[0] == "just text, no tags"
    page = "<html><body><div id=menu><a>Home</a></div><div><div><p>One, two. Three.</p><p>Four, five. Six, seven.</p></div></div><div class=footer>Legal.</div></body></html>"
    assert html_extract.main_text(page)[0] == "One, two. Three.\nFour, five. Six, seven."


def test_named_parts_of_an_article_stay():
    """Expected texts are written by hand: names of topics stay, names of page furniture go, inside an article and in plain divs."""
    long = "A sentence of some length, with a comma. Another one, which is as long as that."
    parts = f"""<h1 id="social">Title</h1><p id="ad">{long}</p><section id="discussion"><h2 id="search">Search</h2><p>{long} 1</p></section><div id="legal-history"><p>{long} 2</p>
    <h3 id="feedback">Feedback</h3><p class="related">Go, now.</p></div><div class="social-policy"><p>{long} 3</p></div>
    <div class="ad">Buy, now.</div><div class="share-buttons">Share it.</div><section class="comments"><p>I, {long}</p></section><div class="newsletter-signup"><p>Mail, please.</p></div>"""
    want = ["Title", long, "Search", f"{long} 1", f"{long} 2", "Feedback", f"{long} 3"]
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<html><body><div class='site-menu-top'><a>Home</a></div><{tag}>{parts}</{tag}></body></html>")[0].split("\n") == want
    page = f"<html><body><div id='my-menu'><ul><li>Home</li><li>About</li></ul></div><div id='legal-history'><h2 id='search'>Search</h2><p>{long}</p></div><div class='cookie-notice'><p>{long}</p></div></body></html>"
    assert html_extract.main_text(page)[0] == f"Search\n{long}"
    mixed = f"<div id='my-menu'><p>{long}</p><ul>{'<li>One more of many entries</li>' * 9}</ul></div>"
    assert html_extract.main_text(f"<body>{mixed}<h3>Left</h3></body>")[0] == "Left" and long in html_extract.main_text(f"<body>{mixed}</body>")[0]


@pytest.mark.parametrize("title", ["", "<h1>Title</h1>"])
@pytest.mark.parametrize("rest", ["", "<ul><li>short</li><li>list</li></ul>", "<div><p>Caption</p></div>", "<div class='share'>Share it.</div><h3>Sub</h3>"])
@pytest.mark.parametrize("above", ["", "<div id='menu'><a>Home</a></div>", "<nav>Home</nav>", "<ul><li><a>Home</a></li><li><a>About</a></li></ul>"])
@pytest.mark.parametrize("deep", [0, 1, 2])
def test_div_pages_keep_what_surrounds_the_text(title, rest, above, deep):
    """Titles, lists and captions beside the element of the text stay, menus and footers go."""
    long = "A sentence of some length, with a comma; and more. Another one, which is longer, even, than that."
    inner = f"{title}<div><p>{long}</p><p>{long}</p></div>{rest}"
    page = f"<html><body>{above}{'<div>' * deep}<div>{inner}</div>{'</div>' * deep}<div class='footer'>Legal, all of it.</div></body></html>"
    after = {"": [], "<u": ["short", "list"], "<d": ["Caption"]}[rest[:2]] if "share" not in rest else ["Sub"]
    assert html_extract.main_text(page)[0].split("\n") == [*(["Title"] if title else []), long, long, *after]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text", "<blockquote>a" * 20_000, '<a "' * 64_000, "<a '\">" * 30_000, "<title>" * 50_000, "<h1>" * 30_000 + "</x>" * 30_000, "<p " + "a" * 200_000 + ">x", "<b>x" * 50_000])
def test_time_is_linear(page):
    began = time.monotonic()
    assert isinstance(html_extract.main_text(page)[0], str)
    assert time.monotonic() - began < 10


def article_of(page):
    """Brute force for the pages of testdata: what stands in <article>, block by block, without tags."""
    inside = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)[^>]*>", re.sub(r"<br>", " ", inside))
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts) if t)


def test_pages(spark, monkeypatch):
    """All pages of sf0.01 give their article; with scores that are all the same no page does."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        assert r.text == article_of(source[r.page_id]) and r.n_chars == len(r.text)
    for name in ("NOT_TEXT", "NOT_NAMES", "NOT_ROLES", "SURE_CLASSES", "SURE_OUTSIDE"):
        monkeypatch.setattr(html_extract, name, frozenset({"head"}))
    assert sum(html_extract.main_text(p)[0] == article_of(p) for p in source.values()) >= 0.5 * len(source)
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "path_scores", lambda paths, *rest: np.ones(len(paths)))
    assert not any(html_extract.main_text(p)[0] == article_of(p) for p in source.values())
    odd = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", "y"), (2, "u", "<p>z", "y")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_extract.extract(odd).orderBy("page_id").collect()] == ["", "", "", "z"]
    assert html_extract.extract(odd.limit(0)).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 %% 3", None), (-3, "", None), (None, "the of and", None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs.union(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left")
    rows = got.collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id in (-1, -2, -3)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(odd.where("doc_id = -3")).first().lang_pred == "und"
    kept = language_id.recognised(docs.union(odd))
    assert kept.where("doc_id >= 0").count() == docs.count() and kept.where("doc_id < 0").count() == 0


def test_filters_return_all_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    filters = language_id.fit(docs)
    assert sorted(filters.languages) == ["de", "en", "es", "fr"] and (filters.false_rate < 0.05).all()
    h = language_id.grams("the and tion ")
    masks = filters.masks(h)
    assert all(int(m) & 1 << filters.languages.index("en") for m in masks[0][:3])


def test_more_than_64_languages(spark):
    """Every language is learned and predicted, held-out rows included; without any lang all rows with a letter stay."""
    import random

    rng = random.Random(5)
    letters = [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz")
    words = {k: ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(40)] for k in range(80)}
    rows = [(i, " ".join(rng.choices(words[i % 80], k=60)), f"l{i % 80}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len({r.lang_pred for r in got.values()}) == 80
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 200 and sum(got[i].lang_pred == f"l{i % 80}" for i in held) >= 0.99 * len(held)
    unknown = docs.limit(3).withColumn("lang", F.lit(None).cast("string")).union(spark.createDataFrame([(9, "1 2", None), (8, None, None)], docs.schema))
    assert language_id.recognised(unknown).count() == 3


def test_unrecognised_documents_go(spark):
    """Gibberish of other letters goes, all of sf0.01 stays."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(20).withColumn("text", F.lit("щжцч ъъэю жжщц " * 30)).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.recognised(docs.unionByName(odd))
    assert kept.where("doc_id < 0").count() == 0 and kept.count() == docs.count() and kept.columns == docs.columns


def test_toxicity(spark):
    """Held-out recall and false alarms; nulls, empty texts, null ids, repeats and an empty table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    auc = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert auc > 0.93
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (2, "", 5.0), (None, "you idiot", 5.0)], "doc_id long, text string, score double")
    got = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got if r.doc_id) and all(0 <= r.score <= 1 and not r.held_out for r in got if r.doc_id is None)
    kept = toxicity.clean(odd.withColumn("predicted", F.lit(7)), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "score", "predicted"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]
    assert toxicity.toxicity(odd.limit(0), labels).count() == toxicity.clean(odd.limit(0), labels.limit(0)).count() == 0


SAID = {"you are an idiot": 1, "this idiot of theirs": 1, "idiot": 1, "i will kill you": 1, "not an idiot": 0, "he said idiot": 0, "never call an idiot": 0, "a killer idea": 0, "kill time": 0}


def test_grammar_decides(spark, monkeypatch):
    """The same words are toxic or not by the clause they stand in; without the grammar's transducers they would all be."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SAID)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, none).collect()}
    assert [got[i] for i in range(len(SAID))] == list(SAID.values())
    reader = toxicity.Reader({})
    assert toxicity.clause_scores("he said idiot. You idiot! Fine. Ugly", reader) == ([(0.0, 0, 1), (3.0, 1, 0)], 4)
    monkeypatch.setattr(toxicity, "GRAMMAR", {k: (k[0], k[1]) for k in toxicity.GRAMMAR})
    model = toxicity.Model({}, np.array([1.0, 2.0, 0.0, 0.0, -0.5, 0.0, -2.0]))
    flat = [int(model.score(np.array([toxicity.features(t, reader)]))[0] >= 0.5) for t in SAID]
    assert flat != list(SAID.values())


def normal(rows):
    return sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_imatch(spark):
    got = imatch.imatch(spark.read.parquet(f"{DATA}/documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.execute(ORACLE_SQL["op10_imatch"])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert normal(tuple(r) for r in got.select(*names).collect()) == normal(rows)
    near = got.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()[0]
    assert near > 0.85


def test_imatch_ids_far_apart(spark, monkeypatch):
    """One far id puts all others into one range of ids; it is divided until buckets are small, and nothing else changes."""
    words = "one two three four five six seven eight nine ten".split()
    rows = [(i, " ".join(words[(i * k) % 10] for k in range(1, 2 + i % 9))) for i in range(600)] + [(2**62 + 5, "far away"), (-(2**63), "far below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, imatch.imatch(docs).collect()))
    monkeypatch.setattr(imatch, "BUCKET", 20)
    ids, span = docs.select("doc_id"), 1 << 60
    divided = imatch.divisions(ids, len(rows), span)
    assert [w for _, w in divided] == [1 << 50, 1 << 40, 1 << 30, 1 << 20, 1 << 10, 1]
    assert imatch.with_buckets(ids, span, divided).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 80
    assert sorted(map(tuple, imatch.imatch(docs).collect())) == want and len(want) == 602
    nexts = {r.doc_id: r.next_text for r in imatch.with_next(docs).where("ghost = 0").collect()}
    ordered = sorted(rows)
    assert nexts == {a[0]: b[1] for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}


def test_imatch_edges(spark):
    rows = [(5, None, 1), (9, "a b c", 2), (1, "a b c", 3), (9, "z", 4), (None, "q r s t", 5), (10**15, "é" * 7, 6)]
    got = imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()
    assert len(got) == 6 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.fingerprint for r in got if r.n_chars == 5}
    assert len(same) == 1
    assert imatch.imatch(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = imatch.imatch(spark.createDataFrame([(3, "only one here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>My title of words</h1><div>By Ann</div><p>{long}</p></article>", "My title of words\nBy Ann\n{long}"),
        ("<article><h2>One</h2><ul><li>First</li></ul><h2>Two</h2><blockquote>Said so.</blockquote><p>{long}</p></article>", "One\nFirst\nTwo\nSaid so.\n{long}"),
        ("<body><form id='form1'><main><p>Words of a page, in a form.</p></main><button>Go</button></form></body>", "Words of a page, in a form."),
        ("<body><form><h1>Title</h1><p>Words of a page, in a form without main.</p><input></form></body>", "Title\nWords of a page, in a form without main."),
        ("<article><p>Words of the article, whole.</p></article><form><p>Leave a comment, please do so.</p></form>", "Words of the article, whole."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <svg><text>no</text></svg>always.</p></article>", "So x=2 holds, always."),
        ("<article><p>Press <button>Save</button> to go on, please.</p><button>Share</button></article>", "Press Save to go on, please."),
        ("<article><p class='hidden md:block'>Shown on wide screens.</p><p class=hidden>Never.</p><p>More.</p></article>", "Shown on wide screens.\nMore."),
    ],
)
def test_pages_stay_whole(page, text):
    long = "A sentence of words, and some more of them. " * 150
    assert html_extract.main_text(page.replace("{long}", long))[0] == text.replace("{long}", long.strip())
