import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import jaccard_join, language_id, media, toxicity
from rankforge.llm.common import materialise


def test_copies_are_found(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 200")
    rows = media.vector_copies(vectors).collect()
    asked = [i for i in range(0, 200, 20)]
    found = {r.query_id for r in rows if r.query_id == r.match_id}
    assert len(found) >= 0.9 * len(asked)
    assert sum(r.query_id != r.match_id for r in rows) <= 1


def test_table_join_recall(spark):
    """Pairs of descriptors within 7 bits share a table by the pigeonhole principle: the join finds each of them."""
    rng = np.random.default_rng(1)
    words = rng.integers(-(2**31), 2**31, (60, 8))
    near = words.copy()
    for r in near:
        for bit in rng.integers(0, 256, 6):
            v = (int(r[bit // 32]) & 0xFFFFFFFF) ^ (1 << int(bit % 32))
            r[bit // 32] = v - 2**32 if v >= 2**31 else v
    schema = f"id long, {media.FEATURES}"

    def rows(w, k):
        return spark.createDataFrame([(k, float(10 * i % 90), float(7 * i % 80), 1.0, 0.0, *map(int, x)) for i, x in enumerate(w)], schema)

    got = media.copies(rows(words, 1), rows(near, 2)).first()
    assert got.inliers >= 55 and got.rotation == 0


def test_media_edges(spark):
    rows = [(20, [1.0] * 64), (40, None), (60, []), (80, [None] * 4), (None, [1.0, 2.0]), (100, [float("inf")]), (120, [5.0])]
    assert media.vector_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
    assert media.vector_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_turned_image_keeps_its_descriptors():
    image = media.drawn(list(np.random.default_rng(4).normal(size=64)))
    a, b = media.describe(image), media.describe(np.rot90(image).copy())
    words = lambda f: np.array([x[4:] for x in f]).astype(">i4").view(np.uint8).reshape(len(f), -1)
    bits = np.unpackbits(words(a)[:, None, :] ^ words(b)[None, :, :], axis=2).sum(2)
    assert (bits.min(axis=1) < 40).mean() > 0.5


def test_halved_copy_is_found(spark):
    """A copy of half the size has levels near the image's; the old two levels had none."""
    image = media.resized(media.drawn(list(np.random.default_rng(4).normal(size=64))).astype(float), 2)
    sides = [spark.createDataFrame([(1, *map(float, f[:4]), *map(int, f[4:])) for f in media.describe(x)], f"id long, {media.FEATURES}") for x in (media.resized(image, 0.5), image)]
    got = media.copies(*sides).first()
    assert got is not None and abs(got.log_scale - 1) <= 0.5


def test_recall_by_edit(spark):
    """Shares of edited copies that are found among other images, and no other image is."""
    rng = np.random.default_rng(8)
    images = [media.drawn(list(v)) for v in rng.normal(size=(24, 64))]
    edits = {
        "crop": lambda x: media.edited(x),
        "noise": lambda x: np.clip(x + rng.normal(0, 3, x.shape), 0, 255).astype(np.uint8),
        "turn": lambda x: np.rot90(x).copy(),
        "brighter": lambda x: np.clip(x * 0.9 + 25, 0, 255).astype(np.uint8),
    }

    def frame(pictures):
        rows = [(i, *map(float, f[:4]), *map(int, f[4:])) for i, x in enumerate(pictures) for f in media.describe(x)]
        return spark.createDataFrame(rows, f"id long, {media.FEATURES}")

    corpus = materialise(frame(images), "test-corners")
    recall = {}
    for name, edit in edits.items():
        asked = frame([edit(x) for x in images]).collect()
        asked = materialise(spark.createDataFrame(asked, f"id long, {media.FEATURES}"), "test-queries")
        rows = media.copies(asked, corpus).collect()
        found = [(r.query_id, r.match_id) for r in rows]
        assert all(a == b for a, b in found)
        recall[name] = len(found) / len(images)
        pictures = spark.createDataFrame([(i, *x.shape, bytearray(x.tobytes())) for i, x in enumerate(images)], "id long, height int, width int, pixels binary")
        assert sorted(tuple(r) for r in media.copies_in(pictures, media.tables_of(asked)).collect()) == sorted(tuple(r) for r in rows)
    print("recall by edit", recall)
    assert min(recall.values()) >= 0.9, recall


@pytest.fixture()
def corpus(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    placed = corpus_pipeline.run(spark, corpus)
    kept = {r.doc_id for r in placed.select("doc_id").distinct().collect()}
    model = toxicity.fit(docs, labels)
    reader = toxicity.Reader(model.lexicon)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = {i: t for i, t in texts.items() if model.score(np.array([toxicity.features(t, reader)]))[0] < 0.5}
    rest = spark.createDataFrame([(i, t) for i, t in clean.items()], "doc_id long, text string")
    parts = jaccard_join.jaccard_components(rest, 5, 80).collect()
    assert kept == {r.component_id for r in parts}
    assert len(clean) > 0.85 * len(texts)


def test_stages_keep_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 60")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, corpus), f"test-{name.split()[0]}")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), corpus).count() == 0
    assert language_id.recognised(docs.limit(0)).count() == 0


def test_each_stage_rejects_what_is_planted(spark, corpus):
    """A toxic document, texts without a letter, and copies go, one stage each; what they were made of stays unless it goes itself."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.where("length(text) > 400").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{corpus}/labels.parquet").where("toxic = 1").collect()}
    bad = next(t for i, t in sorted(texts.items()) if i in toxic)
    marker = " ".join(f"{w}" for w in texts[min(set(texts) - toxic)].split()[:60])
    planted = [(10**6, marker), (10**6 + 1, marker), (10**6 + 2, " ".join([*marker.split()[:-1], "changed"])), (10**6 + 3, bad), (10**6 + 4, "12 345 . 6"), (10**6 + 5, None)]
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    lacking = [c for c in docs.columns if c not in rows.columns]
    for c in lacking:
        rows = rows.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    now = docs.unionByName(rows)
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = materialise(stage(spark, now, corpus), f"planted-{name.split()[0]}")
        gone[name] = before - {r.doc_id for r in now.select("doc_id").collect()}
    assert 10**6 + 3 in gone["toxicity"]
    assert {10**6 + 4, 10**6 + 5} <= gone["language ID"]
    assert {10**6 + 1, 10**6 + 2} <= gone["n-gram Jaccard join"]
    assert 10**6 not in gone["toxicity"] | gone["language ID"]
