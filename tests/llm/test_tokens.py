"""Encoders against the library, counts, packing and shard files against brute force; nulls, empties and extremes."""

import hashlib
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from rankforge.llm import arrow_output, bpe_trie, packing, token_counts
from rankforge.llm.common import PieceEncoder, fresh_path, tokenizer_path

TEXTS = [
    "don't  stop\n\n now <|endoftext|> x  <|endoftext|>y", "", None, "a \xa0\n b", "  lead", "trail  \n", "İstanbul Ångström é ﬁ ﬃ 漢字テスト 😀👍🏽 ½²³ ٣٤", "x" * 3000,
    "<|startoftext|>hi", "Á ΣΑΣ \t\ttab", "we'll they're 'S It'S", "word word, word. words; the theme thematic", "\x1c a\x1fb  c", "é" * 500 + " " + "Straße.", "%%% the*** of&&&", "A" + "ab " * 6000,
]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def library(name):
    tok = Tokenizer.from_file(tokenizer_path(name))
    return tok, [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("most", [5, 1_000_000])
def test_encoders(name, most):
    tok, want = library(name)
    pieces, trie = PieceEncoder(tokenizer_path(name), most), bpe_trie.TrieBpe(tokenizer_path(name), most)
    for _ in range(2):
        assert pieces.encode(TEXTS) == [packed(w) for w in want]
        got = trie.encode(TEXTS)
        assert [g[0] for g in got] == [packed(w) for w in want]
        assert [g[1] for g in got] == [tok.decode(w, skip_special_tokens=False) for w in want]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 7), (3, "a \xa0\n b", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, digest string")


def test_trie_rows(docs, none):
    tok, want = library("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe_trie.digests(bpe_trie.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))).collect()}
    for i, ids in enumerate(want):
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert None in got and bpe_trie.encode_decode(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_counts(spark, docs, none):
    _, want = library("word_bpe_49k.json")
    cache = token_counts.fresh_cache(spark)
    for _ in range(2):
        got = token_counts.count_tokens(docs, tokenizer_path("word_bpe_49k.json"), cache, drops_space=True).collect()
        assert len(got) == len(TEXTS) + 2
        assert all(r.n_tokens == len(want[r.doc_id]) and r.n_bytes == len((TEXTS[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count()
    assert token_counts.count_tokens(none, tokenizer_path("word_bpe_49k.json"), cache, drops_space=True).count() == 0
    other = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), cache, drops_space=False).where("doc_id = 0").first()
    assert other.n_tokens == len(library("byte_bpe_50k.json")[1][0])


def test_shards(spark, docs, none):
    _, want = library("word_bpe_49k.json")
    folder = fresh_path(spark, "test-shards")
    manifest = arrow_output.write_sequences(docs, folder, tokenizer_path("word_bpe_49k.json"), length=16, batch_rows=4)
    got = {r.doc_id: r for r in arrow_output.read_documents(spark, manifest, folder).collect()}
    at = got[None].n_tokens
    for i, ids in enumerate(want):
        ids = [*ids, 1]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(packed(ids)))
        assert got[i].start == at or i == 3
        at += len(ids) * (2 if i == 3 else 1)
    shard = manifest.first()
    reader = arrow_output.ShardReader(folder, shard.shard)
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 16 and mask[0].as_py()
    empty = arrow_output.write_sequences(none, fresh_path(spark, "no-shards"), tokenizer_path("word_bpe_49k.json"))
    assert arrow_output.read_documents(spark, empty, folder).count() == 0


def test_packing(spark, docs, none):
    _, want = library("byte_bpe_50k.json")
    pieces, placed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 64)
    rows = [r for r in placed.collect()]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        if r.doc_id is not None:
            ids = [*want[r.doc_id], 1]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(packed(ids[r.start : r.start + r.length]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(r.length for r in rows if r.doc_id is not None) == sum(len(w) + 1 for w in want) + len(want[3]) + 1
    assert packing.pack_documents(none, tokenizer_path("byte_bpe_50k.json"), 64)[1].count() == 0
    whole = {r.sequence_id: r.ids for r in packing.fill_sequences(pieces, placed).collect()}
    assert {s: len(ids) for s, ids in whole.items()} == {s: 4 * sum(p.length for p in parts) for s, parts in by_sequence.items()}
    for r in rows:
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_patterns_are_near_the_bound():
    demand = {c: 50 + c % 7 for c in range(1, 65)}
    patterns = packing.solve(demand, 64)
    used = {}
    for p, times in patterns:
        assert sum(c * n for c, n in p.items()) <= 64
        for c, n in p.items():
            used[c] = used.get(c, 0) + n * times
    assert used == demand
    least = sum(c * n for c, n in demand.items()) / 64
    assert sum(t for _, t in patterns) <= 1.02 * least + 2


def test_short_documents(spark, none):
    """Pieces of one token fill sequences to the last place, and stand in whole ones beside long pieces."""
    rows = spark.range(5000).selectExpr("id as doc_id", "0L as start", "1L as length", "1L as doc_tokens", "1L as ids_crc32")
    placed = packing.pack(rows).collect()
    assert len(placed) == 5000 and len({(r.sequence_id, r.offset) for r in placed}) == 5000
    assert {r.sequence_id for r in placed} == {0, 1, 2}
    mixed = spark.range(3000).selectExpr("id as doc_id", "0L as start", "1 + pmod(id * 37, 500) as length", "1L as doc_tokens", "1L as ids_crc32").cache()
    got = packing.pack(mixed).collect()
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    total = mixed.agg({"length": "sum"}).first()[0]
    assert len(got) == 3000 and max(filled.values()) <= 2048 and sum(filled.values()) == total
    assert len(filled) <= 1.02 * total / 2048 + 1


def test_hot_content(spark):
    """A text that a third of the rows have is counted once and reaches every row, also those with null ids."""
    rows = [(i if i % 5 else None, "the same words" if i % 3 == 0 else f"text {i}", "clash") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_digest string")
    tokenizer = tokenizer_path("word_bpe_49k.json")
    got = token_counts.count_tokens(docs, tokenizer, token_counts.fresh_cache(spark), drops_space=True).collect()
    tok = Tokenizer.from_file(tokenizer)
    want = sorted((-1 if i is None else i, len(t), len(tok.encode(t, add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    digests = docs.selectExpr("unhex(sha2(text, 256)) as content_digest")
    assert token_counts.hot_contents(digests, 1000).count() == 1


def test_hot_length(spark):
    pieces = spark.range(9000).selectExpr("id as doc_id", "0L as start", "40L as length", "40L as doc_tokens", "1L as ids_crc32")
    placed = packing.pack(pieces, 128)
    assert placed.groupBy("sequence_id").sum("length").where("`sum(length)` > 128").count() == 0
    assert placed.select("sequence_id").distinct().count() == 3000
