"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The encoding of a prefix ends in exactly one token; what precedes that token is the encoding of the shorter prefix. So the last
token of each prefix says everything: a trie node keeps it, and its children extend it. A token t may follow the last token s of
the rest just when merging the symbols of s and t together gives s and t again, because no merge then ever crosses the boundary.
Words that share a prefix share its nodes, and each node is computed once per batch.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import CACHES, PLAIN, byte_alphabet, only, own_worker, text_batches


class TrieBpe:
    """Encoder for a tokenizer file whose model is plain BPE (no dropout, no byte fallback)."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.name = {v: k for k, v in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_alphabet()
        self.plain = self.end and "'s|" in json.dumps(spec["pre_tokenizer"]) and "Lowercase" in json.dumps(spec["normalizer"])
        self.most = most
        self.follows: dict[tuple[str, str], bool] = {}
        #: Bytes of the id of each token; the empty string has none.
        self.packed = {k: struct.pack("<I", v) for k, v in self.vocab.items()} | {"": b""}
        self.chunks: dict[bytes, tuple[bytes, str]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges by rank, the leftmost first; only for the few symbols of two tokens."""
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 30:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        """The characters of a token; the mark of a word's end belongs to the last of them."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def may_follow(self, last: str, token: str) -> bool:
        key = (last, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > self.most:
                self.follows.clear()
            if last:
                known = self.merged(self.symbols(last) + self.symbols(token)) == [last, token]
            else:
                known = self.merged(self.symbols(token)) == [token]
            self.follows[key] = known
        return known

    def last_token(self, word: str, n: int, states: list[str], end: str) -> tuple[int, str]:
        """(where it begins, last token) of word[:n], whose shorter prefixes have the last tokens `states` (the empty prefix first).

        Exactly one token may end a prefix, so the likely ones are tried first: the last one made longer, then a new one. A symbol that
        the vocabulary lacks has no token: the empty string stands for it, as the library drops it.
        """
        vocab, follows = self.vocab, self.follows
        likely = n - 1 - len(states[n - 1])
        for k in (likely, *range(n - 1, max(0, n - self.longest) - 1, -1)):
            token = word[k:n] + end
            if token in vocab:
                known = follows.get((states[k], token))
                if known or known is None and self.may_follow(states[k], token):
                    return k, token
        return n - 1, ""

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words (already in the model's alphabet), as little-endian unsigned 32-bit integers.

        Words in order are their trie in depth-first order: the path to a word is its predecessor's up to the prefix they share, and the
        states and encodings of the nodes on it stand on the stack. Each node below is computed once, from the nodes above it.
        """
        out: dict[str, bytes] = {}
        states, codes = [""], [b""]
        before, end, packed = "", self.end, self.packed
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], codes[shared + 1 :]
            # With a mark of the word's end the last symbol is told from the same one inside a word, so its node is only made for longer words.
            inner = len(word) - 1 if end else len(word)
            for n in range(shared + 1, inner + 1):
                k, token = self.last_token(word, n, states, "")
                states.append(token)
                codes.append(codes[k] + packed[token])
            if end:
                k, token = self.last_token(word, len(word), states, end)
                out[word] = codes[k] + packed[token]
                before = word[: max(shared, inner)]
            else:
                out[word] = codes[len(word)]
                before = word
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.tok.decoder is None:
            return " ".join(self.name[i] for i in ids)
        return self.tok.decode(list(ids), skip_special_tokens=False)

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Words in the model's alphabet, and special strings (marked) as the library's default takes them."""
        if self.plain and (m := PLAIN.fullmatch(text)):
            words = [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
            return [(w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes), False) for w in words]
        out: list[tuple[str, bool]] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((part, True))
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                words = self.tok.pre_tokenizer.pre_tokenize_str(norm) if self.tok.pre_tokenizer else [(norm, ())]
                out.extend((w, False) for w, _ in words)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text.

        Where the tokenizer drops white space and joins decoded tokens by a space, whatever stands between white space is encoded
        once per worker (of more than `most` entries only those at hand stay); otherwise a text is one unit.
        """
        by_chunk = self.tok.decoder is None and "Replace" in str(self.tok.normalizer or "")
        parts = [((t.encode("utf-8", "surrogatepass").split() if by_chunk else [t.encode("utf-8", "surrogatepass")]) if t else []) for t in texts]
        seen = set().union(*parts) if parts else set()
        if len(self.chunks) > self.most:
            self.chunks = {c: self.chunks[c] for c in seen if c in self.chunks}
        table = self.chunks if by_chunk else {}
        new = list(seen.difference(table))
        if new:
            split = [self.split(c.decode("utf-8", "surrogatepass")) for c in new]
            words = self.encode_words({w for s in split for w, special in s if not special and w})
            names = self.name
            for c, s in zip(new, split, strict=True):
                code = b"".join([struct.pack("<I", self.special[w]) if special else words.get(w, b"") for w, special in s])
                ids = struct.unpack(f"<{len(code) // 4}I", code)
                table[c] = code, " ".join([names[i] for i in ids]) if self.tok.decoder is None else self.decode(ids)
        out = []
        for p in parts:
            got = [table[c] for c in p]
            out.append((b"".join(g[0] for g in got), " ".join(g[1] for g in got if g[1])))
        return out


@lru_cache(maxsize=2)
def trie_bpe(path: str) -> TrieBpe:
    return TrieBpe(path)


CACHES.append(trie_bpe.cache_clear)

def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids binary of little-endian unsigned 32-bit integers, decoded string) of every row.

    Null and empty texts give no ids and an empty decoded text; equal rows stay equal rows; a null id stays null; other columns
    are ignored. Texts are encoded whole, a bounded number of characters at a time, without any shuffle.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("trie")
        bpe = trie_bpe(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in text_batches(texts, 6_000_000):
                got = bpe.encode(texts[part])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=[id_col, "token_ids", "decoded"])

    rows = only(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{id_col}` {kind}, token_ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of encode_decode()'s rows."""
    return encoded.select(F.col(id_col), (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


__all__ = ["TrieBpe", "digests", "encode_decode"]
