"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from operator import attrgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.sources.stored import BATCH_ROWS, bounded_batches  # noqa: F401


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(known or 'file:///tmp/checkpoints/rankforge').rstrip('/')}/rankforge"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, free of whatever else the frame carries. A frame with two columns of a name is refused by Spark itself."""
    return df.select(*[F.col(c) for c in columns])


#: White space that a split at ASCII white space does not see, but the tokenizers may.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -​    　﻿᠎]")
#: Pieces that a byte-level pattern never joins: a run of other characters with the space before it, or a run of white space.
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII)


#: Pieces whose parts the pre-tokenizers are sure to cut here: letters of Latin-1, then a run of plain punctuation.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: The same for keys of tables, with any ASCII punctuation but the apostrophe and the <.
PLAIN_KEY = re.compile(r"([ \0]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@[-`{-~]*)")
MORE_THAN_LINES = re.compile(r"\n\n(?:\s|$)")
#: Before a word that no blank stands before, in keys of a byte-level table.
BARE = "\0"


ID = attrgetter("id")
FORMATS = [struct.Struct(f"<{n}I") for n in range(64)]


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class OddPieceError(Exception):
    """A key whose text cannot be cut at its blanks."""


class PieceTable(dict):
    """Ids by piece, made when a piece is first looked up, or taken over from an earlier table."""

    def __init__(self, make: Callable[[Any], bytes], earlier: dict):
        super().__init__()
        self.make, self.earlier = make, earlier

    def __missing__(self, piece: Any) -> bytes:
        ids = self.earlier.pop(piece, None)
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        return ids


class PieceEncoder:
    """Token ids of whole texts by the tokenizers library, which sees each distinct piece about once per worker.

    The two pre-tokenizers never match across the piece boundaries used here, so the ids of a text are those of its pieces
    in order. Texts with special strings, or rare white space that matters, go to the library whole. The memory is bounded: a table of
    half of `most` pieces (and those of one text) gives way to a new one, which takes over what is met again before it is full itself.

    Byte-level texts are cut at blanks and line feeds. A key is a word after a blank, BARE and a word after none, or a line feed. Where
    a key is empty or holds other white space, runs of white space have to be looked at, which `PIECES` does.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        # The library's threads would only compete with Spark's tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        assert all("<" in a for a in added), "special strings are looked for behind a <"
        #: With a white-space-dropping normaliser the pieces are plain runs between ASCII white space.
        self.drops_space = "Replace" in str(self.tok.normalizer or "")
        shown = byte_alphabet()
        self.blank = {" ": shown[32]}
        #: Letters beyond ASCII that PLAIN_KEY has, as byte-level vocabularies write them.
        self.letters = {i: "".join(shown[b] for b in chr(i).encode()) for i in range(192, 256)}
        self.tails: dict[str, bytes] = {}
        self.tokenize = self.tok.model.tokenize
        self.half, self.table = max(1, most // 2), PieceTable(self.of_bytes if self.drops_space else self.of_key, {})

    def model_ids(self, symbols: str) -> bytes:
        ids = self.tokenize(symbols if symbols.isascii() else symbols.translate(self.letters))
        n = len(ids)
        return (FORMATS[n] if n < len(FORMATS) else struct.Struct(f"<{n}I")).pack(*map(ID, ids))

    def of_plain(self, blank: str, word: str, tail: str) -> bytes:
        """Plain pieces go straight to the library's model, which is faster."""
        ids = self.model_ids(self.blank.get(blank, "") + (word.lower() if self.drops_space else word))
        if not tail:
            return ids
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.model_ids(tail)
        return ids + self.tails[tail]

    def of_piece(self, piece: str) -> bytes:
        m = PLAIN_KEY.fullmatch(piece)
        return self.of_plain(*m.groups()) if m and piece[:1] != BARE else self.whole([piece])[0]

    def of_bytes(self, piece: bytes) -> bytes:
        return self.of_piece(piece.decode("utf-8", "surrogatepass"))

    def of_key(self, key: str) -> bytes:
        if m := PLAIN_KEY.fullmatch(key):
            return self.of_plain(m[1] or " ", m[2], m[3])
        if key == BARE:
            return b""
        word = key[1:] if key[:1] == BARE else key
        if key != "\n" and (word.split() != [word] or ODD_SPACE.search(word)):
            raise OddPieceError
        return self.whole([word if word != key or key == "\n" else f" {key}"])[0]

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def text_ids(self, text: str) -> bytes:
        if self.special and "<" in text and self.special.search(text):
            return self.whole([text])[0]
        if self.drops_space:
            return b"".join(map(self.table.__getitem__, text.encode("utf-8", "surrogatepass").split()))
        # Of two line feeds before a word each is a piece; in longer white space, and at the end, the two are one.
        if BARE not in text and ("\n\n" not in text or not MORE_THAN_LINES.search(text)):
            with contextlib.suppress(OddPieceError):
                return b"".join(map(self.table.__getitem__, (BARE + text.replace("\n", f" \n {BARE}")).split(" ")))
        return self.whole([text])[0] if ODD_SPACE.search(text) else b"".join(map(self.of_piece, PIECES.findall(text)))

    def forget(self) -> None:
        self.table = PieceTable(self.table.make, {})

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text counts as empty."""
        out = []
        for t in texts:
            if len(self.table) >= self.half:
                self.table.earlier = {}
                self.table = PieceTable(self.table.make, self.table)
            out.append(self.text_ids(t) if t else b"")
        return out


@lru_cache(maxsize=2)
def piece_encoder(path: str, most: int = 1_000_000) -> PieceEncoder:
    """One encoder a Python worker; it lives as long as the worker does."""
    return PieceEncoder(path, most)


OWNER = [""]
#: What empties the tables that operators keep in a Python worker between tasks.
CACHES: list[Callable[[], None]] = [piece_encoder.cache_clear]


def own_worker(name: str) -> None:
    """Called as a task of an operator starts: tables that another operator left in this reused Python worker go."""
    if OWNER[0] != name:
        OWNER[0] = name
        for clear in CACHES:
            clear()
        give_back()


def give_back() -> None:
    """Returns what this Python worker has freed to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_batches(texts: Sequence[str | None], most_chars: int = 4_000_000) -> Iterable[slice]:
    """Slices of a batch that hold a bounded number of characters each (a longer text is a slice of its own)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most_chars:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))
