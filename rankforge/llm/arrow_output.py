"""Token ids as Arrow stream files: fixed-size lists of ids and masks, which any reader maps without copying."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import piece_encoder, text_batches

END_ID = 1


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    """Ids in the smallest unsigned type that holds the vocabulary, and a bit each for the mask."""
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def document_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequences(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of the schema's length of ids; the last is filled with zeros, where its mask is false."""
    length = schema.field("ids").type.list_size
    n = -(-len(ids) // length) * length
    padded = np.zeros(n, schema.field("ids").type.value_type.to_pandas_dtype())
    padded[: len(ids)] = ids
    flat = [pa.array(padded), pa.array(np.arange(n) < len(ids))]
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, type=schema.field(k).type) for k, x in enumerate(flat)], schema=schema)


class Shard:
    """One shard: sequences in batches of a bounded size, and beside them where each document lies."""

    def __init__(self, folder: str, number: int, schema: pa.Schema, rows: int, kind: pa.DataType):
        self.fs, root = file_system(folder)
        self.final = f"{root}/shard-{number:06d}"
        self.temp = f"{root}/.shard-{number:06d}-{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.files = [self.fs.open_output_stream(f"{self.temp}.{x}") for x in ("arrow", "docs.arrow")]
        self.schema, length = schema, schema.field("ids").type.list_size
        self.out = pa.ipc.new_file(self.files[0], schema)
        self.index = pa.ipc.new_file(self.files[1], document_schema(kind))
        self.length, self.most, self.kind = length, rows * length, kind
        self.held: list[bytes] = []
        self.n_held = self.total = self.docs = 0

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts)], schema=document_schema(self.kind)))
        self.total += int(counts.sum())
        self.docs += len(ids)
        self.held += ids
        self.n_held += int(counts.sum())
        if self.n_held >= self.most:
            self.flush(self.n_held // self.length * self.length)

    def flush(self, n: int) -> None:
        all_ids = np.frombuffer(b"".join(self.held), "<u4")
        for k in range(0, n, self.most):
            self.out.write_batch(sequences(all_ids[k : min(n, k + self.most)], self.schema))
        self.held, self.n_held = [all_ids[n:].tobytes()], len(all_ids) - n

    def close(self) -> None:
        if self.n_held:
            self.flush(self.n_held)
        for w, f, x in zip((self.out, self.index), self.files, ("arrow", "docs.arrow"), strict=True):
            w.close()
            f.close()
            self.fs.move(f"{self.temp}.{x}", f"{self.final}.{x}")


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, batch_rows: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes documents in ascending id order (null ids first, equal ids by text) into shards in `folder`, which all machines share.

    The ids of the shards, one after the other, are those of all documents, each followed by the end id; null texts are empty.
    Returns the manifest, one row a shard: shard, n_docs, n_tokens, start (tokens in the shards before). A file appears under its
    name only when whole, so a repeated task replaces it by the same content.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    in_order = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, encoder, shard = TaskContext.get().partitionId(), piece_encoder(tokenizer), None
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            if not b.num_rows:
                continue
            schema = sequence_schema(length, id_type(encoder.tok.get_vocab_size()))
            shard = shard or Shard(folder, number, schema, batch_rows, b.schema.field(0).type)
            texts = b.column(1).to_pylist()
            for part in text_batches(texts):
                shard.add(b.column(0).slice(part.start, part.stop - part.start), [x + end for x in encoder.encode(texts[part])])
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [number], "n_docs": [shard.docs], "n_tokens": [shard.total]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # One row a shard, so this list is bounded by the number of tasks.
    made = sorted(in_order.mapInArrow(write, "shard int, n_docs long, n_tokens long").collect())
    start, manifest = 0, []
    for m in made:
        manifest.append((m.shard, m.n_docs, m.n_tokens, start))
        start += m.n_tokens
    return spark.createDataFrame(manifest, "shard int, n_docs long, n_tokens long, start long")


class ShardReader:
    """Random access to a shard; on a local file system the arrays are views of the mapped file."""

    def __init__(self, folder: str, number: int):
        fs, root = file_system(folder)
        name = f"{root}/shard-{number:06d}"
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        with fs.open_input_file(f"{name}.docs.arrow") as f:
            self.documents = pa.ipc.open_file(f).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        sizes = [self.file.get_batch(i).num_rows * self.length for i in range(self.file.num_record_batches)]
        self.ends, self.held, self.arrays = np.cumsum(sizes), -1, None

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if k != self.held:
            b = self.file.get_batch(k)
            self.held, self.arrays = k, (b.column("ids").flatten().to_numpy(zero_copy_only=True), b.column("mask").flatten())
        return self.arrays

    def sequence(self, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence."""
        k = int(np.searchsorted(self.ends, row * self.length, "right"))
        at = row * self.length - (int(self.ends[k - 1]) if k else 0)
        ids, mask = self.batch(k)
        return ids[at : at + self.length], mask.slice(at, self.length)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, as views of one or more batches."""
        k = int(np.searchsorted(self.ends, start, "right"))
        while n > 0:
            at = start - (int(self.ends[k - 1]) if k else 0)
            part = self.batch(k)[0][at : at + n]
            yield part
            start, n, k = start + len(part), n - len(part), k + 1


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of write_sequences()."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = ShardReader(folder, number)
                for part in reader.documents.to_batches(max_chunksize=10_000):
                    crcs = []
                    for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for ids in reader.span(start, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(np.asarray(part.column("start")) + base)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), starts, part.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "start")
    tasks = max(1, min(10_000, shards.count()))
    return shards.repartition(tasks).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
