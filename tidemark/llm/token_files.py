"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a run of zstandard frames, each the little-endian unsigned 32-bit ids of some consecutive
documents; a skippable frame with the index of documents (zstandard within); and a skippable frame with
the seek table of the public seekable format: (compressed size, size, checksum) for each frame, the
number of frames, a flag byte and a magic number. Any zstandard program can unpack it whole; a reader
that wants a few documents reads the trailer and only their frames.

Documents are range-partitioned by doc_id and each partition writes one file under a name of its
attempt, then renames it, so a task that is run again replaces its own file.

Defined cases: a null text is an empty one, of which the end id remains; a null doc_id sorts last and
stays null; repeated rows are written one by one; no rows give files without documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, Encoder, materialize, new_path, partitions, text_chunks

#: Fixed values of the public seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 16
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file; documents come in ascending order."""

    def __init__(self, stream, level: int = 3, frame_ids: int = FRAME_IDS):
        self.stream, self.zip, self.most = stream, zstandard.ZstdCompressor(level=level, write_checksum=True), frame_ids
        self.table, self.index, self.waiting, self.n = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.table), self.n, len(ids)))
        self.waiting.append(ids.astype("<u4").tobytes())
        self.n += len(ids)
        if self.n >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            data = b"".join(self.waiting)
            frame = self.zip.compress(data)
            self.stream.write(frame)
            self.table.append((len(frame), len(data), _checksum(data)))
            self.waiting, self.n = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zip.compress(np.array(self.index, _INDEX).tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in [*self.table, (len(index) + 8, 0, 0)])
        self.stream.write(struct.pack("<II", SEEK_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table) + 1, 0x80, SEEKABLE))


class Reader:
    """Random access to one file through a seekable stream: it reads the trailer, then frames on request."""

    def __init__(self, stream):
        self.stream, self.unzip = stream, zstandard.ZstdDecompressor()
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        stream.seek(size - 9 - 12 * n)
        self.table = [struct.unpack("<III", stream.read(12)) for _ in range(n)]
        self.at = np.concatenate([[0], np.cumsum([x[0] for x in self.table])]).tolist()
        stream.seek(self.at[-2] + 8)
        self.index = np.frombuffer(self.unzip.decompress(stream.read(self.table[-1][0] - 8)), _INDEX)

    def frame(self, k: int) -> np.ndarray:
        self.stream.seek(self.at[k])
        data = self.unzip.decompress(self.stream.read(self.table[k][0]), max_output_size=self.table[k][1])
        if len(data) != self.table[k][1] or _checksum(data) != self.table[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, "<u4")

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; only the frames that hold wanted documents are decompressed."""
        have, ids = -1, np.zeros(0, "<u4")
        for doc, known, k, a, n in self.index.tolist():
            if wanted is None or known and doc in wanted:
                if k != have:
                    have, ids = k, self.frame(k)
                yield doc if known else None, ids[a : a + n]


def write_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, files: int | None = None) -> DataFrame:
    """Write all documents to path in ascending doc_id order; returns (shard, file, n_docs, n_tokens)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = Encoder.of(tokenizer, True), TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/ids-{context.partitionId():06d}.zst"
        own, docs_n, ids_n = f"{name}.{context.taskAttemptId()}", 0, 0
        with store.open_output_stream(own) as stream:
            writer = Writer(stream)
            for batch in batches:
                for part in text_chunks(batch):
                    for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").fill_null("").to_pylist())):
                        writer.add(doc, np.append(ids, end_id))
                        docs_n, ids_n = docs_n + 1, ids_n + len(ids) + 1
            writer.close()
        store.move(own, name)
        yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "file": f"{path}/ids-{context.partitionId():06d}.zst", "n_docs": docs_n, "n_tokens": ids_n}])

    order = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("order")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order).repartitionByRange(files or 2 * partitions(docs.sparkSession), "order").sortWithinPartitions("order", F.col("doc_id").isNull(), "text")
    return materialize(dealt.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long"), "token-files")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                out, start = [], row["before"]
                with store.open_input_file(name) as stream:
                    for doc, ids in Reader(stream).documents():
                        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each file: a running sum over them is small
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    based = manifest.select("shard", "file", "n_docs", F.coalesce(before, F.lit(0)).alias("before")).where("n_docs > 0")
    return based.repartition(2 * partitions(manifest.sparkSession), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a short list of documents; other frames stay compressed."""
    wanted = set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, name = fs.FileSystem.from_uri(name)
                with store.open_input_file(name) as stream:
                    found = [{"doc_id": d, "ids": ids.tolist()} for d, ids in Reader(stream).documents(wanted)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return manifest.select("file").mapInArrow(read, "doc_id long, ids array<long>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_documents(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "ids")))
