"""Token files: Arrow files of fixed-size-list batches, for zero-copy random access to sequences and masks.

The corpus in doc_id order is one stream of ids. Each task writes its part of the stream as one file:
rows of exactly `seq_len` ids and a mask that is false on the padding of the file's last row. A row
of the manifest per document says where its ids lie. Files have names of their own until they are
whole, so that a repeated task leaves no half-written one behind, and the manifest lists only files
of tasks that succeeded.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import column, in_batches, new_path, slices, table, texts_of, written
from quillspark.llm.tokens import encoder, vocabulary_path

SEQ_LEN = 1024
#: Sequences of a record batch.
BATCH_ROWS = 64
MANIFEST = "file string, part int, doc_id long, at long, n_tokens long"


def file_schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class TokenWriter:
    """Appends ids and cuts them into equal rows."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int) -> None:
        self.dtype, self.seq_len = dtype, seq_len
        self.schema = file_schema(dtype, seq_len)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest: list[bytes] = []
        self.held = 0
        self.total = 0

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.held += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.held >= BATCH_ROWS * self.seq_len:
            self._flush(self.held // (BATCH_ROWS * self.seq_len) * BATCH_ROWS)

    def _flush(self, rows: int) -> None:
        flat = np.frombuffer(b"".join(self.rest), dtype=self.dtype)
        n = rows * self.seq_len
        real = min(n, len(flat))
        ids = np.zeros(n, dtype=self.dtype)
        ids[:real] = flat[:real]
        for a in range(0, rows, BATCH_ROWS):
            b = min(a + BATCH_ROWS, rows)
            part = pa.FixedSizeListArray.from_arrays(pa.array(ids[a * self.seq_len : b * self.seq_len]), self.seq_len)
            mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(a * self.seq_len, b * self.seq_len) < real), self.seq_len)
            self.out.write_batch(pa.RecordBatch.from_arrays([part, mask], schema=self.schema))
        self.rest = [flat[real:].tobytes()]
        self.held = len(flat) - real

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.seq_len))
        self.out.close()


class TokenFile:
    """Random access without copies: the file is mapped into memory where the store allows that."""

    def __init__(self, uri: str) -> None:
        self.source = open_input(uri)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.cached: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def batch(self, i: int) -> pa.RecordBatch:
        return self.reader.get_batch(i)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """ids (a view of the file) and mask of one row."""
        b = self.batch(row // BATCH_ROWS)
        k = row % BATCH_ROWS
        return b.column(0).slice(k, 1).flatten().to_numpy(), b.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, at: int, n: int) -> np.ndarray:
        """The ids at..at+n of the file's stream."""
        span = BATCH_ROWS * self.seq_len
        parts = []
        for i in range(at // span, -(-(at + n) // span)):
            if self.cached[0] != i:
                self.cached = (i, self.batch(i).column(0).flatten().to_numpy())
            parts.append(self.cached[1][max(0, at - i * span) : at + n - i * span])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)


def open_input(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)


def write_token_files(docs: DataFrame, out_dir: str, vocabulary: str | None = None, seq_len: int = SEQ_LEN, partitions: int | None = None) -> DataFrame:
    """Write the ids of docs in doc_id order under out_dir; returns the manifest
    (file, part, doc_id, at: first id in the file's stream, n_tokens with the end id).

    A null or empty text is the end id alone; rows that repeat a doc_id follow one another, in order of
    their texts, those without an id come first; a long text goes through several sequences; an empty table gives no rows. out_dir must be a folder that all machines share.
    """
    vocab = vocabulary_path(vocabulary)
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocab)
        where, folder = fs.FileSystem.from_uri(out_dir)
        where.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        out = None
        for whole in batches:
            for batch in slices(whole):
                if out is None:
                    sink = where.open_output_stream(f"{folder}/.{name}")
                    out = TokenWriter(sink, enc.dtype, seq_len)
                at, n = [], []
                for ids in enc.encode(column(batch, "text").to_pylist()):
                    at.append(out.total)
                    out.add(ids)
                    n.append(out.total - at[-1])
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([f"{out_dir}/{name}"] * k), pa.array([part] * k, pa.int32()), column(batch, "doc_id"), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["file", "part", "doc_id", "at", "n_tokens"])
        if out is not None:
            out.close()
            sink.close()
            where.move(f"{folder}/.{name}", f"{folder}/{name}")

    return written(in_batches(rows, run, MANIFEST, lambda: encoder(vocab).forget()), "token-manifest")


def part_starts(manifest: DataFrame) -> DataFrame:
    """part, base: ids in all parts before it. One row a part, so the window over all is as long as the number of files."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the ids that the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, TokenFile | None] = ("", None)
        for batch in batches:
            crcs = []
            for file, at, n in zip(column(batch, "file").to_pylist(), column(batch, "at").to_pylist(), column(batch, "n_tokens").to_pylist(), strict=True):
                if opened[0] != file:
                    opened = (file, TokenFile(file))
                crcs.append(zlib.crc32(opened[1].ids(at, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "part"), column(batch, "at"), column(batch, "n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    found = in_batches(manifest, run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    # a row a file: a few bytes for each, the number of shuffle partitions bounds it
    return found.join(F.broadcast(part_starts(manifest)), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "token-files")))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_token_files": op7_token_files}
