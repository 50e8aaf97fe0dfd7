"""Packing by concatenation and cutting.

Pass one encodes each document once and records its place in its partition's stream; prefix sums over
the partitions' totals give global places; pass two cuts the global stream at multiples of the window.
A document that crosses a cut has a record in each of its windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import column, in_batches, slices, table, texts_of, written
from quillspark.llm.tokens import encoder, vocabulary_path

WINDOW = 1024
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """part, doc_id, at (ids before it in its part), n_tokens, wide (4 bytes an id, else 2), ids."""
    vocab = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, enc = TaskContext.get().partitionId(), 0, encoder(vocab)
        for whole in batches:
            for batch in slices(whole):
                ids = enc.encode(column(batch, "text").to_pylist())
                n = [len(x) // enc.dtype.itemsize for x in ids]
                at = np.cumsum([total, *n])
                total = int(at[-1])
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), column(batch, "doc_id"), pa.array(at[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([enc.dtype.itemsize == 4] * k), pa.array(ids, pa.binary())], names=["part", "doc_id", "at", "n_tokens", "wide", "ids"])

    return in_batches(texts_of(docs), run, "part int, doc_id long, at long, n_tokens long, wide boolean, ids binary", lambda: encoder(vocab).forget())


def cut(placed: DataFrame, window: int) -> DataFrame:
    """The pieces of documents placed at `begin` in the global stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, begin, wide, raw in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "begin", "wide", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype="<u4" if wide else "<u2").astype("<u4")
                a = 0
                while a < len(ids):
                    sequence, offset = divmod(begin + a, window)
                    b = min(len(ids), a + window - offset)
                    rows.append((doc, a, b - a, zlib.crc32(ids[a:b]), len(ids), sequence, offset))
                    a = b
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=PIECES)

    return in_batches(placed, run, ", ".join(f"{f.name} long" for f in PIECES))


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every sequence but the last of the corpus is full, so no id is padding. A null or empty text is the
    end id alone; a text longer than a window goes through several; rows that repeat a doc_id are packed each; an empty table gives no rows; extra columns
    are ignored.
    """
    ids = written(encoded(docs, vocabulary), "packing-ids")
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row a partition of the scan, both in the window over all and in the broadcast
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    return cut(ids.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("begin"), "wide", "ids"), window)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8_packing: every document is there, its pieces are all of it, and every sequence but the last
    is full without gaps."""
    pieces = op8_packing(spark, sf_dir)
    docs = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.count(F.when(F.col("start") == 0, 1)).alias("first"))
    docs = docs.agg(F.count("*").alias("documents"), F.count(F.when((F.col("n") != F.col("all")) | (F.col("first") != 1), 1)).alias("incomplete"))
    by = Window.partitionBy("sequence_id").orderBy("offset")
    follows = pieces.withColumn("end", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(by), F.lit(0)))
    per = follows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.when(F.col("end") != F.col("offset"), 1)).alias("gaps"))
    full = per.agg(F.sum("gaps").alias("gaps"), F.count(F.when(F.col("n") < WINDOW, 1)).alias("short"), F.count(F.when(F.col("n") > WINDOW, 1)).alias("long"))
    both = docs.unionByName(full, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("documents", "incomplete", "gaps", "short", "long")))
    return both.select("documents", "incomplete", F.coalesce("gaps", F.lit(0)).alias("gaps"), (F.col("short") > 1).alias("padded"), F.col("long").alias("overfull"))


ORACLE_SQL: dict[str, str] = {"packing_invariants": "SELECT count(*) AS documents, 0 AS incomplete, 0 AS gaps, false AS padded, 0 AS overfull FROM documents"}
QUERIES = {"op8_packing": op8_packing, "packing_invariants": packing_invariants}
