"""Labelled rows for the classifiers: a bounded, repeatable sample of those that may be learned from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import column, in_batches, slices, texts_of

#: Every FOLDS-th document by checksum is held out of learning.
FOLDS = 5
#: Bytes of text that are described at once.
SLICE = 1 << 18


def is_held_out():
    """crc32 of the id as text, null as empty, modulo FOLDS is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, describe: Callable[[list[str]], list], kind: str) -> tuple[pa.ChunkedArray, np.ndarray]:
    """What `describe` makes of whole texts (a value of SQL type `kind` for each), and labels, of the `rows`
    labelled documents with the least checksums of their ids; of equal checksums the smaller id comes first.

    Texts are described on the executors and don't come to the driver. Rows with a null id, label or held-out
    id are never learned from; of labels that repeat an id the largest holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(~is_held_out())
    order = F.xxhash64("doc_id")
    n = known.count()
    if n > rows:
        # below this checksum lie more than `rows` but not many more, so that no task sorts all labels
        share = min(1.0, (rows + 10 * rows**0.5 + 100) / n)
        known = known.where(order <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))).orderBy(order, "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                found = describe(column(batch, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("doc_id", "y", "digest")] + [pa.array(found, types[kind])], names=["doc_id", "y", "digest", "found"])

    types = {"array<array<binary>>": pa.list_(pa.list_(pa.binary())), "array<double>": pa.list_(pa.float64())}
    texts = texts_of(docs).join(F.broadcast(known), "doc_id").select("doc_id", "y", F.sha2("text", 256).alias("digest"), "text")
    chosen = in_batches(texts, run, f"doc_id long, y int, digest string, found {kind}").toArrow()
    chosen = chosen.take(pa.compute.sort_indices(chosen, sort_keys=[("doc_id", "ascending"), ("digest", "ascending")]))
    return chosen.column("found"), chosen.column("y").to_numpy().astype(np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
