"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of the digests, one per partition, merge into at most `counters` candidates; an
exact count verifies them, and the winners are broadcast so that the rows of very common texts are
settled where they are. Only the digests of all other rows are shuffled.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import checkpointed, in_batches, table, texts_of

#: Counters of a summary: the size of the broadcast, and (as 1/counters of the rows) the largest group that is shuffled.
COUNTERS = 1024


def misra_gries(counts: Counter, more: Counter, k: int) -> Counter:
    """Merge `more` into a summary of at most k counters; no count falls short by more than rows / (k + 1)."""
    counts.update(more)
    if len(counts) > k:
        cut = heapq.nlargest(k + 1, counts.values())[-1]
        counts = Counter({d: c - cut for d, c in counts.items() if c > cut})
    return counts


def heavy_candidates(digests: DataFrame, k: int) -> DataFrame:
    """digest, for at most k digests; every digest with more than rows / (k + 1) rows is among them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts = misra_gries(counts, Counter(batch.column(0).to_pylist()), k)
        yield pa.RecordBatch.from_pydict({"digest": list(counts), "n": list(counts.values())}, schema=pa.schema([("digest", pa.binary()), ("n", pa.int64())]))

    parts = in_batches(digests.select("digest"), summarise, "digest binary, n long")
    merged = parts.groupBy("digest").agg(F.sum("n").alias("n"))
    top = checkpointed(merged.orderBy(F.desc("n"), "digest").limit(k + 1))
    cut = top.agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    return top.where(F.col("n") > cut["n"]) if cut["k"] > k else top


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all bytes are, however long; null is the empty text. The row with the largest doc_id of
    equal texts stays. Rows that repeat a doc_id with its text count each and all are marked kept if
    it stays; a row without an id is kept only where no equal text has one (keep_id is null then); an empty
    table gives no rows; extra columns are ignored.
    """
    digests = checkpointed(texts_of(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))
    candidates = heavy_candidates(digests, counters).select("digest")
    # at most `counters` rows, so both broadcasts have a fixed bound
    verified = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    heavy = checkpointed(verified.where("group_size > 1"))
    split = digests.join(F.broadcast(heavy), "digest", "left")
    common = split.where("keep_id is not null")
    rest = split.where("keep_id is null").select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = rest.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size").union(common.select("doc_id", "digest", "keep_id", "group_size"))
    return settled.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
