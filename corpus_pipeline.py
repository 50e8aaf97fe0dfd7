"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and
read again. All but the last return the columns of documents, whatever they are.

An empty table passes through every stage; null and empty texts are documents like others; long texts are read
whole. Rows that share a doc_id stay or go together in the stages that decide by doc_id, and a row without a doc_id
is dropped by the classifier alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from quillspark.llm.shared import mark, paths_since, remove, table, without, written

#: Near duplicates: words of a shingle and percent of similarity.
SHINGLE, PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _losers(groups: DataFrame) -> DataFrame:
    """doc_ids of which no row is kept."""
    return groups.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("k")).where("k = 0")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return without(docs, _losers(exact_dedup.exact_groups(docs)), "exact-losers")


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest doc_id stays."""
    return without(docs, _losers(near_dedup.near_groups(docs, SHINGLE, PERCENT)), "near-losers")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span of a whole window of words with a benchmark item go. An item shorter than a window is no
    reason to drop a document, since a few words stand in clean ones too."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(F.exists("spans", lambda s: s[2] - s[1] >= decontaminate.WINDOW)), "contaminated")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: The classifier and the encoding can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's working tables and its input go when its result is written; what the last
    stage has written stays with the result."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        place = mark()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *working, result = paths_since(place)
        remove(spark, working + before)
        before = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
