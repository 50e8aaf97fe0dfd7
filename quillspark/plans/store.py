"""Tables that are used more than once: written in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        given = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table: made once, read column by column, and still there when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where they come from a scan of fewer splits and a costly pass follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Adaptive" in plan or df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
