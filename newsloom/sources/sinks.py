"""Tables the flow writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by a column of few values.

    The rebalance hint gathers each value's rows before writing and lets adaptive execution
    split a value that holds much of the data, so files are neither tiny nor one per value.
    """
    df.hint("rebalance", column).write.mode(mode).partitionBy(column).parquet(path)


def write_articles(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_partitioned(articles, path, "category", mode)


def write_training_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_partitioned(pairs, path, "split", mode)


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Request rows as JSON lines, for any offline batch service."""
    prompts.write.json(path)


def write_cache_version(cache: DataFrame, root: str, version: int) -> str:
    """A new version of the summary cache; readers keep the old one until it is complete."""
    path = f"{root.rstrip('/')}/version={version}"
    cache.write.mode("overwrite").parquet(path)
    return path


def read_partitioned(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(column, F.col(column).cast("string"))
