"""The summary cache: `url, summary, summary_source, body_source, version`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.select import keep_first

CACHE_COLUMNS = ("url", "summary", "summary_source", "body_source", "version")


def cache_key() -> Column:
    """The URL, or the title of an article without one."""
    return F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("title"))


def pending(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """Articles that still need a summary."""
    keys = cache.select(F.col("url").alias("_key"))
    return articles.join(keys, cache_key() == F.col("_key"), "left_anti")


def as_cache_rows(summarized: DataFrame, version: Column) -> DataFrame:
    return summarized.select(
        cache_key().alias("url"), "summary", "summary_source", "body_source",
        version.alias("version"),
    )


def merge(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest version per URL; a fresh row wins over a cached one of equal version."""
    both = cache.select(*CACHE_COLUMNS, F.lit(1).alias("_age")).unionByName(
        fresh.select(*CACHE_COLUMNS, F.lit(0).alias("_age"))
    )
    return keep_first(both, ["url"], [F.col("version").desc(), F.col("_age")]).drop("_age")


def with_cached_summary(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """Articles with their cached summary columns, null on a miss."""
    names = ("summary", "summary_source", "body_source")
    kept = [c for c in articles.columns if c not in names]
    rows = cache.select(F.col("url").alias("_key"), *names)
    return (
        articles.select(*kept).join(rows, cache_key() == F.col("_key"), "left").drop("_key")
    )
