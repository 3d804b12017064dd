"""Filters, first-of-a-kind and newest-first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import config

ALL_TAB = "All"


def with_url(articles: DataFrame) -> DataFrame:
    return articles.filter(F.length("url") > 0)


def in_category(articles: DataFrame, category: str) -> DataFrame:
    """One category tab; rows without a known label show up under All only."""
    if category == ALL_TAB:
        return articles
    return articles.filter(F.col("category") == category)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in `order`.

    The rank filter lets Spark cut every map task's output to one row per key before the
    shuffle (WindowGroupLimit), so a key that holds much of the data sends at most one row per
    map task to its reducer.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedup_url(articles: DataFrame) -> DataFrame:
    return keep_first(articles, ["url"], ["feed_ord", "entry_ord"])


def dedup_text(headlines: DataFrame) -> DataFrame:
    return keep_first(headlines, ["text"], ["row_ord"])


def newest_order() -> list[Column]:
    """Newest first; equal times stay in feed order, then entry order."""
    return [F.col("published").desc(), F.col("feed_ord"), F.col("entry_ord")]


def newest_first(articles: DataFrame) -> DataFrame:
    return articles.orderBy(*newest_order())


def top_n_articles(articles: DataFrame, n: int = config.MAX_ARTICLES) -> DataFrame:
    """The newest `n` over all feeds together: per-task heaps, then one merge of `n` rows each."""
    return newest_first(articles).limit(n)


def head_n(headlines: DataFrame, n: int = config.MAX_HEADLINES) -> DataFrame:
    return headlines.orderBy("row_ord").limit(n)


def select_articles(articles: DataFrame, max_articles: int | None = None) -> DataFrame:
    """URL filter, dedup across feeds, then the newest `max_articles`; None keeps all."""
    kept = dedup_url(with_url(articles))
    return kept if max_articles is None else top_n_articles(kept, max_articles)
