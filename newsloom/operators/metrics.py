"""Counts and averages over enriched articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom import config
from newsloom.operators.select import ALL_TAB


def overview_metrics(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count("*").alias("articles"),
        F.count_distinct(F.coalesce(F.col("category"), F.lit("?"))).alias("categories"),
        F.avg(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("mean_confidence"),
        F.count("summary").alias("summaries"),
    ).withColumn("summarised", F.format_string("%d/%d", "summaries", "articles"))


def category_distribution(articles: DataFrame, width: int = config.BAR_WIDTH) -> DataFrame:
    """Articles per category, most common first, ties by the newest article; with a block bar.

    A bar has a block per article. Beyond `width` blocks all bars are scaled to that width.
    """
    newest = F.struct(
        (-F.unix_micros("published")).alias("t"), F.col("feed_ord"), F.col("entry_ord")
    )
    counted = articles.groupBy(
        F.coalesce(F.col("category"), F.lit(config.UNKNOWN)).alias("category")
    ).agg(F.count("*").alias("n_articles"), F.min(newest).alias("_first"))
    # One row per category is left here, so a window over all of them is small.
    top = F.max("n_articles").over(Window.partitionBy())
    scaled = F.ceil(F.col("n_articles") * F.lit(float(width)) / F.col("_top"))
    blocks = F.when(F.col("_top") <= width, F.col("n_articles")).otherwise(scaled)
    barred = counted.withColumn("_top", top).withColumn("bar", F.repeat(F.lit("█"), blocks.cast("int")))
    return barred.orderBy(F.col("n_articles").desc(), "_first").drop("_first", "_top")


def summary_source_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("summary_source").agg(F.count("*").alias("n_articles"))


def tab_counts(articles: DataFrame, labels: Sequence[str] = config.LABELS) -> DataFrame:
    """Count per category tab, empty tabs included, and All; one pass over the articles."""
    counts = [
        F.struct(
            F.lit(k).alias("tab_ord"), F.lit(label).alias("tab"),
            F.count_if(F.col("category") == label).alias("n_articles"),
        )
        for k, label in enumerate(labels)
    ]
    everything = F.struct(
        F.lit(len(labels)).alias("tab_ord"), F.lit(ALL_TAB).alias("tab"),
        F.count("*").alias("n_articles"),
    )
    word = F.when(F.col("n_articles") == 1, "article").otherwise("articles")
    return (
        articles.agg(F.array(*counts, everything).alias("tabs"))
        .select(F.inline("tabs"))
        .withColumn("count_word", word)
    )


def feed_ingest_report(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Per feed: entries, those without URL, repeats of an earlier entry, kept.

    Feeds that the registry has as enabled are listed with or without entries, feeds that it
    lacks when they have entries, as `unregistered`; disabled ones are left out.
    `articles` are normalised entries before selection. The first entry of each URL is found
    by one aggregation over narrow rows.
    """
    seen = articles.groupBy("feed_ord").agg(
        F.count("*").alias("retrieved"), F.count_if(F.length("url") == 0).alias("no_url")
    )
    firsts = (
        articles.filter(F.length("url") > 0)
        .groupBy("url")
        .agg(F.min(F.struct("feed_ord", "entry_ord")).alias("first"))
        .groupBy(F.col("first.feed_ord").alias("feed_ord"))
        .agg(F.count("*").alias("kept"))
    )
    zero = F.lit(0)
    counted = (
        feeds.withColumn("_registered", F.lit(True))
        .join(seen, "feed_ord", "full")
        .filter("_registered is null or enabled")
        .join(firsts, "feed_ord", "left")
        .select(
            "feed_ord", "source", "http_status", "_registered",
            F.coalesce("retrieved", zero).alias("retrieved"),
            F.coalesce("no_url", zero).alias("no_url"),
            F.coalesce("kept", zero).alias("kept"),
        )
    )
    blocked = F.coalesce(F.col("http_status"), zero) >= 400
    status = (
        F.when(F.col("_registered").isNull(), "unregistered")
        .when(blocked & (F.col("retrieved") == 0), "skipped")
        .when(F.col("retrieved") == 0, "empty")
        .when(blocked, "kept_despite_error")
        .otherwise("ok")
    )
    return counted.withColumns({
        "duplicates": F.col("retrieved") - F.col("no_url") - F.col("kept"),
        "status": status,
    }).drop("_registered")


def stage_row_counts(articles: DataFrame, enriched: DataFrame) -> DataFrame:
    """Rows entering and leaving each stage, and the paced time a model would need.

    `articles` are normalised entries before selection, `enriched` the final table.
    """
    urls = articles.groupBy("url").agg(F.count("*").alias("n"))
    used = F.length("url") > 0
    intake = urls.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("with_url"),
        F.count_if(used).alias("distinct_urls"),
    )
    output = enriched.agg(
        F.count("*").alias("articles"),
        F.count_if(F.col("category") != config.UNKNOWN).alias("classified"),
        F.count("summary").alias("summarised"),
    )

    def stage(k: int, name: str, rows_in: str, rows_out: str, seconds=F.lit(0).cast("long")):
        return F.struct(
            F.lit(k).alias("stage_ord"), F.lit(name).alias("stage"),
            F.col(rows_in).alias("rows_in"), F.col(rows_out).alias("rows_out"),
            seconds.alias("estimated_seconds"),
        )

    feed_stages = F.array(
        stage(0, "url_filter", "entries", "with_url"),
        stage(1, "dedup", "with_url", "distinct_urls"),
    )
    paced = F.col("articles") * config.SECONDS_PER_SUMMARY
    article_stages = F.array(
        stage(2, "classify", "articles", "classified"),
        stage(3, "summarise", "articles", "summarised", paced),
    )
    return intake.select(F.inline(feed_stages)).unionByName(output.select(F.inline(article_stages)))
