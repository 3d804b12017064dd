"""Display columns over enriched articles. All map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.text import escape_html, strip

BODY_NAMES = {config.FULL_ARTICLE: "Full article", config.FEED_DESCRIPTION: "RSS description"}
PREVIEW_TITLE_CHARS = 55
PREVIEW_DESCRIPTION_CHARS = 80


def percent_text(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= config.HIGH_CONFIDENCE, "high")
        .when(confidence >= config.MEDIUM_CONFIDENCE, "medium")
        .otherwise("low")
    )


def date_text(when: Column) -> Column:
    return F.coalesce(F.date_format(when, "dd MMM yyyy · HH:mm 'UTC'"), F.lit(""))


def article_report(articles: DataFrame) -> DataFrame:
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    body_name = F.lit("")
    for value, name in BODY_NAMES.items():
        body_name = F.when(F.col("body_source") == value, name).otherwise(body_name)
    from_model = F.col("summary_source") == config.FROM_MODEL
    return articles.select(
        "url",
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.coalesce(F.col("category"), F.lit(config.UNKNOWN)).alias("category"),
        confidence_band(confidence).alias("band"),
        percent_text(confidence).alias("confidence_text"),
        F.floor(confidence * 100).cast("int").alias("bar_percent"),
        date_text(F.col("published")).alias("date_text"),
        F.substring("title", 1, PREVIEW_TITLE_CHARS).alias("preview_title"),
        F.substring("description", 1, PREVIEW_DESCRIPTION_CHARS).alias("preview_description"),
        F.when(from_model, "★").otherwise("○").alias("summary_flag"),
        F.when(from_model, "Model").otherwise("Fallback").alias("summary_name"),
        body_name.alias("body_name"),
        F.split(F.coalesce(F.col("summary"), F.lit("")), "\n", -1).alias("summary_lines"),
    )


def score_breakdown(articles: DataFrame) -> DataFrame:
    """One row per article and label, best score first."""
    rows = articles.select("url", "category", F.posexplode("all_scores").alias("rank", "_s"))
    return rows.select(
        "url", "rank", "_s.label", "_s.score",
        F.floor(F.col("_s.score") * 100).cast("int").alias("bar_percent"),
        percent_text(F.col("_s.score")).alias("score_text"),
        (F.col("_s.label") == F.col("category")).alias("is_top"),
    )


def summary_paragraphs(articles: DataFrame) -> DataFrame:
    """One row per non-empty summary paragraph, escaped for HTML."""
    parts = F.transform(F.split("summary", "\n\n", -1), strip)
    rows = articles.select(
        "url", F.posexplode(F.filter(parts, lambda p: p != "")).alias("paragraph", "_text")
    )
    return rows.select("url", "paragraph", escape_html(F.col("_text")).alias("html"))
