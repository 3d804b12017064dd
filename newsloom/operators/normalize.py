"""Raw feed entries to article rows. All map-only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.dates import published_at
from newsloom.functions.text import blank_to_null, clean_html, strip


def title_of(title: Column) -> Column:
    return clean_html(F.coalesce(title, F.lit(config.DEFAULT_TITLE)))


def description_of(summary: Column, description: Column) -> Column:
    """First non-empty of the two, cleaned whole and only then cut."""
    raw = F.coalesce(blank_to_null(summary), blank_to_null(description), F.lit(""))
    return F.substring(clean_html(raw), 1, config.DESCRIPTION_CHARS)


def url_of(link: Column, links: Column) -> Column:
    return F.coalesce(blank_to_null(link), F.get(links, F.lit(0))["href"], F.lit(""))


def normalize_entries(entries: DataFrame, as_of: datetime) -> DataFrame:
    """Entries to articles; `as_of` stands in for missing publish times."""
    return entries.select(
        "feed_ord",
        "entry_ord",
        title_of(F.col("title")).alias("title"),
        description_of(F.col("summary"), F.col("description")).alias("description"),
        url_of(F.col("link"), F.col("links")).alias("url"),
        "source",
        published_at(F.col("published"), F.col("updated"), F.lit(as_of)).alias("published"),
    )


def with_empty_enrichment(articles: DataFrame) -> DataFrame:
    """The columns later phases fill, as typed nulls."""
    return articles.withColumns({
        "category": F.lit(None).cast("string"),
        "confidence": F.lit(None).cast("double"),
        "summary": F.lit(None).cast("string"),
    })


def classification_text(title: Column, description: Column) -> Column:
    """Title plus the head of the description; null when there is no title."""
    head = F.substring(F.coalesce(description, F.lit("")), 1, config.CLASSIFY_CHARS)
    return strip(F.concat(title, F.lit(". "), head))
