"""Page bodies, summary requests and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.markup import clean_summary, fallback_summary
from newsloom.functions.pages import page_body
from newsloom.functions.text import contains_any, strip
from newsloom.operators.select import keep_first
from newsloom.session import small_batches


def extract_body(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the page source by `body`, its main text cut to 8,000 characters, or null.

    Pages reach the Python workers few at a time, so that these hold no more of a larger table.
    """
    small_batches(pages.sparkSession)
    return pages.withColumn("body", page_body(F.col(html))).drop(html)


def page_bodies(pages: DataFrame) -> DataFrame:
    """`url, body`, one row per URL that has a text.

    Extraction comes before the shuffle on `url`, so raw page source never crosses the network.
    """
    usable = pages.filter(~F.col("url").isin("", "#"))
    bodies = extract_body(usable).filter(F.col("body").isNotNull())
    order = ["page_id", "body"] if "page_id" in pages.columns else ["body"]
    return keep_first(bodies, ["url"], order).select("url", "body")


def choose_body(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds `body, body_source`: the page text, else the description, else the title."""
    joined = articles.join(bodies.select("url", F.col("body").alias("_page")), "url", "left")
    description = F.nullif(strip(F.col("description")), F.lit(""))
    feed_text = F.coalesce(
        F.substring(description, 1, config.FEED_BODY_CHARS), strip(F.col("title")), F.lit("")
    )
    return joined.select(
        *articles.columns,
        F.coalesce(F.col("_page"), feed_text).alias("body"),
        F.when(F.col("_page").isNotNull(), config.FULL_ARTICLE)
        .otherwise(config.FEED_DESCRIPTION)
        .alias("body_source"),
    )


def build_prompts(articles: DataFrame) -> DataFrame:
    """Request rows for articles with a non-empty `body`."""
    source = F.coalesce(F.col("source"), F.lit(""))
    prompt = F.concat(
        F.when(source != "", F.concat(F.lit("Source: "), source, F.lit("\n"))).otherwise(""),
        F.lit("Title: "), F.coalesce(strip(F.col("title")), F.lit("")),
        F.lit("\n\nArticle:\n"), F.col("body"),
    )
    return articles.filter(F.length("body") > 0).select(
        "url", F.lit(config.INSTRUCTION).alias("instruction"), prompt.alias("prompt")
    )


def error_class(error: Column) -> Column:
    low = F.lower(error)
    return (
        F.when(contains_any(low, config.RATE_LIMIT_MARKS), "rate_limit")
        .when(contains_any(low, config.NOT_FOUND_MARKS), "model_not_found")
        .when(error.isNotNull(), "other")
    )


def attempt_error_classes(responses: DataFrame) -> DataFrame:
    failed = responses.filter(F.col("error_text").isNotNull())
    return failed.groupBy(error_class(F.col("error_text")).alias("error_class")).agg(
        F.count("*").alias("n_attempts")
    )


def resolve_responses(responses: DataFrame) -> DataFrame:
    """`url, attempt, response_text`: the first non-blank response of the allowed attempts.

    An article stops for good when the backup model is not found. Both facts come out of one
    aggregation with map-side combining, so repeated rows of one URL shrink before the shuffle.
    """
    allowed = responses.filter(F.col("attempt").between(1, config.MAX_ATTEMPTS))
    text = strip(F.col("response_text"))
    answered = F.col("error_text").isNull() & (text != "")
    stopped = (error_class(F.col("error_text")) == "model_not_found") & (
        F.col("model") == config.BACKUP_MODEL
    )
    per_url = allowed.groupBy("url").agg(
        F.min(F.when(answered, F.struct("attempt", text.alias("text")))).alias("first"),
        F.min(F.when(stopped, F.col("attempt"))).alias("stop"),
    )
    won = F.col("stop").isNull() | (F.col("first.attempt") < F.col("stop"))
    return per_url.filter(F.col("first").isNotNull() & won).select(
        "url", "first.attempt", F.col("first.text").alias("response_text")
    )


def summarize_articles(
    articles: DataFrame, bodies: DataFrame, resolved: DataFrame | None = None
) -> DataFrame:
    """Adds `summary, summary_source, body_source`; without responses all fall back.

    The joins share the articles' partitioning by `url`.
    """
    kept = [c for c in articles.columns if c not in ("summary", "summary_source", "body_source")]
    chosen = choose_body(articles.select(*kept), bodies)
    if resolved is None:
        answered = chosen.withColumn("_model", F.lit(None).cast("string"))
    else:
        texts = resolved.select("url", F.col("response_text").alias("_raw"))
        cleaned = F.nullif(clean_summary(F.col("_raw")), F.lit(""))
        answered = chosen.join(texts, "url", "left").withColumn(
            "_model", F.when(F.length("body") > 0, cleaned)
        )
    own_text = F.coalesce(
        F.nullif(strip(F.col("description")), F.lit("")), strip(F.col("title")), F.lit("")
    )
    return answered.select(
        *kept,
        F.coalesce(F.col("_model"), fallback_summary(own_text)).alias("summary"),
        F.when(F.col("_model").isNotNull(), config.FROM_MODEL)
        .otherwise(config.FROM_FALLBACK)
        .alias("summary_source"),
        "body_source",
    )
