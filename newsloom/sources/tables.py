"""Adapters from the test tables to the inputs of the operators.

The URL of a document is a digest of its text, so that documents share one exactly if they are
copies; pages have their own. Responses and cached summaries join the articles that they belong to.
Remainders of row ids vary only where the link and the publish time of an entry are found.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)
STORY = "https://news.example/story/"
WEB_FEED = 1000
LINKS_TYPE = "array<struct<href:string,rel:string>>"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def event_time(row_id: Column) -> Column:
    """A minute within thirty days; three neighbouring ids share it."""
    minutes = F.floor(row_id / 3) * 7919 % 43200
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def story_url(text: Column) -> Column:
    return F.concat(F.lit(STORY), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def document_entries(docs: DataFrame) -> DataFrame:
    """Documents as feed entries; `docs` may be a stream."""
    doc_id = F.col("doc_id")
    link, when = doc_id % 17, doc_id % 13
    url, ts = story_url(F.col("text")), event_time(doc_id)
    mail = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")
    links = F.array(F.struct(url.alias("href"), F.lit("alternate").alias("rel")))
    return docs.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("feed_ord"),
        doc_id.alias("entry_ord"),
        "source",
        first_line(F.col("text")).alias("title"),
        F.when(doc_id % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("summary"),
        F.when(doc_id % 4 == 0, F.col("text")).alias("description"),
        F.when(link == 5, F.lit("")).when(link != 3, url).alias("link"),
        F.when(link.isin(3, 5), links).alias("links"),
        F.when(when == 0, F.lit("yesterday"))
        .when(when == 3, F.concat(mail, F.lit(" +0530")))
        .when(~when.isin(1, 2), F.concat(mail, F.lit(" GMT")))
        .alias("published"),
        F.when(when.isin(0, 1), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
    )


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of one feed: title element, whole page, host as source."""
    pages = load(spark, sf_dir, "pages")
    ts = event_time(F.col("page_id"))
    return pages.select(
        F.lit(WEB_FEED).alias("feed_ord"),
        F.col("page_id").alias("entry_ord"),
        F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("source"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.col("url").alias("link"),
        F.lit(None).cast(LINKS_TYPE).alias("links"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published"),
        F.lit(None).cast("string").alias("updated"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return document_entries(docs).unionByName(page_entries(spark, sf_dir))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", "url", "html")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, target_url): pages and documents in turn, numbered for the rows that refer to them."""
    docs, pages = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages")
    return pages.select((F.col("page_id") * 2).alias("target"), F.col("url").alias("target_url")).unionByName(
        docs.select((F.col("doc_id") * 2 + 1).alias("target"), story_url(F.col("text")).alias("target_url"))
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model attempts from all turns; conversations belong to pages and documents in turn.

    A fourth of the attempts failed, by conversation and turn. Conversations beyond the articles
    have a URL that no article has.
    """
    chat = load(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") * 3 + F.col("turn")) % 8
    rows = chat.select(
        "conv_id",
        F.floor((F.col("turn") + 1) / 2 + F.col("conv_id") % 4).cast("int").alias("attempt"),
        F.when(F.col("conv_id") % 4 < 2, F.lit("primary")).otherwise(F.lit("backup")).alias("model"),
        F.when(kind >= 4, F.concat(F.lit("## **Summary**\n\n- "), F.col("text")))
        .otherwise(F.concat(F.lit(" \n"), F.col("text")))
        .alias("response_text"),
        F.when(kind == 1, F.lit("HTTP 404: model not found"))
        .when(kind == 2, F.when(F.col("turn") > 2, F.lit("429 Too Many Requests")).otherwise(F.lit("connection reset")))
        .alias("error_text"),
    )
    unknown = F.concat(F.lit(STORY), F.col("conv_id").cast("string"))
    return rows.join(targets(spark, sf_dir), F.col("conv_id") == F.col("target"), "left").select(
        F.coalesce("target_url", unknown).alias("url"), "attempt", "model", "response_text", "error_text"
    )


def cached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary cache from the labelled documents; copies are versions of one summary."""
    docs = load(spark, sf_dir, "documents").select("doc_id", story_url(F.col("text")).alias("url"))
    return load(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "url",
        F.concat(F.lit("cached "), F.col("doc_id").cast("string")).alias("summary"),
        F.when(F.col("quality") == 1, "model").otherwise("fallback").alias("summary_source"),
        F.lit("rss_description").alias("body_source"),
        F.col("doc_id").alias("version"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline rows with the untidy column names of a CSV export."""
    docs = load(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    return docs.select(
        doc_id.alias("row_ord"),
        F.date_format(event_time(doc_id), "yyyyMMdd").alias(" Publish_Date"),
        F.concat("lang", F.lit("."), "source").alias("Headline_Category "),
        F.col("text").alias(" HEADLINE_TEXT"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry over the sources seen in the documents, with an HTTP status for each."""
    seen = load(spark, sf_dir, "documents").select("source").distinct()
    # A filter on it may also reach sources of other tables, by way of a join.
    feed_ord = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return seen.select(
        feed_ord.alias("feed_ord"),
        "source",
        F.concat(F.lit("https://feeds.example/"), "source").alias("feed_url"),
        F.lit(True).alias("enabled"),
        F.when(feed_ord % 5 == 1, 403).otherwise(200).alias("http_status"),
    )
