"""Landed feed documents: RSS 2.0 and Atom files read by Spark's XML source.

A landing folder holds one sub-folder per feed, `feed_ord=<n>/source=<name>/`, with that feed's
files. The folder names become columns, so all feeds are read by one scan per format.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default and the optional feeds.
FEEDS = {
    "TechCrunch": "https://techcrunch.com/feed/",
    "The Verge": "https://www.theverge.com/rss/index.xml",
    "YourStory": "https://yourstory.com/feed",
}
OPTIONAL_FEEDS = {
    "Wired": "https://www.wired.com/feed/rss",
    "Ars Technica": "https://feeds.arstechnica.com/arstechnica/index",
    "MIT Tech Review": "https://www.technologyreview.com/feed/",
}

# Names without their name space: `updated` is atom:updated, `date` dc:date, `encoded` content:encoded.
RSS_SCHEMA = (
    "title string, link string, description string, pubDate string, updated string, date string, "
    "encoded string, guid struct<_VALUE:string, _isPermaLink:string>"
)
_TEXT = "struct<_VALUE:string, _type:string>"
ATOM_SCHEMA = (
    f"title {_TEXT}, link array<struct<_href:string, _rel:string>>, summary {_TEXT}, "
    f"content {_TEXT}, published string, updated string"
)
REGISTRY_SCHEMA = T.StructType([
    T.StructField("feed_ord", T.IntegerType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("feed_url", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
])
LINKS_TYPE = "array<struct<href:string,rel:string>>"


def feed_registry(
    spark: SparkSession,
    feeds: Mapping[str, str] | None = None,
    optional: Mapping[str, str] | None = None,
) -> DataFrame:
    """Feeds in order; `feeds` replaces the defaults, which bring the optional ones disabled."""
    if feeds is None:
        feeds, optional = FEEDS, OPTIONAL_FEEDS if optional is None else optional
    named = [(name, url, True) for name, url in feeds.items()]
    named += [(name, url, False) for name, url in (optional or {}).items()]
    rows = [(k, name, url, enabled) for k, (name, url, enabled) in enumerate(named)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def _read(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    columns = f"{schema}, feed_ord int, source string"
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True)
    # Partition columns must be part of an explicit schema.
    rows = reader.schema(columns).load(path)
    # Files are read whole and in order, so ids grow along the entries of a file.
    return rows.withColumn("entry_ord", F.monotonically_increasing_id())


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """`<item>` elements as raw entries.

    What an item leaves out or empty comes from its other elements: the link from a guid that is a
    permanent link, as it is unless it says otherwise, the description from the encoded content, the
    publish time from the date.
    """
    permanent = F.lower(F.coalesce("guid._isPermaLink", F.lit("true"))) != "false"
    return _read(spark, path, "item", RSS_SCHEMA).select(
        "feed_ord", "entry_ord", "source", "title",
        F.lit(None).cast("string").alias("summary"),
        F.coalesce(F.nullif("description", F.lit("")), "encoded", "description").alias("description"),
        F.coalesce(F.nullif("link", F.lit("")), F.when(permanent, F.col("guid._VALUE")), "link").alias("link"),
        F.lit(None).cast(LINKS_TYPE).alias("links"),
        F.coalesce(F.nullif("pubDate", F.lit("")), "date").alias("published"),
        "updated",
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """`<entry>` elements as raw entries; `link` is the first alternate one."""
    rows = _read(spark, path, "entry", ATOM_SCHEMA)
    alternates = F.filter(
        "link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"
    )
    links = F.transform("link", lambda l: F.struct(l["_href"].alias("href"), l["_rel"].alias("rel")))
    return rows.select(
        "feed_ord", "entry_ord", "source",
        F.col("title._VALUE").alias("title"),
        F.col("summary._VALUE").alias("summary"),
        F.col("content._VALUE").alias("description"),
        F.get(alternates, F.lit(0))["_href"].alias("link"),
        links.alias("links"),
        "published", "updated",
    )


def read_feeds(spark: SparkSession, rss_path: str, atom_path: str) -> DataFrame:
    return read_rss(spark, rss_path).unionByName(read_atom(spark, atom_path))


def from_enabled_feeds(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries of enabled feeds, with the registry's order; the registry is small by nature."""
    enabled = registry.filter("enabled").select("source", F.col("feed_ord").alias("_ord"))
    joined = entries.join(enabled, "source")
    return joined.withColumn("feed_ord", F.col("_ord")).drop("_ord").select(*entries.columns)


def _by_feed(rows: DataFrame) -> DataFrame:
    """Gathers a feed's rows so that it lands in few files; a very large feed is still split."""
    return rows.hint("rebalance", "feed_ord", "source")


def write_rss(entries: DataFrame, path: str) -> None:
    """Lands raw entries as RSS files, one folder per feed; the inverse of `read_rss`."""
    items = entries.select(
        "feed_ord", "source", "title", "link",
        F.coalesce("description", "summary").alias("description"),
        F.col("published").alias("pubDate"), "updated",
    )
    writer = _by_feed(items).write.format("xml").option("rootTag", "rss").option("rowTag", "item")
    writer.partitionBy("feed_ord", "source").save(path)


def write_atom(entries: DataFrame, path: str) -> None:
    """Lands raw entries as Atom files, one folder per feed."""
    link = F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel"))
    text = F.coalesce("summary", "description")
    rows = entries.select(
        "feed_ord", "source",
        F.struct(F.col("title").alias("_VALUE"), F.lit("text").alias("_type")).alias("title"),
        link.alias("link"),
        F.struct(text.alias("_VALUE"), F.lit("html").alias("_type")).alias("summary"),
        "published", "updated",
    )
    writer = _by_feed(rows).write.format("xml").option("rootTag", "feed").option("rowTag", "entry")
    writer.partitionBy("feed_ord", "source").save(path)
