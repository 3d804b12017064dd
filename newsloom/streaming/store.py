"""An article store that a batch can look its URLs up in without reading all of it.

A batch writes one folder per bucket of URLs, `batch=<id>/bucket=<n>`, and beside the store a Bloom
filter for each of these folders. A later batch reads the folders only whose filter has one of its
URLs, so the files it opens follow from its own size, not from the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.backends import path_exists

BUCKETS = 64
# Bits of a filter and bits that a URL sets; more URLs in a folder only prune less.
FILTER_BITS = 1 << 16
PROBES = 4


def bucket_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def _places(url: Column) -> Column:
    """The bits of a URL, by double hashing."""
    mask = F.lit(FILTER_BITS - 1)
    first, step = (F.xxhash64(url, F.lit(part)).bitwiseAND(mask) for part in ("first", "step"))
    return F.array(*((first + step * k).bitwiseAND(mask) for k in range(PROBES)))


def _bit(place: Column) -> Column:
    """The bit of a place in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def filters_of(urls: DataFrame) -> DataFrame:
    """(bucket, words): a Bloom filter for each bucket of `urls`, as 64-bit words."""
    places = urls.select(bucket_of(F.col("url")).alias("bucket"), F.explode(_places(F.col("url"))).alias("_place"))
    place = F.col("_place")
    words = places.groupBy("bucket", F.shiftright(place, 6).cast("int").alias("word")).agg(
        F.bit_or(_bit(place)).alias("bits")
    )
    # At most FILTER_BITS / 64 words in a bucket.
    gathered = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    return gathered.select("bucket", F.transform(
        F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1)),
        lambda k: F.coalesce(F.try_element_at("set", k), F.lit(0).cast("long")),
    ).alias("words"))


def may_hold(urls: DataFrame, filters: DataFrame) -> DataFrame:
    """(batch, bucket) of the filters that have one of the URLs."""
    asked = urls.select(bucket_of(F.col("url")).alias("bucket"), _places(F.col("url")).alias("places")).distinct()
    hit = F.forall(
        "places", lambda p: F.get("words", F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0
    )
    return asked.join(filters, "bucket").filter(hit).select("batch", "bucket").distinct()


def _filter_root(target: str) -> str:
    return f"{target.rstrip('/')}_filters"


def write_batch(rows: DataFrame, target: str, batch_id: int) -> None:
    """Stores a batch and its filters; a repeated batch replaces itself."""
    folder = f"{target}/batch={batch_id}"
    bucketed = rows.withColumn("bucket", bucket_of(F.col("url")))
    bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    stored = rows.sparkSession.read.schema("url string").parquet(folder)
    filters_of(stored).write.mode("overwrite").parquet(f"{_filter_root(target)}/batch={batch_id}")


def folders_to_read(urls: DataFrame, target: str, batch_id: int) -> list[str]:
    """Folders of earlier batches that may hold one of the URLs; their names are all the driver gets."""
    spark = urls.sparkSession
    if not path_exists(spark, _filter_root(target)):
        return []
    filters = spark.read.schema("bucket int, words array<bigint>, batch long").parquet(_filter_root(target))
    found = may_hold(urls, filters.filter(F.col("batch") < batch_id)).collect()
    return sorted(f"{target}/batch={r['batch']}/bucket={r['bucket']}" for r in found)


def known_urls(urls: DataFrame, target: str, batch_id: int) -> DataFrame:
    """Those of `urls` that earlier batches have stored."""
    spark: SparkSession = urls.sparkSession
    folders = folders_to_read(urls, target, batch_id)
    if not folders:
        return urls.select("url").limit(0)
    stored = spark.read.schema("url string").parquet(*folders)
    return stored.join(urls.select("url").distinct(), "url", "left_semi")
