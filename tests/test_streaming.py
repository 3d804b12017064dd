from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.operators.normalize import normalize_entries
from newsloom.streaming import ingest

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)
ENTRY = (
    "feed_ord int, entry_ord long, source string, title string, summary string, description string, "
    "link string, links array<struct<href:string,rel:string>>, published string, updated string"
)


def entries(spark, *rows):
    full = [(f, e, "s", t, None, None, u, None, when, None) for f, e, t, u, when in rows]
    return spark.createDataFrame(full, ENTRY).coalesce(1)


def test_batches_keep_the_first_of_each_url_and_replay_safely(spark, tmp_path):
    target, source = str(tmp_path / "out"), str(tmp_path / "in")
    start = lambda: ingest.enrich_stream(
        ingest.stream_table(spark, source, ENTRY), target, str(tmp_path / "cp"), AS_OF,
        lambda df: df.withColumn("category", F.lit("x")),
    )
    entries(spark, (1, 1, "late copy", "a", None), (0, 1, "first", "a", None), (0, 2, "no url", "", None)).write.parquet(source)
    start().awaitTermination()
    entries(spark, (0, 3, "again", "a", None), (0, 4, "new", "b", "1999-01-01")).write.mode("append").parquet(source)
    start().awaitTermination()
    read = lambda: {(r["url"], r["title"], r["batch"]) for r in spark.read.parquet(target).collect()}
    assert read() == {("a", "first", 0), ("b", "new", 1)}
    replay = ingest.ingest_batch(target, AS_OF, lambda df: df.withColumn("category", F.lit("x")))
    replay(entries(spark, (0, 3, "again", "a", None), (0, 4, "new", "b", "1999-01-01")), 1)
    assert read() == {("a", "first", 0), ("b", "new", 1)}


def test_watermarked_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(k % 3, k, f"t{k}", f"u{k % 7}", "2024-01-05T00:00:00Z") for k in range(50)] + [(0, 99, "x", "", None)]
    entries(spark, *rows).write.parquet(source)
    stream = normalize_entries(ingest.stream_table(spark, source, ENTRY, files_per_batch=1), AS_OF)
    query = ingest.append_stream(
        ingest.dedup_stream(stream).select("url"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination()
    got = [r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [f"u{k}" for k in range(7)]


def test_triggers():
    assert ingest.refresh_trigger() == {"processingTime": "30 minutes"}
    assert ingest.refresh_trigger(None) == {"availableNow": True}
