"""State of streams: first of each URL whatever the batches, and a store that is read in part."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.operators import normalize, select
from newsloom.sources import tables
from newsloom.streaming import ingest, store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, each twice under another feed, in no order."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    again = rows.withColumn("doc_id", F.col("doc_id") + 600).withColumn("source", F.lit("copies-7"))
    return rows.unionByName(again).orderBy(F.xxhash64("doc_id")).cache()


def articles(docs):
    return normalize.normalize_entries(tables.document_entries(docs), tables.AS_OF)


@pytest.mark.parametrize("files, per_batch, keep_ms", [(1, None, None), (6, 1, None), (5, 2, 3_600_000)])
def test_any_layout_gives_the_rows_of_dedup_url(spark, docs, tmp_path, files, per_batch, keep_ms):
    """The files come in two halves, with a restart of the query between them."""
    log, state = f"{tmp_path}/log", f"{tmp_path}/state"
    for half in (0, 1):
        part = docs.filter(F.col("doc_id") % 2 == half).repartition(files)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = articles(ingest.stream_table(spark, f"{tmp_path}/in", docs.schema, per_batch))
        rows = ingest.first_of_url_stream(stream, keep_ms)
        assert ingest.append_stream(rows, log, state, state_store=ingest.ROCKS_DB).awaitTermination(240)
    found = ingest.current_firsts(spark.read.parquet(log))
    expected = select.dedup_url(select.with_url(articles(docs)))
    assert found.count() == expected.count() and found.exceptAll(expected).isEmpty()
    assert spark.conf.get(ingest.STATE_STORE, None) != ingest.ROCKS_DB


def test_filters_have_all_their_urls_and_few_others(spark):
    urls = spark.range(3000).select(F.concat(F.lit("https://a/"), "id").alias("url"))
    filters = store.filters_of(urls).withColumn("batch", F.lit(0))
    assert store.may_hold(urls, filters).count() == store.BUCKETS
    for start in range(5000, 5040):
        one = spark.createDataFrame([(f"https://a/{start}",)], "url string")
        if start == 5000:
            plan = store.may_hold(one, filters)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan
    others = spark.range(5000, 5064).select(F.concat(F.lit("https://a/"), "id").alias("url"))
    assert store.may_hold(others, filters).count() <= 3


def test_a_batch_reads_the_folders_of_its_urls_only(spark, tmp_path):
    target = f"{tmp_path}/store"
    for batch in range(8):
        rows = spark.range(batch * 100, batch * 100 + 100).select(F.concat(F.lit("u"), "id").alias("url"))
        store.write_batch(rows, target, batch)
    asked = spark.createDataFrame([("u5",), ("u250",), ("new",), ("u799",)], "url string")
    folders = store.folders_to_read(asked, target, 8)
    assert 3 <= len(folders) <= 5 and all(f"batch={b}/" in " ".join(folders) for b in (0, 2, 7))
    assert sorted(r["url"] for r in store.known_urls(asked, target, 8).collect()) == ["u250", "u5", "u799"]
    assert sorted(r["url"] for r in store.known_urls(asked, target, 7).collect()) == ["u250", "u5"]
    assert store.known_urls(asked, f"{tmp_path}/none", 3).count() == 0


def test_time_of_the_batch(spark, tmp_path):
    entries = spark.createDataFrame(
        [(0, 1, "s", "t", None, None, "u", None, None, None)],
        "feed_ord int, entry_ord long, source string, title string, summary string, description string, "
        "link string, links array<struct<href:string,rel:string>>, published string, updated string",
    )
    times = []
    for batch, link in enumerate(("a", "b")):
        run = ingest.ingest_batch(f"{tmp_path}/out", None, lambda rows: rows)
        run(entries.withColumn("link", F.lit(link)), batch)
        times.append(spark.read.parquet(f"{tmp_path}/out/batch={batch}").first()["published"])
    assert times[0] < times[1]
