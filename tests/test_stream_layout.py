"""A stream's result does not depend on how its files fall into batches."""

from __future__ import annotations

from newsloom.operators import normalize
from newsloom.sources import tables
from newsloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_dedup_stream_keeps_every_url(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(4).write.parquet(f"{tmp_path}/four")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    urls = {}
    for layout, per_batch in (("one", None), ("four", 1)):
        rows = ingest.stream_table(spark, f"{tmp_path}/{layout}", docs.schema, per_batch)
        articles = normalize.normalize_entries(tables.document_entries(rows), tables.AS_OF)
        target = f"{tmp_path}/out-{layout}"
        ingest.append_stream(
            ingest.dedup_stream(articles).select("url"), target, f"{tmp_path}/state-{layout}"
        ).awaitTermination()
        urls[layout] = sorted(r["url"] for r in spark.read.parquet(target).collect())
    assert urls["one"] == urls["four"] and len(urls["one"]) == len(set(urls["one"])) > 0
