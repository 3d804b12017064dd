from datetime import datetime, timedelta, timezone

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from newsloom.operators.select import (
    dedup_text,
    dedup_url,
    head_n,
    in_category,
    newest_first,
    select_articles,
    top_n_articles,
    with_url,
)

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)
DAYS = (0, 1, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8)


@pytest.fixture
def mock(spark):
    rows = [
        (k // 4, k, f"title {k}", f"u{k}", AS_OF - timedelta(days=days, hours=4))
        for k, days in enumerate(DAYS)
    ]
    schema = "feed_ord int, entry_ord long, title string, url string, published timestamp"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_ties_keep_feed_and_entry_order(mock):
    assert [r["entry_ord"] for r in newest_first(mock).collect()] == list(range(12))


@pytest.mark.parametrize("n", [0, 1, 5, 12, 30])
def test_cap_counts_over_all_feeds(mock, n):
    assert [r["entry_ord"] for r in top_n_articles(mock, n).collect()] == list(range(min(n, 12)))


def test_top_n_is_a_heap_per_task(mock):
    assert "TakeOrderedAndProject" in plan_of(top_n_articles(mock, 5))


def test_dedup_keeps_first_over_feeds_and_is_idempotent(mock):
    doubled = mock.unionByName(mock.withColumn("feed_ord", F.col("feed_ord") + 5))
    blank = mock.withColumn("url", F.lit(""))
    once = select_articles(doubled.unionByName(blank), None)
    assert sorted((r["url"], r["feed_ord"]) for r in once.collect()) == sorted(
        (f"u{k}", k // 4) for k in range(12)
    )
    assert dedup_url(once).count() == 12
    assert with_url(blank).count() == 0


def test_hot_url_is_cut_before_the_shuffle(spark):
    rows = spark.range(0, 30000, 1, 8).select(
        F.lit(1).alias("feed_ord"), F.col("id").alias("entry_ord"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
    )
    kept = dedup_url(rows)
    assert kept.count() == 20001
    assert kept.filter("url = 'hot'").first()["entry_ord"] == 0
    plan = plan_of(kept)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_text_dedup_and_head_follow_row_order(spark):
    rows = [(5, "a"), (1, "b"), (3, "a"), (2, "c"), (4, "b")]
    kept = dedup_text(spark.createDataFrame(rows, "row_ord long, text string"))
    assert [(r["row_ord"], r["text"]) for r in head_n(kept, 2).collect()] == [(1, "b"), (2, "c")]


def test_category_tab(spark):
    df = spark.createDataFrame([("Sports",), ("Unknown",), (None,)], "category string")
    assert in_category(df, "Sports").count() == 1
    assert in_category(df, "All").count() == 3


def test_capped_flow(spark):
    """A heap per task, cut before page parsing; the rows equal the newest of the uncapped flow."""
    from newsloom.lexicon import default_lexicon
    from newsloom.plans.enrich import enrich_articles
    from newsloom.sources import tables

    sf_dir = "/root/testdata/sf0.001"
    inputs = (tables.entries(spark, sf_dir), tables.web_pages(spark, sf_dir), tables.responses(spark, sf_dir))
    capped = enrich_articles(*inputs, default_lexicon(), tables.AS_OF, 7)
    assert "TakeOrderedAndProject" in plan_of(capped)
    rows = enrich_articles(*inputs, default_lexicon(), tables.AS_OF)
    newest = rows.orderBy(F.col("published").desc(), "feed_ord", "entry_ord").limit(7)
    columns = ["url", "category", "confidence", "summary", "summary_source", "body_source"]
    assert capped.select(columns).collect() == newest.select(columns).collect()
    none = (inputs[0].limit(0), inputs[1].limit(0), inputs[2].limit(0))
    assert enrich_articles(*none, default_lexicon(), tables.AS_OF, 7).isEmpty()
    assert enrich_articles(*none, default_lexicon(), tables.AS_OF).isEmpty()
