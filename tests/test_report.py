from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.operators import metrics, report

TS = datetime(2024, 1, 5, 9, 7, tzinfo=timezone.utc)
SCHEMA = (
    "feed_ord int, entry_ord long, url string, title string, description string, source string, "
    "published timestamp, category string, confidence double, "
    "all_scores array<struct<label:string,score:double>>, summary string, summary_source string, body_source string"
)


def enriched(spark):
    scores = [("Sports", 0.705), ("Politics", 0.295)]
    rows = [
        (0, 1, "a", "t" * 60, "d" * 90, "S", TS, "Sports", 0.705, scores, "one\n\n <b>&two</b> \n\n", "model", "full_article"),
        (0, 2, "b", "B", "", None, TS, "Politics", 0.5, [], None, "fallback", "rss_description"),
        (1, 3, "c", "C", "", "S", None, None, None, None, "x", None, "odd"),
        (1, 4, "d", "D", "", "S", TS, "Sports", 0.125, [], "y", "fallback", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_article_report(spark):
    got = {r["url"]: r for r in report.article_report(enriched(spark)).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["band"], b["band"], c["band"]) == ("high", "medium", "low")
    assert (a["confidence_text"], b["confidence_text"], d["confidence_text"]) == ("70%", "50%", "12%")
    assert a["bar_percent"] == 70
    assert a["date_text"] == "05 Jan 2024 · 09:07 UTC" and c["date_text"] == ""
    assert len(a["preview_title"]) == 55 and len(a["preview_description"]) == 80
    assert (a["summary_flag"], a["summary_name"], b["summary_flag"]) == ("★", "Model", "○")
    assert (a["body_name"], b["body_name"], c["body_name"], d["body_name"]) == (
        "Full article", "RSS description", "", "",
    )
    assert c["category"] == "Unknown" and b["source"] == ""


def test_breakdown_and_paragraphs(spark):
    rows = report.score_breakdown(enriched(spark)).orderBy("rank").collect()
    assert [(r["label"], r["bar_percent"], r["is_top"]) for r in rows] == [("Sports", 70, True), ("Politics", 29, False)]
    parts = report.summary_paragraphs(enriched(spark).filter("url = 'a'")).orderBy("paragraph").collect()
    assert [r["html"] for r in parts] == ["one", "&lt;b&gt;&amp;two&lt;/b&gt;"]


def test_metrics(spark):
    df = enriched(spark)
    (overall,) = metrics.overview_metrics(df).collect()
    assert overall["articles"] == 4 and overall["categories"] == 3 and overall["summarised"] == "3/4"
    assert abs(overall["mean_confidence"] - (0.705 + 0.5 + 0.125) / 4) < 1e-12
    spread = metrics.category_distribution(df.withColumn("published", F.coalesce("published", F.lit(TS))))
    assert [(r["category"], r["bar"]) for r in spread.collect()] == [("Sports", "██"), ("Politics", "█"), ("Unknown", "█")]
    scaled = metrics.category_distribution(df.withColumn("published", F.lit(TS)), width=1)
    assert {r["bar"] for r in scaled.collect()} == {"█"}
    tabs = {r["tab"]: (r["n_articles"], r["count_word"]) for r in metrics.tab_counts(df).collect()}
    assert tabs == {
        "Technology": (0, "articles"), "Business": (0, "articles"), "Politics": (1, "article"),
        "Sports": (2, "articles"), "Entertainment": (0, "articles"), "All": (4, "articles"),
    }
    assert {r[0]: r[1] for r in metrics.summary_source_counts(df).collect()} == {"model": 1, "fallback": 2, None: 1}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert metrics.overview_metrics(empty).first()["articles"] == 0
    assert {r["n_articles"] for r in metrics.tab_counts(empty).collect()} == {0}
    stages = metrics.stage_row_counts(empty, empty).collect()
    assert [r["rows_out"] for r in stages] == [0, 0, 0, 0]


def test_ingest_report(spark):
    feeds = spark.createDataFrame(
        [(0, "A", True, 200), (1, "B", True, 403), (2, "C", True, 404), (3, "D", True, 200), (4, "E", False, 200), (5, "F", True, None)],
        "feed_ord int, source string, enabled boolean, http_status int",
    )
    articles = spark.createDataFrame(
        [(0, 1, "x"), (0, 2, ""), (0, 3, "x"), (1, 1, "x"), (1, 2, "y"), (5, 1, "z"), (9, 1, "q"), (9, 2, "")],
        "feed_ord int, entry_ord long, url string",
    )
    got = {r["source"]: r for r in metrics.feed_ingest_report(feeds, articles).collect()}
    assert {k: (r["retrieved"], r["no_url"], r["duplicates"], r["kept"], r["status"]) for k, r in got.items()} == {
        "A": (3, 1, 1, 1, "ok"), "B": (2, 0, 1, 1, "kept_despite_error"), "C": (0, 0, 0, 0, "skipped"),
        "D": (0, 0, 0, 0, "empty"), "F": (1, 0, 0, 1, "ok"), None: (2, 1, 0, 1, "unregistered"),
    }
