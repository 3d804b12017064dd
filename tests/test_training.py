import pytest
from pyspark.sql import functions as F

from newsloom import config
from newsloom.operators import model, training
from newsloom.sources.headlines import read_headlines

HEAD = "row_ord long, text string, category string"


def test_headline_columns_from_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text(
        " Publish_Date, Headline ,SECTION\n20240101,New app launched,city\n20240102,,x\n20240103,007,\n"
        "20240104,New app launched,tech\n20240105,Snow,weather\n"
    )
    raw = read_headlines(spark, str(tmp_path / "h.csv"))
    rows = training.resolve_headlines(raw).orderBy("row_ord")
    assert [(r["text"], r["category"]) for r in rows.collect()] == [
        ("New app launched", "city"), ("New app launched", "tech"), ("Snow", "weather"),
    ]
    assert [(r["text"], r["category"]) for r in training.topic_headlines(raw).collect()] == [
        ("New app launched", "city")
    ]
    with pytest.raises(ValueError, match="no category column"):
        training.resolve_headlines(raw.drop("SECTION"))
    with pytest.raises(ValueError, match="no headline"):
        training.topic_headlines(raw.filter("SECTION = 'weather'"), require_rows=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_headlines(spark, str(tmp_path / "none.csv"))


def test_topic_filter_by_category_or_text(spark):
    rows = [(1, "Big game", "Sci-Tech"), (2, "Visit today", "x"), (3, "visit", "x"), (4, "Said so", "y"), (5, "no", "no")]
    got = training.keyword_topic_filter(spark.createDataFrame(rows, HEAD))
    assert sorted(r["row_ord"] for r in got.collect()) == [1, 2, 4]
    got = training.keyword_topic_filter(spark.createDataFrame([(1, "hit it now", "x"), (2, "hits it", "x")], HEAD))
    assert [r["row_ord"] for r in got.collect()] == [1]


def test_pairs_split_and_hypothesis(spark):
    heads = spark.range(400).select(
        F.col("id").alias("row_ord"), F.concat(F.lit("head "), "id").alias("text"), F.lit("x").alias("category")
    )
    pairs = training.nli_pairs(heads)
    (counts,) = training.pair_class_counts(pairs).collect()
    assert counts.asDict() == {"positives": 400, "negatives": 1600, "total": 2000}
    split = training.train_val_split(pairs)
    assert split.count() == 2000
    assert 0.17 < split.filter("split = 'validation'").count() / 2000 < 0.23
    again = training.train_val_split(pairs.repartition(7))
    assert split.exceptAll(again).isEmpty()
    assert not split.exceptAll(training.train_val_split(pairs, seed=1)).isEmpty()
    by_text = training.train_val_split(pairs, by=["text"]).groupBy("text").agg(F.count_distinct("split").alias("n"))
    assert by_text.filter("n > 1").isEmpty()
    row = training.with_hypothesis(pairs.filter("category = 'Sports'")).first()
    assert row["hypothesis"] == "This text is about Sports." and row["label"] == config.PAIR_NEGATIVE


def test_balanced_sample_caps_each_class(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("t"), "id").alias("text"),
        F.when(F.col("id") < 2900, "Technology").otherwise("Sports").alias("category"),
    )
    pairs = training.nli_pairs(rows, target=F.col("category")).select("text", "category", "label")
    got = {(r["category"], r["label"]): r["count"] for r in
           training.balanced_sample(pairs, 50).groupBy("category", "label").count().collect()}
    assert got[("Technology", 2)] == 50 and got[("Sports", 0)] == 50 and len(got) == 7
    assert training.balanced_sample(pairs, 50).exceptAll(training.balanced_sample(pairs.repartition(5), 50)).isEmpty()
    few = training.balanced_sample(pairs, 500).filter("category = 'Sports' and label = 2")
    assert few.count() == 100


def test_category_rules_take_the_first_match(spark):
    rows = [(1, "a", "Tech-Sport"), (2, "b", "sport"), (3, "c", "none")]
    rules = {"Technology": ("tech",), "Sports": ("sport",)}
    got = training.map_categories(spark.createDataFrame(rows, HEAD), rules)
    assert {r["row_ord"]: r["category"] for r in got.collect()} == {1: "Technology", 2: "Sports"}


def test_model_is_trained_saved_and_used(spark, tmp_path):
    words = {"Technology": "chip code server", "Sports": "goal match league"}
    rows = [(f"{w} {k}", label) for k in range(30) for label, text in words.items() for w in text.split()]
    data = spark.createDataFrame(rows, "text string, category string").coalesce(2)
    fitted = model.train_classifier(data, max_iter=5)
    measured = model.evaluate_classifier(fitted, data)
    assert measured["accuracy"] == 1.0 and measured["log_loss"] < 0.5
    model.save_model(fitted, str(tmp_path / "m"))
    articles = spark.createDataFrame(
        [(1, "goal in the league", ""), (2, "server code", ""), (3, None, "")], "text int, title string, description string"
    )
    got = {r["text"]: r for r in model.classify_with_model(articles, model.load_model(str(tmp_path / "m"))).collect()}
    assert got[1]["category"] == "Sports" and got[2]["category"] == "Technology"
    assert len(got[1]["all_scores"]) == len(config.LABELS) and got[3]["category"] == "Unknown"
