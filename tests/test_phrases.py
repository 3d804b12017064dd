"""The phrase index against a scan of every phrase."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest

from newsloom.lexicon import default_lexicon
from newsloom.operators import topics
from newsloom.operators.phrases import phrase_hits, phrase_index


def plain_hits(texts, lexicon, match):
    def prepared(text):
        if match == "substring":
            return text.lower()
        return f" {re.sub(r'[^\w]+', ' ', text.lower()).strip()} "

    hits = Counter()
    for k, text in texts:
        for label, phrase in lexicon:
            if text is not None and phrase and phrase.strip() and prepared(phrase).strip():
                if prepared(phrase) in prepared(text):
                    hits[k, label] += len(phrase.split())
    return dict(hits)


@pytest.mark.parametrize("match", ["substring", "word"])
@pytest.mark.parametrize("seed", range(3))
def test_random_lexicons(spark, match, seed):
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choices("abcé -漢😀A", k=rng.randint(1, 6)))
    lexicon = [(rng.choice("XYZ"), piece()) for _ in range(80)] + [("X", "ab"), ("X", "ab"), ("Y", None), ("Y", " "), ("Z", "--")]
    texts = [(k, "".join(rng.choices("abcé -漢😀A.", k=rng.randint(0, 60)))) for k in range(120)] + [(997, None), (998, ""), (999, "a")]
    found = phrase_hits(
        spark.createDataFrame(texts, "gram long, phrase string"), spark.createDataFrame(lexicon, "label string, keyword string"),
        ["gram"], "phrase", match,
    )
    assert found.columns == ["gram", "label", "hits"]
    assert {(r["gram"], r["label"]): r["hits"] for r in found.collect()} == plain_hits(texts, lexicon, match)


def test_agrees_with_the_scan(spark):
    lexicon = default_lexicon()
    rows = [(label, p) for label, phrases in lexicon.phrases.items() for p in phrases]
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "substring(text, 1, 900) as text")
    scanned = topics.explode_labels(topics.add_keyword_hits(texts, lexicon).drop("text"), lexicon, "hits")
    found = phrase_hits(texts, spark.createDataFrame(rows, "label string, keyword string"), ["doc_id"])
    assert found.exceptAll(scanned.filter("hits > 0").select("doc_id", "label", "hits")).isEmpty()
    assert found.count() == scanned.filter("hits > 0").count()


def test_many_phrases(spark):
    """A hundred thousand phrases; the scan would compare each with every text."""
    words = spark.range(100_000).selectExpr("concat('L', id % 7) as label", "concat('w', lower(hex(id * 7919)), ' x') as keyword")
    texts = spark.range(500).selectExpr("id as k", "concat('some w', lower(hex(id * 7919)), ' x and more words ', id) as text")
    began = time.time()
    found = phrase_hits(texts, words, ["k"]).collect()
    assert time.time() - began < 120
    assert {r["k"] for r in found} == set(range(500)) and all(r["hits"] >= 2 for r in found)
    assert phrase_index(words).groupBy("phrase").count().filter("count > 1").isEmpty()


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        phrase_index(spark.createDataFrame([("a", "b")], "label string, keyword string"), "prefix")
