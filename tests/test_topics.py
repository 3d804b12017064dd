"""Scores against an independent, naive scorer that refits its corpus for every text."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import plan_of

from newsloom.lexicon import Lexicon, default_lexicon
from newsloom.operators import accuracy, topics
from newsloom.operators.backends import choose_backend, classify_with_backend, score_with

CASES = [
    ("Compiler bug found in firmware of router", "Technology"),
    ("Web browser adds stronger cryptography", "Technology"),
    ("Fibre optic broadband reaches villages", "Technology"),
    ("Microprocessor maker shrinks the transistor", "Technology"),
    ("Computer vision guides drone", "Technology"),
    ("Speech recognition replaces keyboard", "Technology"),
    ("Spacecraft telescope sends images", "Technology"),
    ("Search engine stores password hashes", "Technology"),
    ("Accountant finds hole in balance sheet", "Business"),
    ("Factory wages rise as freight recovers", "Business"),
    ("Mortgage insurance premium climbs", "Business"),
    ("Stock exchange welcomes joint venture", "Business"),
    ("Parliament uses veto after public inquiry", "Politics"),
    ("Goalkeeper joins handball and hockey camp", "Sports"),
    ("Orchestra and choir open museum exhibition", "Entertainment"),
]


def naive_scores(text, lexicon):
    stop = set(lexicon.stop_words)

    def terms(doc):
        words = [w for w in re.findall(r"\w\w+", doc.lower()) if w not in stop]
        return Counter(words + [" ".join(p) for p in zip(words, words[1:])])

    hits = [
        sum(len(p.split()) for p in lexicon.phrases.get(label, ()) if p in text.lower())
        for label in lexicon.labels
    ]
    keyword = [h / max(hits) for h in hits] if max(hits) else [1 / len(hits)] * len(hits)
    docs = [terms(text)] + [
        terms(" ".join(lexicon.phrases[l]) if l in lexicon.phrases else l) for l in lexicon.labels
    ]
    df = Counter(t for doc in docs for t in doc)
    vectors = [
        {t: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in doc.items()}
        for doc in docs
    ]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    cosine = [
        sum(w * v.get(t, 0) for t, w in vectors[0].items()) / (norms[0] * n) if norms[0] * n else 0.0
        for v, n in zip(vectors[1:], norms[1:])
    ]
    combined = [0.6 * k + 0.4 * c for k, c in zip(keyword, cosine)]
    exps = [math.exp((c - max(combined)) / 0.2) for c in combined]
    return hits, cosine, [e / sum(exps) for e in exps]


@pytest.fixture(scope="module")
def lexicon(spark):
    return default_lexicon()


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_scores_match_the_naive_scorer(spark, lexicon):
    rng = random.Random(7)
    pool = [w for words in lexicon.phrases.values() for p in words for w in p.split()]
    pool += ["the", "of", "said", "a", "zebra", "é", "naïve", "e-commerce", "x_1", "Ünal", "42"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(80)]
    texts += ["", "the of and", "ai", "series a series b", "AI ai Ai", "it's don't"]
    got = topics.score_text(texts_of(spark, texts), lexicon).orderBy("id").collect()
    for row in got:
        hits, cosine, scores = naive_scores(row["text"], lexicon)
        assert row["hits"] == hits
        assert row["cosine"] == pytest.approx(cosine, abs=1e-12)
        assert row["scores"] == pytest.approx(scores, abs=1e-12)
        assert sum(row["scores"]) == pytest.approx(1)


def test_terms_drop_short_and_stop_words_before_pairing(spark, lexicon):
    row = topics.add_term_counts(texts_of(spark, ["Series a series B of e-commerce"]), lexicon).first()
    assert {t["term"]: t["cnt"] for t in row["term_counts"]} == {
        "series": 2, "commerce": 1, "series series": 1, "series commerce": 1,
    }


def test_phrases_match_inside_words_once_each(spark, lexicon):
    row = topics.add_keyword_hits(texts_of(spark, ["drones drone search engine"]), lexicon).first()
    assert row["hits"][0] == 1 + 2


def articles(spark, rows):
    return spark.createDataFrame(rows, "id int, title string, description string")


def test_ties_go_to_the_first_label_and_failures_stay(spark, lexicon):
    rows = [(1, "zzz", ""), (2, None, "x"), (3, "zzz", None), (4, "the of", "")]
    got = {r["id"]: r for r in topics.classify_articles(articles(spark, rows), lexicon).collect()}
    for k in (1, 3, 4):
        assert got[k]["category"] == "Technology" and got[k]["confidence"] == 0.2
        assert [s["label"] for s in got[k]["all_scores"]] == list(lexicon.labels)
    assert got[2]["category"] == "Unknown"
    assert got[2]["confidence"] == 0.0 and got[2]["all_scores"] == []


def test_unknown_label_uses_its_name(spark, lexicon):
    custom = lexicon.with_labels(["Sports", "Weather"])
    (row,) = topics.classify_articles(articles(spark, [(1, "weather report", "")]), custom).collect()
    assert row["category"] == "Weather" and len(row["all_scores"]) == 2
    assert row["confidence"] == round(max(naive_scores("weather report.", custom)[2]), 4)


def test_labels_without_any_phrase_or_term(spark):
    bare = Lexicon(("a", "b"), {}, ())
    (row,) = topics.classify_articles(articles(spark, [(1, "text", "")]), bare).collect()
    assert row["category"] == "a" and row["confidence"] == 0.5


def test_quotes_and_backslashes_in_phrases(spark):
    odd = Lexicon(("a", "b"), {"a": ("it's \\d",), "b": ('say "x"',)}, ("it's", "b\\s"))
    (row,) = topics.classify_articles(articles(spark, [(1, 'He: say "x"', "")]), odd).collect()
    assert row["category"] == "b"


def test_labelled_cases(spark, lexicon):
    cases = spark.createDataFrame(
        [(k, t, "", e) for k, (t, e) in enumerate(CASES)],
        "case_id int, title string, description string, expected string",
    )
    predicted = topics.classify_articles(cases.drop("expected"), lexicon)
    scored = accuracy.score_cases(predicted, cases.select("case_id", "expected"), "case_id")
    (total,) = accuracy.accuracy(scored).collect()
    assert total["total"] == 15 and total["correct"] == 15 and total["accuracy"] == 1.0


def test_classification_needs_no_shuffle_and_filters_stay_cheap(spark, lexicon):
    df = topics.classify_articles(articles(spark, [(1, "a", "b")]), lexicon)
    assert "Exchange" not in plan_of(df)
    filtered = df.filter("category = 'Sports' and confidence > 0.5")
    assert plan_of(filtered).count("regexp_extract_all") == 1


def test_lexicon_from_tables(spark):
    labels = spark.createDataFrame([(1, "B"), (0, "A")], "label_ord int, label string")
    phrases = spark.createDataFrame(
        [("A", 1, "y"), ("A", 0, "x"), ("C", 0, "z")], "label string, keyword_ord int, keyword string"
    )
    got = Lexicon.from_tables(labels, phrases)
    assert got.labels == ("A", "B") and dict(got.phrases) == {"A": ("x", "y")}
    with pytest.raises(ValueError):
        Lexicon((), {})
    with pytest.raises(ValueError):
        Lexicon(("a",), {"a": tuple(str(k) for k in range(6000))})


def test_backend_choice(spark, lexicon, tmp_path):
    def load():
        def score(text, labels):
            if "bad" in text:
                raise RuntimeError("no")
            return {"labels": labels[::-1], "scores": [0.9] + [0.025] * (len(labels) - 1)}

        return score

    def broken():
        raise OSError("no model")

    assert choose_backend(spark, True, str(tmp_path), load) == "hybrid"
    assert choose_backend(spark, False, str(tmp_path), load) == "trained"
    assert choose_backend(spark, False, str(tmp_path / "none"), load) == "base"
    assert choose_backend(spark) == "hybrid"
    rows = articles(spark, [(1, "gpu", ""), (2, "bad", ""), (3, None, "")])
    got = {r["id"]: r for r in score_with(rows, load).collect()}
    assert got[1]["category"] == "Entertainment" and got[1]["confidence"] == 0.9
    assert got[2]["category"] == got[3]["category"] == "Unknown"
    why = {r["id"]: r["why"] for r in score_with(rows, load, error_column="why").collect()}
    assert why == {1: None, 2: "RuntimeError: no", 3: "no text"}
    for backend in ({"base_scorer": broken}, {"model_path": str(tmp_path)}):
        fallback = classify_with_backend(rows.filter("id = 1"), lexicon, **backend)
        assert fallback.first()["category"] == "Technology"
    assert set(score_with(rows, load).columns) == set(topics.classify_articles(rows, lexicon).columns)


def test_a_batch_that_fails_is_tried_text_by_text(spark, lexicon):
    def load():
        def score(texts, labels):
            if any("bad" in text for text in texts):
                raise RuntimeError(f"of {len(texts)}")
            if texts[0].startswith("short") and len(texts) > 1:
                return []
            return [{"labels": labels, "scores": [len(texts) / 10] + [0.0] * (len(labels) - 1)} for _ in texts]

        return score

    def run(titles, batch_size):
        rows = articles(spark, [(k, title, "") for k, title in enumerate(titles)]).coalesce(1)
        done = classify_with_backend(rows, lexicon, base_scorer=load, batch_size=batch_size, error_column="why")
        return {r["id"]: (r["category"], r["confidence"], r["why"]) for r in done.collect()}

    first = lexicon.labels[0]
    assert run(["a", "b", "c"], 2) == {0: (first, 0.2, None), 1: (first, 0.2, None), 2: (first, 0.1, None)}
    assert run(["a", "bad", None, "c"], 8) == {
        0: (first, 0.1, None), 1: ("Unknown", 0.0, "RuntimeError: of 1"),
        2: ("Unknown", 0.0, "no text"), 3: (first, 0.1, None),
    }
    assert run(["short", "b"], 8) == {0: (first, 0.1, None), 1: (first, 0.1, None)}
    assert set(classify_with_backend(articles(spark, [(1, "gpu", "")]), lexicon, error_column="why").columns) >= {"why"}
