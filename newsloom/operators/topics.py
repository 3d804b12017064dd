"""Topic scores from key phrases and TF-IDF similarity.

Every step is a projection over the article's own row: the lexicon is small configuration and
sits in the plan as folded literals, and an article's terms are counted inside an array instead
of being exploded and grouped. Scoring therefore costs no shuffle at any data size.

The TF-IDF model of an article is fitted on six short documents: its text and one per label.
Only the text changes between articles, so its terms raise the document frequency of label
terms by one and everything else is known up front. With `n` documents, term count `c`,
`tf(c) = 1 + ln c` and `idf(d) = ln((1 + n) / (1 + d)) + 1`:

* a term of the text found in `d` label documents weighs `tf(c) * idf(d + 1)`;
* `dot(label)` sums `tf(c) * a * idf(d + 1)**2` over shared terms, `a` being the label's tf;
* `norm(label)**2` is its fixed base plus `a**2 * (idf(d + 1)**2 - idf(d)**2)` per shared term.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.arrays import add_once, let
from newsloom.functions.terms import ngrams, one_of, run_counts, run_starts, tokens
from newsloom.lexicon import Lexicon
from newsloom.operators.normalize import classification_text

SCORES_TYPE = "array<struct<label:string,score:double>>"


def _tf(count: int) -> float:
    return 1.0 + math.log(count)


def _idf(n_docs: int, d: int) -> float:
    return math.log((1 + n_docs) / (1 + d)) + 1.0


class _LabelModel:
    """The label side of the closed form."""

    def __init__(self, lexicon: Lexicon):
        documents = lexicon.label_terms()
        n_docs = 1 + len(documents)
        self.new_term_weight = _idf(n_docs, 1)
        self.bases = [0.0] * len(documents)
        self.terms = sorted(set().union(*documents))
        entries = {}
        for term in self.terms:
            tfs = [_tf(doc[term]) if term in doc else 0.0 for doc in documents]
            d = sum(tf > 0 for tf in tfs)
            alone, shared = _idf(n_docs, d) ** 2, _idf(n_docs, d + 1) ** 2
            for k, tf in enumerate(tfs):
                self.bases[k] += tf * tf * alone
            entries[term] = {
                "d": d,
                "weight": _idf(n_docs, d + 1),
                "dots": [tf * shared for tf in tfs],
                "shifts": [tf * tf * (shared - alone) for tf in tfs],
            }
        self.entries_json = json.dumps(entries)
        self.phrases_json = json.dumps(
            [[{"kw": p, "w": w} for p, w in label] for label in lexicon.phrase_weights()]
        )

    # JSON text keeps the plan small while it is built; the optimizer folds it into one literal.

    def entries(self) -> Column:
        return F.from_json(
            F.lit(self.entries_json),
            "map<string, struct<d:int, weight:double, dots:array<double>, shifts:array<double>>>",
        )

    def phrases(self) -> Column:
        return F.from_json(F.lit(self.phrases_json), "array<array<struct<kw:string, w:double>>>")

    def knows(self, term: str) -> str:
        """SQL for a hash lookup of a term."""
        return one_of(term, self.terms)


@lru_cache(maxsize=32)
def _model(key: tuple) -> _LabelModel:
    labels, phrases, stop_words = key
    return _LabelModel(Lexicon(labels, dict(phrases), stop_words))


def _model_of(lexicon: Lexicon) -> _LabelModel:
    phrases = tuple((label, tuple(words)) for label, words in lexicon.phrases.items())
    return _model((lexicon.labels, phrases, tuple(lexicon.stop_words)))


def add_keyword_hits(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`hits`: per label, the word counts of its phrases that occur anywhere in the text."""
    hits = F.transform(
        _model_of(lexicon).phrases(),
        lambda label: F.aggregate(
            label,
            F.lit(0.0),
            lambda acc, p: acc + F.when(F.contains(F.col("_lower"), p["kw"]), p["w"]).otherwise(0.0),
        ),
    )
    lowered = df.withColumn("_lower", F.lower(text))
    return add_once(lowered, hits=F.when(F.col("_lower").isNotNull(), hits)).drop("_lower")


def add_keyword_norm(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`keyword`: hits over their maximum; uniform when no phrase occurs."""
    uniform = 1.0 / len(lexicon.labels)
    normed = let(
        F.array_max("hits"),
        lambda top: F.transform("hits", lambda h: F.when(top > 0, h / top).otherwise(uniform)),
    )
    return add_once(df, keyword=normed)


def add_tokens(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    kept = f"filter(words, w -> NOT {one_of('w', lexicon.stop_words)})"
    return df.withColumn("words", tokens(F.col(text))).withColumn("words", F.expr(kept))


def add_term_counts(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`term_counts`: distinct unigrams and bigrams of the text with their counts.

    The stages are separate projections, so that no array is rebuilt inside a lambda.
    """
    staged = add_tokens(df, lexicon, text)
    staged = staged.withColumn("_ordered", F.sort_array(ngrams(F.col("words"))))
    staged = staged.withColumn("_starts", run_starts(F.col("_ordered")))
    staged = add_once(staged, term_counts=run_counts(F.col("_ordered"), F.col("_starts")))
    return staged.drop("words", "_ordered", "_starts")


def term_weights(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per term of `term_counts`: label documents holding it and its TF-IDF weight."""
    model = _model_of(lexicon)
    exploded = df.select("*", F.inline("term_counts")).drop("term_counts")
    known = F.when(F.expr(model.knows("term")), model.entries()[F.col("term")])
    exploded = exploded.withColumn("_known", known)
    idf = F.coalesce(F.col("_known.weight"), F.lit(model.new_term_weight))
    return exploded.withColumns({
        "label_docs": F.coalesce(F.col("_known.d"), F.lit(0)),
        "weight": (1.0 + F.log(F.col("cnt"))) * idf,
    }).drop("_known")


def add_cosine(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`cosine`: similarity of the text with each label document; zeros for a text without terms."""
    model = _model_of(lexicon)
    new_weight = model.new_term_weight
    # One hash lookup per term finds the few that label documents share; only those read the map.
    shared = F.transform(
        F.expr(f"filter(term_counts, t -> {model.knows('t.term')})"),
        lambda t: F.struct(
            (1.0 + F.log(t["cnt"])).alias("tf"), model.entries()[t["term"]].alias("m")
        ),
    )
    staged = df.withColumn("_shared", shared)
    norm2 = F.aggregate(
        "term_counts", F.lit(0.0), lambda acc, t: acc + F.pow(1.0 + F.log(t["cnt"]), 2)
    ) * new_weight**2 + F.aggregate(
        "_shared",
        F.lit(0.0),
        lambda acc, t: acc + t["tf"] * t["tf"] * (t["m"]["weight"] * t["m"]["weight"] - new_weight**2),
    )
    cosine = let(
        norm2,
        lambda text_norm2: F.transform(
            F.array(*[F.lit(base) for base in model.bases]),
            lambda base, k: F.aggregate(
                "_shared",
                F.struct(F.lit(0.0).alias("dot"), base.alias("norm2")),
                lambda acc, s: F.struct(
                    (acc["dot"] + s["tf"] * F.get(s["m"]["dots"], k)).alias("dot"),
                    (acc["norm2"] + F.get(s["m"]["shifts"], k)).alias("norm2"),
                ),
                # Nothing shared, or a label document without terms: no similarity.
                lambda acc: F.when(
                    acc["dot"] > 0, acc["dot"] / F.sqrt(text_norm2 * acc["norm2"])
                ).otherwise(0.0),
            ),
        ),
    )
    return add_once(staged, cosine=cosine).drop("_shared")


def add_scores(df: DataFrame) -> DataFrame:
    """`combined`: weighted sum of both similarities; `scores`: its tempered softmax."""
    staged = df.withColumn(
        "combined",
        F.zip_with(
            "keyword", "cosine", lambda k, c: config.KEYWORD_WEIGHT * k + config.COSINE_WEIGHT * c
        ),
    )
    exps = let(
        F.array_max("combined"),
        lambda top: F.transform(
            "combined", lambda c: F.exp((c - top) / F.lit(config.TEMPERATURE))
        ),
    )
    scores = let(
        F.aggregate("_exps", F.lit(0.0), lambda acc, e: acc + e),
        lambda total: F.transform("_exps", lambda e: e / total),
    )
    staged = staged.withColumn("_exps", exps)
    return add_once(staged, combined=F.col("combined"), scores=scores).drop("_exps")


def score_text(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds `hits, keyword, cosine, combined, scores`, arrays in label order."""
    scored = add_keyword_norm(add_keyword_hits(df, lexicon, text), lexicon)
    scored = add_cosine(add_term_counts(scored, lexicon, text), lexicon).drop("term_counts")
    return add_scores(scored)


def ranked_scores(scores: Column, labels: tuple[str, ...]) -> Column:
    """`array<struct<label, score>>`, best first; equal scores keep label order."""
    names = F.array(*[F.lit(label) for label in labels])
    rows = F.zip_with(
        scores,
        F.sequence(F.lit(0), F.lit(len(labels) - 1)),
        lambda s, k: F.struct(
            (-F.round(s, 12)).alias("key"), k.alias("ord"),
            F.get(names, k).alias("label"), s.alias("score"),
        ),
    )
    return F.transform(
        F.sort_array(rows),
        lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score")),
    )


def with_verdict(df: DataFrame) -> DataFrame:
    """`category, confidence` from `all_scores`; a row that could not be scored stays, Unknown."""
    best = F.get(F.col("all_scores"), F.lit(0))
    return add_once(
        df,
        category=F.coalesce(best["label"], F.lit(config.UNKNOWN)),
        confidence=F.coalesce(F.round(best["score"], config.CONFIDENCE_DIGITS), F.lit(0.0)),
        all_scores=F.coalesce(F.col("all_scores"), F.array().cast(SCORES_TYPE)),
    )


def with_classification_text(articles: DataFrame, text: str = "text") -> DataFrame:
    return articles.withColumn(text, classification_text(F.col("title"), F.col("description")))


def classify_articles(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds `category, confidence, all_scores` to articles with `title, description`."""
    kept = [c for c in articles.columns if c not in ("category", "confidence", "all_scores")]
    scored = score_text(with_classification_text(articles.select(*kept), "_text"), lexicon, "_text")
    scored = scored.select(*kept, "scores").withColumn(
        "all_scores", ranked_scores(F.col("scores"), lexicon.labels)
    )
    return with_verdict(scored.drop("scores"))


def explode_labels(df: DataFrame, lexicon: Lexicon, *arrays: str) -> DataFrame:
    """One row per label for arrays in label order: `label_ord, label` and a column per array."""
    rest = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(F.array(*[F.lit(label) for label in lexicon.labels]).alias("label"), *arrays)
    rows = df.select(*rest, F.posexplode(zipped).alias("label_ord", "_row"))
    return rows.select(*rest, "label_ord", "_row.label", *[f"_row.{a}" for a in arrays])
