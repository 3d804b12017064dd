"""Pluggable topic scorers that all yield `category, confidence, all_scores`."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import config
from newsloom.lexicon import Lexicon
from newsloom.operators.model import classify_with_model, load_model
from newsloom.operators.topics import classify_articles, with_classification_text, with_verdict

log = logging.getLogger(__name__)

# (text, candidate_labels) -> {"labels": [...], "scores": [...]}, best first.
Scorer = Callable[[str, list[str]], dict]
# (texts, candidate_labels) -> one such result per text.
BatchScorer = Callable[[list[str], list[str]], list[dict]]

_Row = tuple[list[str], list[float], str | None]


def _row(result: dict) -> _Row:
    return list(result["labels"]), [float(s) for s in result["scores"]], None


def _attempt(call: Callable[[], dict]) -> _Row:
    try:
        return _row(call())
    except Exception as exc:  # the failure value is part of the contract
        return [], [], f"{type(exc).__name__}: {exc}"


def _score_batch(scorer: BatchScorer, texts: list[str], labels: list[str]) -> list[_Row]:
    """One call for all texts; only if it fails is each tried alone, so that one costs no other."""
    try:
        results = scorer(texts, labels)
        if len(results) != len(texts):
            raise ValueError(f"{len(results)} results for {len(texts)} texts")
        return [_row(result) for result in results]
    except Exception:
        return [_attempt(lambda text=text: scorer([text], labels)[0]) for text in texts]


def score_with(
    articles: DataFrame,
    load_scorer: Callable[[], Scorer | BatchScorer],
    labels: Sequence[str] = config.LABELS,
    batch_size: int | None = None,
    error_column: str | None = None,
) -> DataFrame:
    """Classifies with any callable, loaded once per Python worker task.

    Only the text column travels to Python, in Arrow batches. With `batch_size` the scorer takes
    lists of up to so many texts. A text the scorer fails on, and one that is null, keeps its row
    and becomes Unknown; `error_column` then says why, and is null elsewhere.
    """
    candidates = list(labels)

    @F.pandas_udf("labels array<string>, scores array<double>, error string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for texts in batches:
            rows: list[_Row] = [([], [], "no text")] * len(texts)
            known = [k for k, text in enumerate(texts) if text is not None]
            for at in range(0, len(known), batch_size or 1):
                places = known[at : at + (batch_size or 1)]
                chosen = [texts.iloc[k] for k in places]
                if batch_size:
                    scored = _score_batch(scorer, chosen, candidates)
                else:
                    scored = [_attempt(lambda: scorer(chosen[0], candidates))]
                for place, row in zip(places, scored):
                    rows[place] = row
            yield pd.DataFrame(rows, columns=["labels", "scores", "error"])

    kept = [c for c in articles.columns if c not in ("category", "confidence", "all_scores")]
    scored = with_classification_text(articles.select(*kept), "_text").withColumn(
        "_result", score("_text")
    )
    ranked = F.zip_with(
        "_result.labels",
        "_result.scores",
        lambda label, value: F.struct(label.alias("label"), value.alias("score")),
    )
    if error_column is not None:
        scored = scored.withColumn(error_column, F.col("_result.error"))
    return with_verdict(scored.withColumn("all_scores", ranked).drop("_text", "_result"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names, not just the driver's disk."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def choose_backend(
    spark: SparkSession,
    force_hybrid: bool = False,
    model_path: str | None = None,
    base_scorer: Callable[[], Scorer | BatchScorer] | None = None,
) -> str:
    """`hybrid` when forced, else a trained model that exists, else a base scorer, else hybrid."""
    if force_hybrid:
        return "hybrid"
    if model_path is not None:
        if path_exists(spark, model_path):
            return "trained"
        log.warning("no trained model at %s", model_path)
    return "base" if base_scorer is not None else "hybrid"


def classify_with_backend(
    articles: DataFrame,
    lexicon: Lexicon,
    force_hybrid: bool = False,
    model_path: str | None = None,
    base_scorer: Callable[[], Scorer | BatchScorer] | None = None,
    batch_size: int | None = None,
    error_column: str | None = None,
) -> DataFrame:
    """Classifies with the chosen backend; one that cannot be loaded gives way to hybrid.

    `batch_size` and `error_column` are those of `score_with`; other backends have no errors.
    """
    backend = choose_backend(articles.sparkSession, force_hybrid, model_path, base_scorer)
    if backend == "base":
        try:
            base_scorer()
        except Exception as exc:
            log.warning("base scorer cannot be loaded: %s", exc)
        else:
            return score_with(articles, base_scorer, lexicon.labels, batch_size, error_column)
    if error_column is not None:
        articles = articles.withColumn(error_column, F.lit(None).cast("string"))
    if backend == "trained":
        try:
            model = load_model(model_path)
        except Exception as exc:
            log.warning("trained model cannot be loaded: %s", exc)
        else:
            return classify_with_model(articles, model)
    return classify_articles(articles, lexicon)
