"""A trainable topic classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    IndexToString,
    NGram,
    RegexTokenizer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.terms import TOKEN
from newsloom.operators.topics import ranked_scores, with_classification_text, with_verdict

FEATURES = 1 << 14


def _pipeline(labels: Sequence[str], max_iter: int, reg_param: float) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="raw", pattern=TOKEN, gaps=False),
        StopWordsRemover(inputCol="raw", outputCol="words"),
        NGram(inputCol="words", outputCol="pairs", n=2),
        HashingTF(inputCol="words", outputCol="word_tf", numFeatures=FEATURES),
        HashingTF(inputCol="pairs", outputCol="pair_tf", numFeatures=FEATURES),
        VectorAssembler(inputCols=["word_tf", "pair_tf"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(
            featuresCol="features", labelCol="target", family="multinomial",
            maxIter=max_iter, regParam=reg_param,
        ),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=list(labels)),
    ])


def _with_target(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("category"))
    return rows.withColumn("target", (position - 1).cast("double")).filter("target >= 0")


def train_classifier(
    rows: DataFrame,
    labels: Sequence[str] = config.LABELS,
    max_iter: int = 20,
    reg_param: float = 0.01,
) -> PipelineModel:
    """Fits on `text, category`; categories outside `labels` are left out."""
    present = _with_target(rows.select("text", "category"), labels)
    return _pipeline(labels, max_iter, reg_param).fit(present)


def evaluate_classifier(
    model: PipelineModel, rows: DataFrame, labels: Sequence[str] = config.LABELS
) -> dict[str, float]:
    """`log_loss` and `accuracy` on labelled rows."""
    predicted = model.transform(_with_target(rows.select("text", "category"), labels)).select(
        "target", "prediction", "probability"
    )
    return {
        name: MulticlassClassificationEvaluator(
            labelCol="target", predictionCol="prediction", probabilityCol="probability",
            metricName=metric,
        ).evaluate(predicted)
        for name, metric in (("log_loss", "logLoss"), ("accuracy", "accuracy"))
    }


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify_with_model(articles: DataFrame, model: PipelineModel) -> DataFrame:
    """`category, confidence, all_scores` from a fitted model."""
    labels = tuple(model.stages[-1].getLabels())
    kept = [c for c in articles.columns if c not in ("category", "confidence", "all_scores")]
    # The article columns travel in a struct, out of the way of the model's own column names.
    rows = with_classification_text(articles.select(*kept), "_text").select(
        F.struct(*kept).alias("article"), F.col("_text").alias("given"),
        F.coalesce(F.col("_text"), F.lit("")).alias("text"),
    )
    scored = model.transform(rows).withColumn("_scores", vector_to_array("probability"))
    # A model fitted without the last labels has shorter vectors.
    padded = F.when(
        F.col("given").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), F.lit(len(labels) - 1)),
            lambda k: F.coalesce(F.get(F.col("_scores"), k), F.lit(0.0)),
        ),
    )
    ranked = scored.select("article.*", ranked_scores(padded, labels).alias("all_scores"))
    return with_verdict(ranked)
