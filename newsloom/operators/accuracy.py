"""Predictions against expected labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_cases(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """All expected cases with `category` and whether it agrees; one without prediction is wrong."""
    joined = expected.join(predicted.select(key, "category", "confidence"), key, "left")
    correct = F.coalesce(F.col("category") == F.col("expected"), F.lit(False))
    return joined.withColumns({
        "correct": correct, "mark": F.when(correct, "✓").otherwise("✗")
    })


def accuracy(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count_if("correct").alias("correct"),
        F.count("*").alias("total"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )
