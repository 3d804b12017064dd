from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluates a one-argument column function on a list of strings."""
    from pyspark.sql import functions as F

    def run(fn, values):
        rows = [(k, value) for k, value in enumerate(values)]
        df = spark.createDataFrame(rows, "k int, x string").coalesce(1)
        return [r["y"] for r in df.select("k", fn(F.col("x")).alias("y")).orderBy("k").collect()]

    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
