"""Headline CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, plus `row_ord`, the position in file order.

    A missing path is an error, raised by Spark. Row order follows file name, then the byte
    position of the split, then the row within it.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False)
    names = rows.columns
    return rows.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("row_ord"),
        *[F.col(f"`{name}`") for name in names],
    )
