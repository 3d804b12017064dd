"""What the operators share: tables, stored intermediate results, Arrow tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.session import shared_folder, small_batches

# Tasks carry the code of this folder with them, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["newsloom.llm"])

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of a session that runs these operators."""
    return small_batches(spark)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cut lineage, safe from lost executors.

    What was shuffled for it leaves the executors' disks with the write, not when the driver next
    collects garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def arrow_rows(
    df: DataFrame,
    task: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    schema: str,
    numbers: bool = False,
) -> DataFrame:
    """`task` over the batches of each partition, as dicts of column lists.

    A task may carry state from batch to batch within its partition. Tables of `numbers` only, without
    nulls, come as NumPy columns.
    """
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        read = (lambda c: c.to_numpy()) if numbers else (lambda c: c.to_pylist())
        lists = ({n: read(b.column(n)) for n in b.schema.names} for b in batches)
        for out in task(lists):
            if out and len(next(iter(out.values()))):
                arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The id and whole text of documents, null texts as empty ones; other columns are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns,
    )
