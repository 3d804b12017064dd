"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import rows_of
from newsloom.plans.catalog import registered

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()
NO_SQL = {"train_classifier_eval"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_only_the_model_has_no_sql():
    assert set(registered()) - set(SQL) == NO_SQL
    assert set(registered()) <= set(queries())
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_ordered_results(spark):
    rows = queries()["newest_first"](spark, SF_DIR).collect()
    times = [r["published"] for r in rows]
    assert times == sorted(times, reverse=True)


def test_trained_model(spark):
    (row,) = queries()["train_classifier_eval"](spark, SF_DIR).collect()
    assert row["n_validation"] > 0 and row["accuracy"] == row["reloaded_accuracy"]


def test_entry(spark):
    assert entry(spark).columns[:2] == ["feed_ord", "entry_ord"]
