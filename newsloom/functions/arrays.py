"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    Catalyst may inline a column that is named once inside a lambda, which would evaluate it
    for every element; a lambda argument is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns that later filters must not pull apart.

    A filter on a computed column is pushed through projections by copying the expression, at
    every stage and once per reference, which multiplies long derivations. Filters stop at a
    generator, so the values come out of a one-row one.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
