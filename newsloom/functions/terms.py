"""Terms of a text: unigrams and bigrams with their counts, as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word runs of two or more characters, in a form Java and RE2 read alike.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def one_of(name: str, words: Sequence[str]) -> str:
    """SQL membership test; long word lists are far quicker to hand over as text."""
    quoted = ("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"({name} IN ({', '.join(quoted)}))" if words else "false"


def ngrams(words: Column) -> Column:
    """The words, followed by each pair of adjacent ones."""
    n = F.size(words)
    pairs = F.when(
        n > 1,
        F.zip_with(
            F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def run_starts(ordered: Column) -> Column:
    """1-based positions at which a sorted array starts a new value."""
    return F.filter(
        F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
    )


def run_counts(ordered: Column, starts: Column) -> Column:
    """`array<struct<term, cnt>>` from a sorted array and its run starts."""
    return F.transform(
        starts,
        lambda i, k: F.struct(
            F.get(ordered, i - 1).alias("term"),
            (F.coalesce(F.get(starts, k + 1), F.size(ordered) + 1) - i).alias("cnt"),
        ),
    )
