"""Headlines to premise/hypothesis pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.text import contains_any
from newsloom.operators.select import dedup_text, head_n

SALTS = 64


def resolve_headlines(raw: DataFrame, keep: Sequence[str] = ("row_ord",)) -> DataFrame:
    """`text, category` from a table with untidy or alternative column names; nulls dropped."""
    tidy = raw.toDF(*[name.strip().lower() for name in raw.columns])
    found = {}
    for role, candidates in (
        ("text", config.HEADLINE_TEXT_COLUMNS),
        ("category", config.HEADLINE_CATEGORY_COLUMNS),
    ):
        name = next((c for c in candidates if c in tidy.columns), None)
        if name is None:
            raise ValueError(f"no {role} column among {tidy.columns}")
        found[role] = F.col(name).alias(role)
    columns = [F.col(c) for c in keep]
    return tidy.select(*columns, found["text"], found["category"]).dropna(subset=["text", "category"])


def keyword_topic_filter(
    headlines: DataFrame, keywords: tuple[str, ...] = config.TOPIC_KEYWORDS
) -> DataFrame:
    """Rows whose category or text contains a keyword."""
    return headlines.filter(
        contains_any(F.lower("category"), keywords) | contains_any(F.lower("text"), keywords)
    )


def topic_headlines(
    raw: DataFrame,
    n: int | None = None,
    keywords: tuple[str, ...] = config.TOPIC_KEYWORDS,
    require_rows: bool = False,
) -> DataFrame:
    """Topic rows, distinct by text, the first `n` in file order; None keeps all."""
    found = dedup_text(keyword_topic_filter(resolve_headlines(raw), keywords))
    if require_rows and found.isEmpty():
        raise ValueError("no headline matches the topic keywords")
    return found if n is None else head_n(found, n)


def nli_pairs(
    headlines: DataFrame,
    categories: Sequence[str] = config.LABELS,
    target: str | Column = config.TARGET_CATEGORY,
) -> DataFrame:
    """One pair per headline and category; positive for the target category.

    `target` is a fixed category or a column holding each row's own.
    """
    wanted = F.lit(target) if isinstance(target, str) else target
    rows = headlines.withColumn("_target", wanted).drop("category").withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in categories]))
    )
    label = F.when(F.col("category") == F.col("_target"), config.PAIR_POSITIVE)
    return rows.withColumn("label", label.otherwise(config.PAIR_NEGATIVE)).drop("_target")


def pair_class_counts(pairs: DataFrame) -> DataFrame:
    positive = F.col("label") == config.PAIR_POSITIVE
    return pairs.agg(
        F.count_if(positive).alias("positives"),
        F.count_if(~positive).alias("negatives"),
        F.count("*").alias("total"),
    )


def train_val_split(
    pairs: DataFrame,
    seed: int = config.SPLIT_SEED,
    percent: int = config.VALIDATION_PERCENT,
    by: Sequence[str] = ("text", "category"),
) -> DataFrame:
    """Adds `split` from a hash of the row: map-only, the same on every run.

    `by=["text"]` puts all pairs of a headline on one side.
    """
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *by))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return pairs.withColumn("split", F.when(bucket < percent, "validation").otherwise("train"))


def with_hypothesis(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "hypothesis", F.concat(F.lit("This text is about "), F.col("category"), F.lit("."))
    )


def map_categories(headlines: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Raw categories to labels: the first label one of whose marks the category contains."""
    mapped = F.lit(None).cast("string")
    for label, marks in reversed(rules.items()):
        mapped = F.when(contains_any(F.lower("category"), tuple(marks)), label).otherwise(mapped)
    return headlines.withColumn("category", mapped).filter(F.col("category").isNotNull())


def balanced_sample(
    pairs: DataFrame, n: int = config.SAMPLE_PER_CLASS, seed: int = config.SPLIT_SEED
) -> DataFrame:
    """At most `n` pairs per category and label, picked by a seeded hash.

    The groups are few and huge, so each is first cut to `n` within 64 salted parts, in
    parallel; the second cut then sees at most `64 * n` rows of a group.
    """
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "text", "category"))
    ranked = pairs.withColumn("_digest", digest).withColumn(
        "_salt", F.pmod(F.xxhash64("_digest"), F.lit(SALTS))
    )
    for keys in (["category", "label", "_salt"], ["category", "label"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_digest"))
        ranked = ranked.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return ranked.drop("_digest", "_salt")
