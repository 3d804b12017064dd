"""Hits of a lexicon that is a table, of any size.

`topics.add_keyword_hits` scans every text once per phrase, which suits a lexicon of some hundred
phrases in the plan. Here the phrases are found by an index instead: each is filed under the one of
its runs of three characters that fewest phrases share, the runs of a text are looked up in it by
an equi-join, and only phrases that meet a text there are compared with it. Spark broadcasts a
small index and shuffles a large one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
NOT_WORD = r"[^\p{L}\p{N}_]+"


def _prepared(text: Column, match: str) -> Column:
    """Lower-cased; for whole words, the words between single spaces, with one at either end."""
    low = F.lower(text)
    if match == "substring":
        return low
    if match != "word":
        raise ValueError(f"match is 'substring' or 'word', not {match!r}")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, NOT_WORD, " ")), F.lit(" "))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters."""
    return F.when(F.length(text) < size, F.array().cast("array<string>")).otherwise(
        F.array_distinct(_runs(F.split(text, ""), size))
    )


def _runs(characters: Column, size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(characters) - size),
        lambda k: F.concat(*(F.get(characters, k + i) for i in range(size))),
    )


def phrase_index(lexicon: DataFrame, match: str = "substring") -> DataFrame:
    """(gram, phrase, label, weight) of a lexicon (label, keyword).

    A phrase weighs its number of words, once for each time its label lists it. Null and blank
    phrases, and for whole words those without a word, are left out.
    """
    words = F.size(F.split(F.btrim(F.regexp_replace("keyword", r"\s+", " ")), " "))
    rows = lexicon.filter(F.btrim(F.col("keyword")) != "").select(
        "label", _prepared(F.col("keyword"), match).alias("phrase"), words.alias("words")
    )
    rows = rows.filter(F.btrim(F.col("phrase")) != "").groupBy("label", "phrase").agg(F.sum("words").alias("weight"))
    phrases = rows.select("phrase").distinct()
    short = F.length("phrase") < GRAM
    grams = F.when(short, F.array("phrase")).otherwise(_grams(F.col("phrase"), GRAM))
    filed = phrases.select("phrase", F.explode(grams).alias("gram"))
    shared = filed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = filed.join(shared, "gram").groupBy("phrase").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rows.join(rarest, "phrase").select("gram", "phrase", "label", "weight")


def phrase_hits(
    texts: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text", match: str = "substring"
) -> DataFrame:
    """(keys..., label, hits): per text and label the weights of the phrases that occur in the text.

    A phrase counts once per text. With `match="word"` its words have to stand in the text as whole
    words, in a row. Pairs without a hit have no row. `keys` tell the texts apart; texts and the
    index are read once, and the sizes of its keys (three numbers) are looked at first.
    """
    index = phrase_index(lexicon, match)
    sizes = [r[0] for r in index.select(F.length("gram").alias("size")).distinct().collect()]
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    rows = texts.select(*[F.col(k).alias(n) for k, n in names.items()], _prepared(F.col(text), match).alias("_text"))
    grams = [_grams(F.col("_text"), size) for size in sizes] or [F.array().cast("array<string>")]
    looked_up = rows.select(*names.values(), "_text", F.explode(F.concat(*grams)).alias("gram"))
    found = looked_up.join(index, "gram").filter(F.contains(F.col("_text"), F.col("phrase")))
    return found.groupBy(*names.values(), "label").agg(F.sum("weight").cast("double").alias("hits")).select(
        *[F.col(n).alias(k) for k, n in names.items()], "label", "hits"
    )
