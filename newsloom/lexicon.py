"""Topic labels with their key phrases.

A lexicon is run configuration: it travels inside the plan as literals, so its size is bounded
by `MAX_PHRASES`. The default word lists are this project's own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import config

MAX_PHRASES = 5000


# Subject headings in the manner of a library catalogue.
DEFAULT_PHRASES: dict[str, tuple[str, ...]] = {
    "Technology": (
        "wire", "lens", "node", "ion",
        "compiler", "firmware", "microprocessor", "transistor", "router", "broadband",
        "spreadsheet", "keyboard", "password", "cryptography", "debugging", "source repository",
        "file system", "touch screen", "printed circuit", "fibre optic", "solar cell",
        "lithium battery", "3d printer", "drone", "telescope", "spacecraft", "search engine",
        "web browser", "email client", "video codec", "image sensor", "speech recognition",
        "computer vision", "patent", "platform",
    ),
    "Business": (
        "ore", "tin", "rent", "tea",
        "accountant", "audit", "balance sheet", "payroll", "factory", "warehouse", "freight",
        "wages", "mortgage", "insurance", "premium", "commodity", "currency", "exchange rate",
        "creditor", "shareholder", "stock exchange", "franchise", "procurement", "tender",
        "turnover", "surplus", "layoffs", "trade union", "consumer prices", "cash flow",
        "joint venture", "patent", "sponsor", "auction",
    ),
    "Politics": (
        "heir", "nation", "reform", "state",
        "parliament", "republic", "monarchy", "electorate", "polling station", "by-election",
        "manifesto", "ombudsman", "civil service", "attorney general", "chancellor", "ambassador",
        "consulate", "ceasefire", "armistice", "human rights", "immigration", "devolution",
        "federalism", "municipal", "town hall", "public inquiry", "veto", "impeachment",
        "lobbying", "welfare", "trade union", "census", "statute", "platform",
    ),
    "Sports": (
        "oar", "net", "team", "ski",
        "athlete", "archery", "badminton", "boxing", "canoe", "cricket", "cycling", "decathlon",
        "fencing", "gymnast", "handball", "hockey", "hurdles", "javelin", "judo", "lacrosse",
        "regatta", "relay", "rowing", "shot put", "skiing", "snooker", "swimming pool",
        "time trial", "volleyball", "weightlifting", "goalkeeper", "scoreboard", "sponsor", "draw",
    ),
    "Entertainment": (
        "aria", "art", "duet", "act",
        "actress", "animation", "audience", "ballad", "cabaret", "carnival", "choir",
        "choreography", "circus", "documentary", "exhibition", "guitar", "jazz", "magician",
        "museum", "musical", "orchestra", "opera", "painter", "pantomime", "playwright", "poetry",
        "puppet", "screenplay", "sculpture", "sitcom", "soprano", "symphony", "auction", "draw",
    ),
}


def _tokens(text: str, stop_words: frozenset[str]) -> list[str]:
    """Word runs of two or more characters without stop words, then adjacent pairs."""
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop_words]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass(frozen=True)
class Lexicon:
    """Ordered labels, their phrases and the stop words used for text terms."""

    labels: tuple[str, ...]
    phrases: Mapping[str, tuple[str, ...]]
    stop_words: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self) -> None:
        if not self.labels:
            raise ValueError("at least one label is needed")
        if len(set(self.labels)) != len(self.labels):
            raise ValueError("labels must be distinct")
        size = sum(len(self.phrases.get(label, ())) for label in self.labels)
        if size > MAX_PHRASES:
            raise ValueError(f"{size} phrases; a lexicon may hold {MAX_PHRASES}")

    def with_labels(self, labels: Sequence[str]) -> Lexicon:
        """The same phrases for another label set; labels without phrases are allowed."""
        return Lexicon(tuple(labels), self.phrases, self.stop_words)

    def phrase_weights(self) -> list[list[tuple[str, float]]]:
        """Per label, each phrase with its number of words."""
        return [
            [(phrase, float(len(phrase.split()))) for phrase in self.phrases.get(label, ())]
            for label in self.labels
        ]

    def label_terms(self) -> list[Counter[str]]:
        """Per label, term counts of its document: its phrases joined, or else its own name."""
        stop = frozenset(self.stop_words)
        return [
            Counter(_tokens(" ".join(self.phrases[label]) if label in self.phrases else label, stop))
            for label in self.labels
        ]

    @classmethod
    def from_tables(
        cls, labels: DataFrame, phrases: DataFrame, stop_words: Sequence[str] = ()
    ) -> Lexicon:
        """From `labels(label_ord, label)` and `lexicon(label, keyword_ord, keyword)` tables.

        Both are fetched only up to the size limit; beyond it this is an error.
        """
        named = [
            row["label"] for row in labels.orderBy("label_ord").limit(MAX_PHRASES + 1).collect()
        ]
        if len(named) > MAX_PHRASES:
            raise ValueError(f"more than {MAX_PHRASES} labels")
        rows = (
            phrases.filter(F.col("label").isin(named))
            .select("label", "keyword_ord", "keyword")
            .limit(MAX_PHRASES + 1)
            .collect()
        )
        if len(rows) > MAX_PHRASES:
            raise ValueError(f"more than {MAX_PHRASES} phrases")
        found: dict[str, list[tuple[int, str]]] = {}
        for row in rows:
            found.setdefault(row["label"], []).append((row["keyword_ord"], row["keyword"]))
        return cls(
            tuple(named),
            {label: tuple(word for _, word in sorted(words)) for label, words in found.items()},
            tuple(stop_words),
        )


def default_stop_words() -> tuple[str, ...]:
    """Spark ML's English stop words.

    With no running session the same list is read from the installed Spark distribution, so
    that SQL text can be generated without starting one.
    """
    from pyspark import SparkContext

    if SparkContext._active_spark_context is not None:
        from pyspark.ml.feature import StopWordsRemover

        return tuple(StopWordsRemover.loadDefaultStopWords("english"))

    import glob
    import os
    import zipfile

    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    (jar,) = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as archive:
        text = archive.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8")
    return tuple(text.split())


def default_lexicon(labels: Sequence[str] = config.LABELS) -> Lexicon:
    return Lexicon(tuple(labels), DEFAULT_PHRASES, default_stop_words())
