"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

The inverted index is over the test items; every passage of every training text is a query. An
item's score for a passage is the share of the item's own BM25 weight whose terms the passage
holds, so one threshold suits all items. Posting lists are cut into blocks of BLOCK items with the
greatest weight of each term in each block. WAND moves to the first item whose lists could reach
the threshold, asks the block maxima whether that still holds there, and else skips the block.

Items above the threshold are verified: question and answer must both occur, as runs of five words.

Passages are windows of twice the longest item's words, one longest item apart, so each item that
occurs in a text lies whole in a window. Items are searched in shards of bounded size; documents
never leave their row, and only shards of items travel to tasks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, documents_of

K1, B = 1.2, 0.75
BLOCK = 4
# Items of a shard, about, and characters of their texts; shards are dealt by a hash.
SHARD_ITEMS = 1_024
SHARD_CHARS = 4_000_000
# Shares: of an item's weight to be retrieved, of question and answer words to be verified.
THRESHOLD = 0.5
QUESTION_OVERLAP = 0.8
ANSWER_OVERLAP = 0.5
RUN = 5
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_words(text: str) -> int:
    """How many words of an item are its question: up to its last question mark before the end,
    else all sentences but the last; of a single sentence the first two thirds."""
    marks = [m.end() for m in SENTENCE_END.finditer(text)]
    asked = [e for e in marks if text[:e].rstrip().endswith("?")]
    cut = asked[-1] if asked else marks[-1] if marks else None
    total = len(words_of(text))
    n = len(words_of(text[:cut])) if cut else 0
    return n if 0 < n < total else max(1, (2 * total) // 3)


@dataclass
class Index:
    """One shard of items: posting lists with their block maxima, and the items' words."""

    items: list[tuple[int, list[str], int]]
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    block_max: np.ndarray | None = None
    longest: int = 1

    @staticmethod
    def build(rows: list[tuple[int, str]], df: dict[str, int], n: int, mean: float) -> Index:
        items = [(i, words_of(t), question_words(t)) for i, t in sorted(rows)]
        items = [x for x in items if x[1]]
        index = Index(items, longest=max((len(w) for _, w, _ in items), default=1))
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, words, _) in enumerate(items):
            norm = K1 * (1 - B + B * len(words) / mean)
            weights = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm)
                for t, c in Counter(words).items()
            }
            own = sum(weights.values())
            for t, w in weights.items():
                lists[t].append((at, w / own))
        index.terms = {t: i for i, t in enumerate(lists)}
        index.postings = [([a for a, _ in p], [w for _, w in p]) for p in lists.values()]
        blocks = -(-max(1, len(items)) // BLOCK)
        index.block_max = np.zeros((len(lists), blocks), np.float32)
        for i, (at, weights) in enumerate(index.postings):
            np.maximum.at(index.block_max[i], np.array(at) // BLOCK, weights)
        return index


def search(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """The items, by position, whose score for a passage's distinct terms reaches the threshold."""
    if not terms:
        return []
    bounds = index.block_max[terms]
    live = np.flatnonzero(bounds.sum(axis=0) >= threshold - 1e-6)
    if not len(live):
        return []
    best = bounds.max(axis=1).tolist()
    lists = [[0, t, b, row] for t, b, row in zip(terms, best, bounds.tolist())]
    found = []
    first = int(live[0]) * BLOCK
    for x in lists:
        x[0] = bisect_left(index.postings[x[1]][0], first)

    def head(x):
        at = index.postings[x[1]][0]
        return at[x[0]] if x[0] < len(at) else len(index.items)

    while True:
        lists = [x for x in lists if head(x) < len(index.items)]
        lists.sort(key=head)
        bound, pivot = 0.0, None
        for i, x in enumerate(lists):
            bound += x[2]
            if bound >= threshold - 1e-6:
                pivot = head(x)
                last = i
                break
        if pivot is None:
            return found
        while last + 1 < len(lists) and head(lists[last + 1]) == pivot:
            last += 1
        block = pivot // BLOCK
        inside = sum(x[3][block] for x in lists if head(x) // BLOCK <= block)
        if inside < threshold - 1e-6:
            target = (block + 1) * BLOCK  # no item of the block can reach the threshold
        elif head(lists[0]) == pivot:
            score = sum(index.postings[x[1]][1][x[0]] for x in lists[: last + 1])
            if score >= threshold - 1e-9:
                found.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for x in lists:
            at = index.postings[x[1]][0]
            if x[0] < len(at) and at[x[0]] < target:
                x[0] = bisect_left(at, target, x[0])


def overlaps(item: tuple[int, list[str], int], passage: list[str]) -> tuple[float, float]:
    """Shares of an item's question and answer words that lie in runs the passage has too."""
    _, words, cut = item
    run = min(RUN, len(words))
    runs = {tuple(passage[i : i + run]) for i in range(len(passage) - run + 1)}
    covered = [False] * len(words)
    for i in range(len(words) - run + 1):
        if tuple(words[i : i + run]) in runs:
            covered[i : i + run] = [True] * run
    answer = covered[cut:] or covered
    return sum(covered[:cut]) / cut, sum(answer) / len(answer)


def matches(index: Index, text: str) -> list[tuple[int, float, float, float, int]]:
    """(item, score, question overlap, answer overlap, first word of the passage), best of each item."""
    words = words_of(text)
    ids = np.array([index.terms.get(w, -1) for w in words], np.int64)
    step = index.longest
    best: dict[int, tuple[int, float, float, float, int]] = {}
    for start in range(0, max(1, len(words) - step), step):
        inside = ids[start : start + 2 * step]
        terms = np.unique(inside[inside >= 0]).tolist()
        for at, score in search(index, terms, THRESHOLD):
            question, answer = overlaps(index.items[at], words[start : start + 2 * step])
            if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
                row = (index.items[at][0], score, question, answer, start)
                kept = best.get(at)
                if kept is None or row[1:4] > kept[1:4]:
                    best[at] = row
    return [best[at] for at in sorted(best)]


def shards(items: DataFrame):
    """Indexes of all items, one bounded shard at a time. Items without words are not searched."""
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )

    def exploded(batches):
        for batch in batches:
            terms = [(i, t) for i, text in zip(batch["item_id"], batch["text"]) for t in set(words_of(text))]
            lengths = sum(len(words_of(t)) for t in batch["text"])
            yield {
                "item_id": [i for i, _ in terms] + [None],
                "term": [t for _, t in terms] + [None],
                "words": [0] * len(terms) + [lengths],
            }

    terms = arrow_rows(rows, exploded, "item_id long, term string, words long")
    n, chars = rows.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    if not n:
        return
    total = terms.agg(F.sum("words")).first()[0] or 1
    count = max(1, -(-n // SHARD_ITEMS), -(-(chars or 0) // SHARD_CHARS))
    shard = F.pmod(F.xxhash64("item_id"), F.lit(count))
    frequency = terms.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    for s in range(count):
        mine = terms.filter("term is not null").filter(shard == s).select("term").distinct()
        df = {r["term"]: r["df"] for r in frequency.join(mine, "term").collect()}
        texts = [(r["item_id"], r["text"]) for r in rows.filter(shard == s).collect()]
        yield Index.build(texts, df, n, total / n)


def find_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and test item whose question and answer it holds.

    doc_id, item_id, score (share of the item's BM25 weight), question_overlap, answer_overlap
    and first_word, where the best passage starts. Null and empty texts hold nothing, a null id
    is passed on; repeated rows give repeated matches. Without items there are no rows.
    """
    schema = (
        "doc_id long, item_id long, score double, question_overlap double, "
        "answer_overlap double, first_word long"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    result = None
    for index in shards(items):

        def task(batches, index=index):
            for batch in batches:
                rows = [
                    (d, *m) for d, t in zip(batch["doc_id"], batch["text"]) for m in matches(index, t)
                ]
                yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

        part = arrow_rows(documents_of(docs), task, schema)
        result = part if result is None else result.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all columns; one narrow pass for each shard."""
    for index in shards(items):

        def run(batches, index=index):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                clean = [not t or not matches(index, t) for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
