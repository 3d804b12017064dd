"""Scoring with a class-based bigram model, classes from exchange clustering.

Each word belongs to one class; a text's probability is the product, over its tokens, of

    P(class | class before) * P(word | class).

The `vocabulary` most frequent words are clustered: starting from a frequency deal, each round
moves words to the class where the likelihood of the corpus's class bigrams is highest, half of
the words in turn. Two classes stand by themselves: the end of a text, and all other words.
Class transitions are smoothed by absolute discounting, word emissions by adding SMOOTHING.

Counts of words and of neighbouring words come from all training texts, as Spark aggregations
that combine within tasks first. What goes to every task is the vocabulary's classes, the counts of
its words and of the COUNTED next ones, and the transition table, all bounded by parameters. Words
beyond them, however many, are joined with their counts; none of them is frequent, so the join has
no hot key. The clustering reads each word's neighbours as packed rows, which are made once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, documents_of, stored
from newsloom.llm.toxicity import remainder

# Words with a class of their own choosing, none longer than WORD_BYTES, and their classes.
VOCABULARY = 16_384
WORD_BYTES = 48
CLASSES = 64
ROUNDS = 3
SMOOTHING = 0.1
DISCOUNT = 0.5
# The next most frequent words, whose counts go to every task; the counts of all others are joined.
COUNTED = 131_072
# Distinct words that a task of that join holds, about.
JOINED_WORDS = 500_000
# A task passes on its counts when it holds this many.
HELD_COUNTS = 200_000


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than blanks, A-Z lower-cased."""
    return text.encode("utf-8").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; the end of each text is the empty word."""

    def task(batches):
        counts = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) >= HELD_COUNTS:
                    yield {"word": list(counts), "n": list(counts.values())}
                    counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    rows = arrow_rows(documents_of(docs).select("text"), task, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows (word, n) of all counts from the least one on that at most `limit` words reach."""
    reached, least = 0, None
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).limit(limit).collect():
        reached += row["count"]
        if reached > limit:
            break
        least = row["n"]
    return counts.filter(F.col("n") >= F.lit(least))


def _ids(texts: list[str], known: dict[bytes, int], end: int, other: int) -> np.ndarray:
    """Ids of all tokens of some texts, each text between two ends."""
    flat = [end]
    for text in texts:
        flat += [known.get(w, other) for w in words_of(text)]
        flat.append(end)
    return np.array(flat, np.int64)


def bigram_counts(docs: DataFrame, known: dict[bytes, int], end: int, other: int) -> DataFrame:
    """(a, b, n): how often id b follows id a, a text starting after an end."""
    width = other + 1

    def task(batches):
        held: list[np.ndarray] = []
        total = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged(keys, counts, more):
            k, n = np.unique(more, return_counts=True)
            k, n = np.concatenate([keys, k]), np.concatenate([counts, n])
            u, at = np.unique(k, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        def rows(keys, counts):
            return {"a": (keys // width).tolist(), "b": (keys % width).tolist(), "n": counts.tolist()}

        size = 0
        for batch in batches:
            ids = _ids(batch["text"], known, end, other)
            held.append(ids[:-1] * width + ids[1:])
            size += len(ids)
            if size >= 4 * HELD_COUNTS:
                total, held, size = merged(*total, np.concatenate(held)), [], 0
                if len(total[0]) >= 4 * HELD_COUNTS:
                    yield rows(*total)
                    total = np.empty(0, np.int64), np.empty(0, np.int64)
        if held:
            total = merged(*total, np.concatenate(held))
        yield rows(*total)

    counted = arrow_rows(documents_of(docs).select("text"), task, "a int, b int, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _log(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def neighbours(bigrams: DataFrame) -> DataFrame:
    """One row for each id: the ids after it and before it with their counts, as packed numbers.

    An id has at most as many neighbours on a side as there are ids. Its own repetitions stand on
    the side after it only.
    """
    after = bigrams.select((2 * F.col("a")).alias("side"), F.col("b").alias("other"), "n")
    before = bigrams.filter("a != b").select((2 * F.col("b") + 1).alias("side"), F.col("a").alias("other"), "n")
    parts = int(bigrams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = after.unionByName(before).repartition(parts, F.shiftright("side", 1)).sortWithinPartitions("side")

    def packed(side, other, n):
        out = {c: [] for c in ("w", "after", "after_n", "before", "before_n")}
        first = np.flatnonzero(np.r_[True, side[1:] >> 1 != side[:-1] >> 1])
        middle = np.searchsorted(side, side[first] | 1)
        for x, m, y in zip(first.tolist(), middle.tolist(), [*first[1:].tolist(), len(side)]):
            out["w"].append(int(side[x]) >> 1)
            for name, a, b in (("after", x, m), ("before", m, y)):
                out[name].append(other[a:b].astype(np.int32).tobytes())
                out[f"{name}_n"].append(n[a:b].astype(np.int64).tobytes())
        return out

    def task(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch[c] for c in ("side", "other", "n")])
            size += len(held[-1][0])
            if size >= HELD_COUNTS:
                side, other, n = (np.concatenate(c) for c in zip(*held))
                # The last id may go on.
                end = int(np.searchsorted(side >> 1, side[-1] >> 1))
                if end:
                    yield packed(side[:end], other[:end], n[:end])
                held, size = [[side[end:], other[end:], n[end:]]], 0
        if held:
            yield packed(*(np.concatenate(c) for c in zip(*held)))

    schema = "w int, after binary, after_n binary, before binary, before_n binary"
    return arrow_rows(rows, task, schema, numbers=True)


def _class_table(around: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes, from the `neighbours` of all ids."""
    k = int(classes.max()) + 1

    def task(batches):
        table = np.zeros((k, k), np.int64)
        for batch in batches:
            for w, after, n in zip(batch["w"], batch["after"], batch["after_n"]):
                after, n = classes[np.frombuffer(after, np.int32)], np.frombuffer(n, np.int64)
                table[classes[w]] += np.bincount(after, n, k).astype(np.int64)
        cells = np.flatnonzero(table)
        yield {"cell": cells.tolist(), "n": table.ravel()[cells].tolist()}

    cells = arrow_rows(around.select("w", "after", "after_n"), task, "cell int, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(k * k)
    for row in cells.collect():  # at most (CLASSES + 2)^2 cells
        table[row["cell"]] = row["n"]
    return table.reshape(k, k)


def _gains(rest: np.ndarray, out: np.ndarray, into: np.ndarray, twice: float, movable: int) -> np.ndarray:
    """How the class bigrams' likelihood changes when a word joins each of the movable classes.

    `rest` counts neighbouring classes without the word; `out` and `into` are the classes after
    and before it, `twice` its own repetitions. Terms that no class changes are left out.
    """
    gain = np.zeros(movable)
    to, since = np.flatnonzero(out), np.flatnonzero(into)
    rows, cols = rest[:movable, to], rest[since, :movable].T
    gain += (_log(rows + out[to]) - _log(rows)).sum(axis=1)
    gain += (_log(cols + into[since]) - _log(cols)).sum(axis=1)
    own = np.arange(movable)
    same = rest[own, own]
    # A class's own cell takes part in its row and its column; it is one cell.
    gain += _log(same + out[:movable] + into[:movable] + twice)
    gain += _log(same) - _log(same + out[:movable]) - _log(same + into[:movable])
    # Whichever class it joins, classes before and after it count it in their sums.
    rows_sum, cols_sum = rest.sum(axis=1) + into, rest.sum(axis=0) + out
    for sums, more in ((rows_sum, out.sum() + twice), (cols_sum, into.sum() + twice)):
        gain -= _log(sums[:movable] + more) - _log(sums[:movable])
    return gain


def _best_classes(around: DataFrame, classes: np.ndarray, table: np.ndarray, free: int, turn: int) -> np.ndarray:
    """The classes after one exchange step for the words with id % 2 = turn; `free` may move."""
    k = table.shape[0]
    movable = int(classes[:free].max()) + 1

    def moved(w, after, after_n, before, before_n):
        mine = int(classes[w])
        own = after == w
        out = np.bincount(classes[after[~own]], after_n[~own], k)
        into = np.bincount(classes[before], before_n, k)
        twice = float(after_n[own].sum())
        rest = table.copy()
        rest[mine, :] -= out
        rest[:, mine] -= into
        rest[mine, mine] -= twice
        gain = _gains(rest, out, into, twice, movable)
        best = int(gain.argmax())
        return best if gain[best] > gain[mine] + 1e-6 else mine

    def task(batches):
        for batch in batches:
            sides = (
                [np.frombuffer(x, kind) for x in batch[c]]
                for c, kind in (("after", np.int32), ("after_n", np.int64), ("before", np.int32), ("before_n", np.int64))
            )
            yield {"w": batch["w"], "c": [moved(*row) for row in zip(batch["w"], *sides)]}

    steps = arrow_rows(around.filter(f"w < {free} and w % 2 = {turn}"), task, "w int, c int")
    result = classes.copy()
    for row in steps.collect():  # at most one row for each word of the vocabulary
        result[row["w"]] = row["c"]
    return result


def cluster(around: DataFrame, size: int, classes: int, rounds: int) -> np.ndarray:
    """Classes of ids 0..size+1: words by exchange, then the end and all other words."""
    deal = np.arange(size) % max(1, min(classes, size))
    ends = int(deal.max()) + 1 if size else 0
    current = np.concatenate([deal, [ends, ends + 1]]).astype(np.int64)
    for step in range(2 * rounds if size > 1 else 0):
        current = _best_classes(around, current, _class_table(around, current), size, step % 2)
    return current


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): absolute discounting over an add-one class distribution."""
    k = len(table)
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    total = table.sum(axis=1, keepdims=True)
    kinds = (table > 0).sum(axis=1, keepdims=True)
    seen = np.maximum(table - DISCOUNT, 0) / np.maximum(total, 1)
    left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return np.log10(seen + left * share)


def score_documents(docs: DataFrame, train: Column, vocabulary: int = VOCABULARY,
                    classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every whole text under a model of the rows that `train` selects.

    doc_id, n_tokens and n_known (tokens, the end included, and those seen in training),
    train_tokens (tokens of training), base_score (add-0.1 unigrams) and score (this model), both
    log10. A null text is empty: one end. Repeated rows count and are scored as often as they
    occur. With no training rows every token is unknown, and an empty table gives no rows.
    """
    training = docs.filter(F.coalesce(train, F.lit(False)))
    counts = stored(word_counts(training), "lm-words")
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    total, kinds = int(total or 0), int(kinds or 0)
    top = counts.filter((F.length("word") > 0) & (F.length("word") <= WORD_BYTES))
    more = frequent(top, vocabulary + COUNTED)
    top = top.orderBy(F.desc("n"), "word").limit(vocabulary).collect()  # bounded by the parameter
    known = {bytes(r["word"]): i for i, r in enumerate(top)}
    more = [r for r in more.collect() if bytes(r["word"]) not in known]  # bounded, see `frequent`
    n = np.array([r["n"] for r in top], np.int64)
    ends = counts.filter(F.length("word") == 0).agg(F.sum("n")).first()[0]
    ends = int(ends or 0)
    size = len(known)
    end, other = size, size + 1

    bigrams = stored(bigram_counts(training, known, end, other), "lm-bigrams")
    around = stored(neighbours(bigrams), "lm-neighbours")
    of = cluster(around, size, classes, rounds)
    step = transitions(_class_table(around, of))
    mass = np.bincount(of[:size], n, of[end]) if size else np.zeros(0)
    members = np.bincount(of[:size], minlength=of[end]) if size else np.zeros(0)
    emit = np.zeros(size + 2)  # the end is certain in its class; other words follow by count
    if size:
        emit[:size] = np.log10((n + SMOOTHING) / (mass + SMOOTHING * members)[of[:size]])
    base_total = total + SMOOTHING * (kinds + 1)
    base = np.log10(np.append(n, [ends, 0]) + SMOOTHING) - np.log10(base_total)
    rare_mass = total - ends - int(n.sum())
    rare_kinds = kinds - size - (ends > 0)
    rare_total = np.log10(rare_mass + SMOOTHING * (rare_kinds + 1))

    # The ids behind `other` are those of further words with known counts, which are in its class.
    further = {bytes(r["word"]): other + 1 + i for i, r in enumerate(more)}
    weights = np.log10(np.array([r["n"] for r in more], np.int64) + SMOOTHING)
    of = np.append(of, np.full(len(more), of[other]))
    emit = np.append(emit, weights - rare_total)
    base = np.append(base, weights - np.log10(base_total))

    def task(batches):
        ids_of = known | further
        for batch in batches:
            words, times, rare, totals = [], [], [], []
            for text in batch["text"]:
                own = words_of(text)
                ids = np.array([end, *[ids_of.get(w, other) for w in own], end])
                inside = ids[1:] != other
                kinds_of = of[ids]
                model = step[kinds_of[:-1], kinds_of[1:]].sum() + emit[ids[1:]].sum()
                seen = int(inside.sum()) - (ends == 0)
                totals.append((len(own) + 1, seen, base[ids[1:]][inside].sum(), model))
                unknown = Counter([own[i] for i in np.flatnonzero(~inside).tolist()])
                words.append(b"")
                words += unknown
                times.append(1)
                times += unknown.values()
                rare.append(1 + len(unknown))
            # A text has a row of its own, then one for each rare word.
            rare = np.array(rare)
            lead = np.cumsum(rare) - rare
            out = {"word": words, "n": times}
            for name in ("row", "doc_id"):
                out[name] = [value for value, count in zip(batch[name], rare.tolist()) for _ in range(count)]
            for name, values in zip(("n_tokens", "n_known", "base", "score"), zip(*totals)):
                out[name] = np.zeros(len(words), np.int64 if name.startswith("n_") else np.float64)
                out[name][lead] = values
            yield out

    rows = documents_of(docs, F.monotonically_increasing_id().alias("row"))
    parts = arrow_rows(
        rows, task,
        "row long, doc_id long, word binary, n long, n_tokens long, n_known long, base double, score double",
    )
    # Rows that carry no word get a key of their own each, which no word has.
    own = F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")
    parts = parts.withColumn("key", F.when(F.length("word") == 0, own).otherwise(F.col("word")))
    rare = counts.filter(F.length("word") > 0).select(F.col("word").alias("key"), F.col("n").alias("c"))
    # So many parts that one part's words fit in a table of them, which spares sorting both sides.
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kinds // JOINED_WORDS))
    joined = parts.repartition(count, "key").join(rare.repartition(count, "key").hint("shuffle_hash"), "key", "left")
    joined = joined.withColumn("c", F.coalesce("c", F.lit(0)))
    lone = F.length("word") == 0
    weight = F.log10(F.col("c") + F.lit(SMOOTHING))
    joined = joined.select(
        "row", "doc_id", "n_tokens",
        F.when(lone, F.col("n_known")).when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"),
        F.when(lone, F.col("base")).otherwise(F.col("n") * (weight - float(np.log10(base_total)))).alias("base"),
        F.when(lone, F.col("score")).otherwise(F.col("n") * (weight - float(rare_total))).alias("score"),
    )
    return joined.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    ).select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """Scores under a model of the nine tenths of ids whose crc32 is not a multiple of ten."""
    held_out = remainder(F.col("doc_id"), 10) == 0
    scored = score_documents(docs, ~held_out)
    return scored.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
