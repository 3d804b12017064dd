"""Documents drawn by importance towards the benchmark's distribution of word runs.

Separators collapse to single spaces, so every run of n words is one match of one pattern: a space
(the left boundary), n words, and a look-ahead for the space behind. Overlapping matches give the
spans of all runs in one scan a length, and each span is hashed as it is.

Two passes over the texts would cost twice the scan. The buckets of each document are stored with
two bytes a feature instead, and counts, weights and the draw read only those.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, stored

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Bytes of collapsed text scanned at a time, which bounds the spans held.
CHUNK = 1 << 20
# A document of more features than this is kept as its counts, which are then smaller.
DENSE = 4 * BUCKETS
# Rows that one task of the final sort should have.
SORT_ROWS = 1_000_000

_SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RUNS = [regex.compile(rb" ([^ ]++(?: [^ ]++){%d})(?= )" % (n - 1)) for n in range(1, LONGEST + 1)]


def collapsed(text: str | None) -> bytes:
    """Lower-cased words between single spaces, with one at either end; empty without words."""
    low = _SEPARATORS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip()
    return b" " + low + b" " if low else b""


def _chunks(words: bytes):
    """(start, ends): ends[n - 1] closes the runs of n words that start in the chunk."""
    start = 0
    while start < len(words) - 1:
        end = words.find(b" ", start + CHUNK)
        end = len(words) - 1 if end < 0 else end
        ends = [end]
        for _ in range(LONGEST - 1):
            after = words.find(b" ", ends[-1] + 1)
            ends.append(ends[-1] if after < 0 else after)
        yield start, ends
        start = end


def bucket_runs(words: bytes):
    """The buckets of all runs of 1 to LONGEST words of a collapsed text, some at a time."""
    for start, ends in _chunks(words):
        for pattern, end in zip(_RUNS, ends):
            spans = pattern.findall(words, start, end + 1, overlapped=True)
            yield np.fromiter(map(zlib.crc32, spans), np.uint32, len(spans)) % BUCKETS


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of every text.

    `buckets` has two bytes a feature or, if `dense`, eight bytes a bucket with its count. A null
    or wordless text has no features.
    """

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("n_words", "n_features", "dense", "buckets")}
            for text in batch["text"]:
                words = collapsed(text)
                held, waiting, counts, total = [], 0, None, 0
                for run in bucket_runs(words):
                    held.append(run.astype("<u2"))
                    waiting += len(run)
                    total += len(run)
                    if waiting > DENSE:
                        more = np.bincount(np.concatenate(held), minlength=BUCKETS)
                        counts = more if counts is None else counts + more
                        held, waiting = [], 0
                if counts is not None and held:
                    counts = counts + np.bincount(np.concatenate(held), minlength=BUCKETS)
                out["n_words"].append(max(0, words.count(b" ") - 1))
                out["n_features"].append(total)
                out["dense"].append(counts is not None)
                out["buckets"].append(
                    counts.astype("<u8").tobytes() if counts is not None else b"".join(h.tobytes() for h in held)
                )
            yield {"doc_id": batch["doc_id"], **out}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_rows(
        rows, task, "doc_id long, n_words long, n_features long, dense boolean, buckets binary"
    )


def bucket_counts(found: DataFrame) -> np.ndarray:
    """How many features of all rows fall into each bucket. The driver gets BUCKETS sums."""

    def task(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for dense, octets in zip(batch["dense"], batch["buckets"]):
                if dense:
                    total += np.frombuffer(octets, "<u8").astype(np.int64)
            plain = b"".join(o for d, o in zip(batch["dense"], batch["buckets"]) if not d)
            total += np.bincount(np.frombuffer(plain, "<u2"), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield {"bucket": seen.tolist(), "n": total[seen].tolist()}

    parts = arrow_rows(found.select("dense", "buckets"), task, "bucket int, n long")
    sums = np.zeros(BUCKETS, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths: log ratio of smoothed target and source shares."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the digest of the id."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of the rows of `features`."""

    def task(batches):
        for batch in batches:
            weights = [
                int((gain * np.frombuffer(o, "<u8").astype(np.int64)).sum()) if d
                else int(gain[np.frombuffer(o, "<u2")].sum())
                for d, o in zip(batch["dense"], batch["buckets"])
            ]
            yield {
                **{n: batch[n] for n in ("doc_id", "n_words", "n_features")}, "weight": weights,
                "score": [w + noise(i, seed) for w, i in zip(weights, batch["doc_id"])],
            }

    return arrow_rows(found, task, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, first: Column, *order: Column) -> DataFrame:
    """`rows` with `place`, 0, 1, 2...: those where `first` holds come first, then by `order`.

    One sort by sampled ranges; the ranges' sizes, one number each, give the places in them.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORT_ROWS))
    keys = [(~first).cast("int"), *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "importance-sorted")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for row in sizes:
        starts.append((row["part"], before))
        before += row["n"]
    # One row a sort task, so small by construction.
    start = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    return dealt.join(start, part == F.col("_part")).withColumn("place", F.col("_start") + inside).drop(
        "_at", "_part", "_start"
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null if not drawn.

    `percent` of the documents with at least `min_words` words are drawn without replacement: the
    highest weights with Gumbel noise, ties to the smaller id. A null text has weight 0. A null id
    has the noise of an empty name and loses ties. Repeated rows are rows of their own. Without
    target texts the target share is even; an empty table gives no rows. Other columns of either
    table are not read.
    """
    found = stored(features(docs), "importance-features")
    names = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text"))
    gain = gains(bucket_counts(found), bucket_counts(features(names)))
    rows = stored(weighed(found, gain, seed), "importance-weights")
    long_enough = F.col("n_words") >= min_words
    drawn = percent * rows.filter(long_enough).count() // 100
    placed = ranked(rows, long_enough, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return placed.select(
        "doc_id", "n_features", "weight", "score",
        F.when(long_enough & (F.col("place") < drawn), F.col("place") + 1).alias("rank"),
    )
