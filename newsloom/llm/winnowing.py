"""Winnowed document fingerprints, in DataFrame functions only.

A text's tokens are its runs of non-blank characters, cut after 16 characters. Each run of `k`
tokens is hashed (a k-gram). Of every `window` neighbouring k-grams the least hash is kept, the
rightmost of equal ones, with its position. Two texts that share `k + window - 1` tokens in a
row therefore share a kept hash.

A k-gram is one long: 33 bits of hash above 30 bits that count down with the position. The least
such long of a window is the least hash and, of equal hashes, the rightmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import documents_of, let

K = 3
WINDOW = 4
TOKEN = r"\S{1,16}"
POSITION_BITS = 30
LAST_POSITION = (1 << POSITION_BITS) - 1
HASH_MASK = (1 << 33) - 1

# An edit is ordered by document id within buckets of about this many rows. No more than
# MAX_BUCKETS exist, so that the table of their first ids stays below two megabytes.
ROWS_PER_BUCKET = 1_000
MAX_BUCKETS = 100_000


def _packed(tokens: Column, k: int) -> Column:
    """One long for each k-gram; a shorter text is one k-gram, an empty one none."""
    n = F.size(tokens)

    def one(first: Column, at: Column) -> Column:
        rest = [F.get(tokens, at + j) for j in range(1, k)]
        h = F.xxhash64(first, *rest).bitwiseAND(F.lit(HASH_MASK))
        return F.shiftleft(h, POSITION_BITS) + (F.lit(LAST_POSITION) - at).cast("long")

    short = F.shiftleft(
        F.xxhash64(F.array_join(tokens, " ")).bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS
    ) + F.lit(LAST_POSITION)
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < k, F.array(short))
        .otherwise(F.transform(F.slice(tokens, F.lit(1), F.greatest(n - (k - 1), F.lit(0))), one))
    )


def _minima(grams: Column, window: int) -> Column:
    """The kept k-grams, each once, by position."""
    n = F.size(grams)
    starts = F.slice(grams, F.lit(1), F.greatest(n - (window - 1), F.lit(0)))
    slid = F.transform(
        starts, lambda g, at: F.least(g, *(F.get(grams, at + j) for j in range(1, window)))
    )
    whole = F.when(n == 0, grams).otherwise(F.array(F.array_min(grams)))
    return F.array_distinct(F.when(n <= window, whole).otherwise(slid))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The kept k-grams of a text as packed longs, in text order; null for a null text."""
    if k < 2 or window < 2:
        raise ValueError("k and window are at least 2")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(let(tokens, lambda t: _packed(t, k)), lambda g: _minima(g, window))


def hashes(kept: Column) -> Column:
    return F.transform(kept, lambda g: F.shiftright(g, POSITION_BITS))


def positions(kept: Column) -> Column:
    """Token positions, from 0, of the kept k-grams."""
    return F.transform(kept, lambda g: F.lit(LAST_POSITION) - g.bitwiseAND(F.lit(LAST_POSITION)))


def fingerprint(kept: Column) -> Column:
    """`hash@position` of all kept k-grams, hashes in hexadecimal; empty for an empty text."""
    at = lambda g: F.lit(LAST_POSITION) - g.bitwiseAND(F.lit(LAST_POSITION))
    return F.array_join(
        F.transform(
            kept,
            lambda g: F.concat(
                F.lower(F.hex(F.shiftright(g, POSITION_BITS))), F.lit("@"), at(g).cast("string")
            ),
        ),
        ",",
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct hashes of two fingerprints; two empty ones are alike (1.0)."""

    def ratio(x: Column, y: Column) -> Column:
        total = F.size(x) + F.size(y)
        shared = F.size(F.array_intersect(x, y)).cast("double")
        return F.when(total == 0, F.lit(1.0)).otherwise(let(shared, lambda n: n / (total - n)))

    return let(
        F.array_distinct(hashes(a)),
        lambda x: let(F.array_distinct(hashes(b)), lambda y: ratio(x, y)),
    )


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, fingerprint and positions of every document; map only."""
    rows = documents_of(docs).withColumn("kept", winnow(F.col("text"), k, window))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        fingerprint(F.col("kept")).alias("fingerprint"), positions(F.col("kept")).alias("positions"),
    )


def with_next_text(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next one by id (after the last: the first).

    Ids are cut into ranges of equal width; each range is one sorted window. The first row of
    every range also goes to the end of the range before it, so no row lacks its neighbour and
    nothing is ordered in one task. Rows of equal id are ordered by text. A row without an id
    has no place in the order: its next text is null.
    """
    rows = documents_of(docs)
    known = rows.filter("doc_id is not null")
    span = known.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, count = (int(v or 0) for v in span)
    buckets = min(MAX_BUCKETS, max(1, -(-count // ROWS_PER_BUCKET)))
    width = max(1.0, (high - low + 1) / buckets)
    bucket = F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width))

    known = known.withColumn("bucket", bucket)
    firsts = known.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    last_bucket = int((float(high) - float(low)) // width)
    order = Window.orderBy("bucket")
    firsts = firsts.select(
        "first_id", F.coalesce(F.lag("bucket").over(order), F.lit(last_bucket)).alias("before")
    )
    keyed = known.join(F.broadcast(firsts), F.col("doc_id") == F.col("first_id"), "left")
    places = F.array_compact(F.array(
        F.struct(F.col("bucket").alias("place"), F.lit(False).alias("guest")),
        F.when(
            F.col("before").isNotNull(),
            F.struct(F.col("before").alias("place"), F.lit(True).alias("guest")),
        ),
    ))
    placed = keyed.select("doc_id", "text", F.inline(places)).repartition("place")
    placed = placed.withColumn("kept", winnow(F.col("text")))
    near = Window.partitionBy("place").orderBy("guest", "doc_id", "text")
    nexts = placed.select(
        "doc_id", "text", "kept", "guest",
        F.lead("text").over(near).alias("next_text"), F.lead("kept").over(near).alias("next_kept"),
    ).filter(~F.col("guest")).drop("guest")
    unplaced = rows.filter("doc_id is null").withColumn("kept", winnow(F.col("text")))
    return nexts.unionByName(unplaced, allowMissingColumns=True)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edits, and how alike they are.

    The edit replaces the last quarter of a text by the beginning of the next document's. Null
    texts count as empty; a table of one row is its own neighbour; an empty table gives no rows.
    A row without an id gets nothing in place of its last quarter, and a `near_next` of 0.
    """
    rows = with_next_text(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    tail = F.coalesce(F.substring(F.col("next_text"), F.lit(1), cut), F.lit(""))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), tail)
    rows = rows.select("doc_id", "kept", "next_kept", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_kept", winnow(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        F.coalesce(likeness(F.col("kept"), F.col("next_kept")), F.lit(0.0)).alias("near_next"),
    )
