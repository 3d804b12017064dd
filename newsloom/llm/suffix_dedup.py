"""Removal of repeated passages: every byte that a repeated string of LENGTH bytes covers.

A string of LENGTH bytes, a window, is repeated if it starts anywhere else, in the same document
or another. Suffix arrays find repeats, but one array over a corpus is one task. So:

1. Anchors. Of all GRAM-byte runs in a window the one of least hash is its anchor, the rightmost of
   equal ones. Equal windows have equal anchors at equal places, so only windows whose anchor
   occurs twice can be repeated. The windows of one anchor are neighbours: together its context.
2. Copies. Contexts that are equal as a whole need no sorting: all their windows are repeated. One
   of them stands for all, counted within tasks first, so copies of documents are no hot key.
3. Shards. Different contexts around one anchor are a group. Groups, whole, are dealt to shards of
   bounded size. Each shard's suffixes are sorted by external induced sorting (`induced_sort`),
   which carries common prefixes; windows with LENGTH bytes in common with a neighbour are
   repeated. A group too large for a shard is split: its windows part by whether they reach
   further left or right, and each half is grouped anew by the longer run its windows share.
   Halving goes on until groups fit or their windows are equal.

Rows are told apart by their place in the input, so documents must be read from files.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, documents_of, stored
from newsloom.llm.induced_sort import sorted_suffixes

LENGTH = 400
GRAM = 200
# Contexts of a group that one shard takes, and bytes of a shard, about.
GROUP_ROWS = 1_024
SHARD_BYTES = 500_000
# Shards of a task, about.
SHARDS = 4

BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 28
PLACE_MASK = np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(octets: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of `gram` bytes, from sums of powers modulo 2^64."""
    n = len(octets) + 1
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(n, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(octets: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first window, end of windows, place, hash) of every anchor of a text, in order."""
    if len(octets) < length:
        return []
    h = gram_hashes(np.frombuffer(octets, np.uint8), gram)
    # Hash above, place below and counting down: the least is the least hash, rightmost.
    keys = (h & ~PLACE_MASK) | (PLACE_MASK - (np.arange(len(h), dtype=np.uint64) & PLACE_MASK))
    window = length - gram + 1
    n = len(h) - window + 1
    full = np.append(keys, np.full(-len(h) % window, np.iinfo(np.uint64).max))
    blocks = full.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    places = (PLACE_MASK - (least[starts] & PLACE_MASK)).astype(np.int64)
    hashes = h[places].view(np.int64)
    ends = np.append(starts[1:], n)
    return list(zip(starts.tolist(), ends.tolist(), places.tolist(), hashes.tolist()))


def find_anchors(docs: DataFrame) -> DataFrame:
    """row, lo, hi (windows), place, h (anchor), u1, u2 (digest of the context and the place in it)."""

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("row", "lo", "hi", "place", "h", "u1", "u2")}
            for row, text in zip(batch["row"], batch["text"]):
                octets = text.encode("utf-8")
                for lo, hi, place, h in anchors(octets):
                    digest = hashlib.blake2b(octets[lo : hi - 1 + LENGTH], digest_size=16)
                    digest.update((place - lo).to_bytes(4, "little"))
                    u = digest.digest()
                    values = (
                        row, lo, hi, place, h,
                        int.from_bytes(u[:8], "little", signed=True),
                        int.from_bytes(u[8:], "little", signed=True),
                    )
                    for column, value in zip(out.values(), values):
                        column.append(value)
            yield out

    return arrow_rows(
        docs, task, "row long, lo int, hi int, place int, h long, u1 long, u2 long"
    )


def _contexts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The bytes of the standing contexts: key, row, start, copies, gram_at, gram, octets."""
    wanted = groups.select(
        F.col("stands.row").alias("row"),
        F.struct("h", "copies", "stands.lo", "stands.hi", "stands.place").alias("part"),
    ).groupBy("row").agg(F.collect_list("part").alias("parts"))

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("key", "row", "start", "copies", "gram_at", "gram", "octets")}
            for row, text, parts in zip(batch["row"], batch["text"], batch["parts"]):
                octets = text.encode("utf-8")
                for p in parts:
                    values = (
                        p["h"], row, p["lo"], p["copies"], p["place"] - p["lo"], GRAM,
                        octets[p["lo"] : p["hi"] - 1 + LENGTH],
                    )
                    for column, value in zip(out.values(), values):
                        column.append(value)
            yield out

    return stored(arrow_rows(docs.join(wanted, "row"), task, CONTEXT_SCHEMA), "dedup-contexts")


CONTEXT_SCHEMA = (
    "key long, row long, start int, copies long, gram_at int, gram int, octets binary"
)


def halves(octets: bytes, gram_at: int, gram: int):
    """A context's windows in two: (side, first window, end, place and length of the longer run)."""
    windows = len(octets) - LENGTH + 1
    left = (LENGTH - gram + 1) // 2
    cut = min(windows, max(0, gram_at - left + 1))
    if cut:
        yield 0, 0, cut, gram_at - left, gram + left
    if cut < windows:
        yield 1, cut, windows, gram_at, LENGTH - left + 1


def split_groups(contexts: DataFrame) -> DataFrame:
    """Each context in two, keyed by the longer run that the windows of each half share."""

    def task(batches):
        for batch in batches:
            out = {n: [] for n in batch}
            for key, row, start, copies, at, gram, octets in zip(*batch.values()):
                for side, first, end, run_at, run in halves(octets, at, gram):
                    digest = hashlib.blake2b(octets[run_at : run_at + run], digest_size=8)
                    digest.update(f"{side}:{key}".encode())
                    values = (
                        int.from_bytes(digest.digest(), "little", signed=True), row, start + first,
                        copies, run_at - first, run, octets[first : end - 1 + LENGTH],
                    )
                    for column, value in zip(out.values(), values):
                        column.append(value)
            yield out

    return arrow_rows(contexts, task, CONTEXT_SCHEMA)


def _open_groups(contexts: DataFrame) -> DataFrame:
    """The groups with several contexts, of which at least one has no copy of its own."""
    sizes = contexts.groupBy("key").agg(F.count("*").alias("n"), F.min("copies").alias("fewest"))
    return contexts.join(stored(sizes.filter("n > 1 and fewest = 1").select("key"), "dedup-open"), "key")


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context the windows that also start elsewhere in these contexts, as booleans."""
    if not contexts:
        return []
    codes, is_window = [], []
    for octets in contexts:
        codes.append(np.append(np.frombuffer(octets, np.uint8).astype(np.int64) + 2, 1))
        is_window.append(np.arange(len(octets) + 1) <= len(octets) - LENGTH)
    ends = np.cumsum([len(c) for c in codes])
    order, shared = sorted_suffixes(np.append(np.concatenate(codes), 0), LENGTH)
    # Between two windows in suffix order the least common prefix of the suffixes between counts.
    at = np.flatnonzero(np.append(np.concatenate(is_window), False)[order])
    found = np.zeros(len(order), bool)
    if len(at) > 1:
        same = np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1) >= LENGTH
        hit = np.zeros(len(at), bool)
        hit[:-1] |= same
        hit[1:] |= same
        found[order[at[hit]]] = True
    starts = np.append(0, ends[:-1]).tolist()
    return [found[a : a + len(c) - LENGTH + 1] for a, c in zip(starts, contexts)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorted_shards(contexts: DataFrame) -> DataFrame:
    """(row, start, stop) of the repeated windows of contexts that have no copy of their own."""
    size = contexts.agg(F.sum(F.length("octets"))).first()[0] or 0
    count = max(1, -(-int(size) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("key"), F.lit(count)).alias("shard")

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        flags = repeated_windows([bytes(o) for o in frame["octets"]])
        for row, start, copies, hit in zip(frame["row"], frame["start"], frame["copies"], flags):
            if copies == 1:
                rows += [(row, start + a, start + b - 1 + LENGTH) for a, b in _runs(hit)]
        return pd.DataFrame(rows, columns=["row", "start", "stop"])

    # Dealt by number: shards are small to shuffle and long to sort, so merging them by size would not do.
    keyed = contexts.select(shard, "row", "start", "copies", "octets").repartition(-(-count // SHARDS), "shard")
    return keyed.groupBy("shard").applyInPandas(task, "row long, start int, stop int")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(row, start, stop): byte ranges of repeated windows, which may overlap."""
    found = stored(find_anchors(docs), "dedup-anchors")
    often = stored(found.groupBy("h").agg(
        F.count("*").alias("n"), F.min("u1").alias("least"), F.max("u1").alias("most"),
        F.min("u2").alias("least2"), F.max("u2").alias("most2"),
    ).filter("n > 1").select(
        "h", ((F.col("least") == F.col("most")) & (F.col("least2") == F.col("most2"))).alias("alike")
    ), "dedup-repeated-hashes")
    again = stored(found.join(often, "h"), "dedup-repeated-anchors")
    stop = (F.col("hi") - 1 + LENGTH).alias("stop")
    alike = again.filter("alike").select("row", F.col("lo").alias("start"), stop)

    mixed = again.filter(~F.col("alike"))
    groups = stored(
        mixed.groupBy("h", "u1", "u2").agg(
            F.count("*").alias("copies"), F.min(F.struct("row", "lo", "hi", "place")).alias("stands")
        ),
        "dedup-groups",
    )
    copied = groups.filter("copies > 1").select("h", "u1", "u2")
    copied = mixed.join(copied, ["h", "u1", "u2"]).select("row", F.col("lo").alias("start"), stop)

    # Halving once for all groups leaves fewer to sort: many share little more than their anchor.
    contexts = stored(split_groups(_open_groups(_contexts(docs, groups))), "dedup-contexts")
    ready, equal = [], []
    while True:
        contexts = _open_groups(contexts)
        sizes = contexts.groupBy("key").agg(F.count("*").alias("n"))
        large = stored(sizes.filter(F.col("n") > GROUP_ROWS).select("key"), "dedup-large")
        if large.isEmpty():
            ready.append(contexts)
            break
        ready.append(contexts.join(large, "key", "left_anti"))
        over = contexts.join(large, "key")
        # Windows that share LENGTH bytes are equal; their group needs no more splitting.
        equal.append(over.filter(F.col("gram") >= LENGTH))
        contexts = stored(split_groups(over.filter(F.col("gram") < LENGTH)), "dedup-contexts")
    parts = ready[0]
    for more in ready[1:]:
        parts = parts.unionByName(more)
    result = alike.unionByName(copied).unionByName(_sorted_shards(parts))
    for rows in equal:
        whole = (F.col("start") + F.length("octets")).cast("int").alias("stop")
        result = result.unionByName(rows.filter("copies = 1").select("row", "start", whole))
    return result


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every document without its repeated bytes.

    row, doc_id, n_bytes, n_removed, n_spans (removed runs) and kept (the remaining bytes, which
    may cut through a character). All strings are judged on the input. Null texts are empty;
    texts shorter than LENGTH lose nothing; repeated rows are repeats of each other; an empty
    table gives no rows.
    """
    rows = documents_of(docs, F.monotonically_increasing_id().alias("row"))
    ranges = find_repeats(rows.select("row", "text"))
    ranges = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, found in zip(batch["text"], batch["ranges"]):
                octets = text.encode("utf-8")
                kept, at, spans = [], 0, 0
                until = None
                for a, b in sorted((r["start"], r["stop"]) for r in found or []):
                    if until is None or a > until:
                        kept.append(octets[at:a])
                        spans += 1
                        until = b
                    until = max(until, b)
                    at = until
                kept.append(octets[at:])
                rest = b"".join(kept)
                for column, value in zip(out.values(), (len(octets), len(octets) - len(rest), spans, rest)):
                    column.append(value)
            yield {"row": batch["row"], "doc_id": batch["doc_id"], **out}

    return arrow_rows(
        rows.join(ranges, "row", "left"), task,
        "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
    )
