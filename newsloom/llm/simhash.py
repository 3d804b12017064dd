"""SimHash near-duplicates, linked through a hierarchical index over Gray-ordered fingerprints.

A fingerprint is the bitwise majority of its text's shingle hashes. Two fingerprints link when at
most `radius` bits differ. If so, at least one of `radius + 1` bands of bits is the same in both.
For each band all fingerprints are turned so that the band leads, and sorted by the rank of the
turned value in Gray order, where neighbours differ in few bits. The sorted run is cut into leaf
tables: bounded runs of one band value. Upper nodes of the index hold the bits that all members
share (a mask and its pattern). A pair of nodes whose shared bits already differ in more than
`radius` places is pruned; one whose members cannot differ in more is linked as a whole; any other
is opened, down to the fingerprints.

Only spanning links leave a task: a group of n near copies gives fewer than n links.

`keep_one` takes fingerprints as proposals only and compares the shingles of each proposed pair.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, documents_of, stored
from newsloom.llm.components import components

BITS = 64
SEED = 42
# A leaf table of the index holds at most this many fingerprints, an upper node 16 times fewer.
LEAF = 2_048
FANOUT = 16
# Node pairs opened at a time, so that a leaf never has all pairs of its members in memory.
OPENED = 1_024
CHUNK = 1 << 16
# Leading bits by which fingerprints are proposed to each other, at least; more rows need more.
BAND = 16
PLACES = 4
SIMILARITY = 0.8
# Bits in which a proposed pair may differ: of the 64 that lead to it, and of 128 of two others.
REACH = 16
SIDES = 2
SIDE_REACH = 42
# Sets of at least LONG shingles whose fingerprints differ in more bits than pairs at the asked
# similarity do, by so many standard deviations, are no pair; 0.1 % of such pairs lie beyond. For
# shorter sets, where few votes decide a bit, it is a fixed part of the bits.
LONG = 64
STRAY = 3.1
FAR = 0.25
# The part of pairs of exactly SIMILARITY that no band proposes.
MISSED = 0.01
# Fingerprints of the first comparison, and how far ahead in Gray order the next ones look.
FIRST_TURNS = 8
AHEAD = 4
# Untried neighbours of which a round looks at all fingerprints, for each set.
NEAREST = 3
# Rounds of comparisons with near neighbours: so many at most, and as long as one compared pair in GAIN links.
ROUNDS = 8
GAIN = 20
# Shingle hashes that a task holds of each side of a comparison of two leaves, in bytes and about.
BLOCK_BYTES = 32 << 20
# Entries of the index that a task of its sort should have.
SORT_ROWS = 1_000_000


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of every run of k words, lower-cased in A-Z; a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Hashes that are independent of `h` for each turn; turn 0 is `h` itself."""
    if turn == 0:
        return h
    h = h + np.uint64((turn * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of some hashes; 0 if there are none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), CHUNK):
        octets = h[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def simhash(text: str, k: int) -> int:
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int, turns: int = 1) -> DataFrame:
    """row, doc_id and `turns` fingerprints (signed longs) of every document; null texts are empty."""

    def task(batches):
        for batch in batches:
            values = []
            for text in batch["text"]:
                h = shingle_hashes(text, k)
                found = np.array([majority(_mixed(h, t)) for t in range(turns)], np.uint64)
                values.append(found.view(np.int64).tolist())
            yield {"row": batch["row"], "doc_id": batch["doc_id"], "fps": values}

    rows = documents_of(docs, F.monotonically_increasing_id().alias("row"))
    return arrow_rows(rows, task, "row long, doc_id long, fps array<long>")


def _bands(count: int) -> list[tuple[int, int]]:
    """First bit from the top, and width, of `count` bands of nearly equal width."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _gray_rank(value: Column) -> Column:
    """The place of a value in Gray order, as an unsigned 64-bit number."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value


def _turn(values: np.ndarray, left: int) -> np.ndarray:
    if left % BITS == 0:
        return values
    return (values << np.uint64(left)) | (values >> np.uint64(BITS - left))


def index_leaves(fps: DataFrame, radius: int) -> DataFrame:
    """The leaf tables of (turn, fp) rows: for every band of a turn, in Gray order.

    Bands are numbered through the turns. Each leaf has the bits that all its members share.
    """
    bands = _bands(radius + 1)
    spark = fps.sparkSession
    sign = F.lit(-(1 << 63))
    turns = F.array(*(
        F.struct(
            (F.col("turn") * len(bands) + band).alias("band"),
            (
                F.shiftleft("fp", left).bitwiseOR(F.shiftrightunsigned("fp", BITS - left))
                if left else F.col("fp")
            ).alias("turned"),
        )
        for band, (left, _) in enumerate(bands)
    ))
    ordered = fps.select(F.inline(turns)).withColumn(
        "rank", _gray_rank(F.col("turned")).bitwiseXOR(sign)
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "band", "rank").sortWithinPartitions("band", "rank")

    def task(batches):
        part, made = TaskContext.get().partitionId(), 0
        open_band, held = None, []

        def leaves(values: np.ndarray, width: int, last: bool):
            """Cuts at changes of the leading band value and at LEAF entries; returns the rest."""
            nonlocal made
            out = {n: [] for n in ("band", "key", "leaf", "fps", "shared_ones", "shared_zeros")}
            keys = values >> np.uint64(BITS - width)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            edges = [0, *cuts.tolist(), len(values)]
            rest = values[:0]
            for a, b in zip(edges, edges[1:]):
                for at in range(a, b, LEAF):
                    run = values[at : min(b, at + LEAF)]
                    if not last and b == len(values) and len(run) < LEAF:
                        rest = run
                        continue
                    out["band"].append(open_band)
                    out["key"].append(int(keys[a]))
                    out["leaf"].append((part << 32) + made)
                    out["fps"].append(run.view(np.int64).tolist())
                    out["shared_ones"].append(int(np.bitwise_and.reduce(run).view(np.int64)))
                    out["shared_zeros"].append(int((~np.bitwise_or.reduce(run)).view(np.int64)))
                    made += 1
            return out, rest

        for batch in batches:
            band = np.array(batch["band"])
            turned = np.array(batch["turned"], np.int64).view(np.uint64)
            for b in np.unique(band).tolist():
                if open_band is not None and b != open_band:
                    out, _ = leaves(held, bands[open_band % len(bands)][1], True)
                    yield out
                    held = []
                open_band = b
                run = turned[band == b]
                out, held = leaves(np.concatenate([held, run]) if len(held) else run, bands[b % len(bands)][1], False)
                yield out
        if len(held):
            out, _ = leaves(held, bands[open_band % len(bands)][1], True)
            yield out

    schema = "band int, key long, leaf long, fps array<long>, shared_ones long, shared_zeros long"
    return stored(arrow_rows(ordered, task, schema), "simhash-leaves")


def _nodes(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits set in all, and in any, of each run of `size` values."""
    at = np.arange(0, len(values), size)
    return np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of n entries is linked with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        root = root[root]
        if (root == before).all():
            break
    return root


def leaf_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index pairs into left, then right) within one leaf or between two.

    Walks pairs of upper nodes first: their shared bits bound the differences of all members.
    """
    alone = right is None
    other = left if alone else right
    base = 0 if alone else len(left)
    root = np.arange(base + len(other))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        held = np.flatnonzero(root != np.arange(len(root)))
        root = _roots(len(root), np.concatenate([held, a]), np.concatenate([root[held], b]))

    def walk(a: np.ndarray, b: np.ndarray, size: int) -> None:
        """Links the members of node pairs; opens at most OPENED pairs at a time."""
        if alone:
            keep = a <= b
            a, b = a[keep], b[keep]
        ones_l, any_l = _nodes(left, size)
        ones_r, any_r = _nodes(other, size)
        apart = (ones_l[a] & ~any_r[b]) | (ones_r[b] & ~any_l[a])
        near = np.bitwise_count(apart) <= radius
        a, b = a[near], b[near]
        if size == 1:
            if len(a):
                join(a, b + base)
            return
        open_bits = (any_l[a] | any_r[b]) & ~(ones_l[a] & ones_r[b])
        whole = np.bitwise_count(open_bits) <= radius
        for i, j in zip(a[whole].tolist(), b[whole].tolist()):
            mine = np.arange(i * size, min(len(left), (i + 1) * size))
            theirs = np.arange(j * size, min(len(other), (j + 1) * size)) + base
            members = np.concatenate([mine, theirs])
            join(np.full(len(members), members[0]), members)
        a, b = a[~whole], b[~whole]
        lower = size // FANOUT
        step = np.arange(FANOUT)
        for at in range(0, len(a), OPENED):
            mine = np.repeat((a[at : at + OPENED, None] * FANOUT + step).ravel(), FANOUT)
            theirs = np.tile(b[at : at + OPENED, None] * FANOUT + step, FANOUT).ravel()
            inside = (mine * lower < len(left)) & (theirs * lower < len(other))
            walk(mine[inside], theirs[inside], lower)

    size = FANOUT * FANOUT
    rows = np.arange(-(-len(left) // size))
    cols = np.arange(-(-len(other) // size))
    walk(*(g.ravel() for g in np.meshgrid(rows, cols, indexing="ij")), size)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (turn, a, b) of distinct (turn, fp) rows that span all pairs within `radius` bits."""
    leaves = index_leaves(fps, radius)
    bands = _bands(radius + 1)
    left, right = leaves.alias("l"), leaves.alias("r")
    apart = F.expr(
        "bit_count((l.shared_ones & r.shared_zeros) | (l.shared_zeros & r.shared_ones))"
    )
    heads = leaves.select("band", "key", "leaf", "shared_ones", "shared_zeros")
    pairs = heads.alias("l").join(
        heads.alias("r"),
        (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.leaf") < F.col("r.leaf")) & (apart <= radius),
    ).select("l.leaf", F.col("r.leaf").alias("leaf_r"))
    across = pairs.join(left.select("band", "leaf", F.col("fps").alias("fps_l")), "leaf").join(
        right.select(F.col("leaf").alias("leaf_r"), F.col("fps").alias("fps_r")), "leaf_r"
    ).select("band", "fps_l", "fps_r")
    within = leaves.select(
        "band", F.col("fps").alias("fps_l"), F.lit(None).cast("array<bigint>").alias("fps_r")
    ).filter(F.size("fps_l") > 1)

    def task(batches):
        for batch in batches:
            out_turn, out_a, out_b = [], [], []
            for band, fl, fr in zip(batch["band"], batch["fps_l"], batch["fps_r"]):
                x = np.array(fl, np.int64).view(np.uint64)
                y = None if fr is None else np.array(fr, np.int64).view(np.uint64)
                i, j = leaf_links(x, y, radius)
                if len(i):
                    both = _turn(x if y is None else np.concatenate([x, y]), BITS - bands[band % len(bands)][0])
                    both = both.view(np.int64)
                    out_turn += [band // len(bands)] * len(i)
                    out_a += both[i].tolist()
                    out_b += both[j].tolist()
            yield {"turn": out_turn, "a": out_a, "b": out_b}

    return arrow_rows(within.unionByName(across), task, "turn int, a long, b long")


def classes(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root): the component of every fingerprint."""
    firsts = fps.select(F.col("fps")[0].alias("fp")).distinct()
    links = near_links(firsts.select(F.lit(0).alias("turn"), "fp"), radius).select("a", "b")
    found = components(links, "simhash-components").withColumnRenamed("node", "fp")
    return firsts.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, turns: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    component_id is the least doc_id that links lead to. Null texts are empty, and a text without
    words has fingerprint 0, which links like any other. Repeated rows stay; a null doc_id belongs
    to a component and does not name it. An empty table gives no rows. With more `turns`, the
    fingerprints only propose pairs, and those of exactly SIMILARITY or more link, as in `keep_one`.
    """
    if turns > 1:
        turns = max(turns, turns_for(docs.count()))
        found, sets = distinct_sets(docs, k, turns)
        groups = verified_groups(docs, sets, k, turns, SIMILARITY).join(
            found.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(sets, "digest"), "id"
        )
        names = groups.groupBy("group").agg(F.min("first_id").alias("component_id"))
        named = groups.join(names, "group").select("digest", "component_id")
        rows = found.select("doc_id", "digest", F.col("fps")[0].alias("fp")).join(named, "digest")
    else:
        fps = stored(fingerprints(docs, k, turns), "simhash-fingerprints")
        least = fps.groupBy(F.col("fps")[0].alias("fp")).agg(F.min("doc_id").alias("first_id"))
        named = classes(fps, radius).join(least, "fp")
        names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        found = named.join(names, "root").select("fp", "component_id")
        rows = fps.select("doc_id", F.col("fps")[0].alias("fp")).join(found, "fp", "left")
    return rows.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _digest(octets: bytes) -> bytes:
    return hashlib.blake2b(octets, digest_size=16).digest()


def shingle_sets(docs: DataFrame, k: int, turns: int) -> DataFrame:
    """row, doc_id, digest and size of the set of shingles, and `turns` fingerprints of that set."""

    def task(batches):
        for batch in batches:
            digests, sizes, values = [], [], []
            for text in batch["text"]:
                h = np.unique(shingle_hashes(text, k))
                digests.append(_digest(h.tobytes()))
                sizes.append(len(h))
                found = np.array([majority(_mixed(h, t)) for t in range(turns)], np.uint64)
                values.append(found.view(np.int64).tolist())
            yield {"row": batch["row"], "doc_id": batch["doc_id"], "digest": digests, "size": sizes, "fps": values}

    rows = documents_of(docs, F.monotonically_increasing_id().alias("row"))
    return arrow_rows(rows, task, "row long, doc_id long, digest binary, size int, fps array<long>")


def band_width(rows: int) -> int:
    """Leading bits that `rows` random fingerprints seldom share with each other."""
    return max(BAND, min(BITS // 2, math.ceil(math.log2(max(2, rows)))))


def differing(similarity: float) -> float:
    """The chance that a bit differs between two equally large sets of Jaccard `similarity`."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def turns_for(rows: int, similarity: float = SIMILARITY) -> int:
    """Fingerprints that leave out MISSED of the pairs of `similarity`, at the width that `rows` ask for.

    Each fingerprint has PLACES bands.
    """
    shared = (1 - differing(similarity)) ** band_width(rows)
    return math.ceil(math.log(MISSED) / math.log(1 - shared) / PLACES) if shared < 1 else 1


def _entries(sets: DataFrame, turns: int) -> DataFrame:
    """The index entries of `sets` (id, group, fps), dealt and sorted by band and Gray rank.

    A band is a fingerprint and the place from which on its bits lead. The next SIDES fingerprints
    go along, for a closer look at a pair.
    """
    step = BITS // PLACES
    turned = F.array(*(
        F.struct(
            (F.col("turn") * PLACES + place).alias("band"),
            (
                F.shiftleft("fp", place * step).bitwiseOR(F.shiftrightunsigned("fp", BITS - place * step))
                if place else F.col("fp")
            ).alias("turned"),
        )
        for place in range(PLACES)
    ))
    sides = [
        F.get("fps", (F.col("turn") + k) % F.size("fps")).alias(f"side_{k}") for k in range(1, SIDES + 1)
    ]
    rows = sets.select("id", "group", "fps", F.posexplode(F.slice("fps", 1, turns)).alias("turn", "fp"))
    rows = rows.select("id", "group", *sides, F.inline(turned))
    rows = rows.withColumn("rank", _gray_rank(F.col("turned")).bitwiseXOR(F.lit(-(1 << 63))))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-sets.count() * turns * PLACES // SORT_ROWS))
    return rows.repartitionByRange(parts, "band", "rank").sortWithinPartitions("band", "rank").drop("rank")


_FINGERPRINTS = ("turned", *(f"side_{k}" for k in range(1, SIDES + 1)))
_ENTRY = ("id", "group", *_FINGERPRINTS)


def _chunks(batches, columns: tuple[str, ...]):
    """The batches of a task as dicts of long arrays, many rows at a time."""
    held, size = [], 0
    for batch in batches:
        held.append({n: np.array(batch[n], np.int64) for n in columns})
        size += len(held[-1]["id"])
        if size >= CHUNK:
            yield {n: np.concatenate([part[n] for part in held]) for n in columns}
            held, size = [], 0
    if held:
        yield {n: np.concatenate([part[n] for part in held]) for n in columns}


def _keys(rows: dict, width: int) -> np.ndarray:
    return rows["turned"].view(np.uint64) >> np.uint64(BITS - width)


def _runs(batches, width: int):
    """(rows, whether the run may go on in another task) of the runs of one band and key.

    Most entries are alone with their key. They are dropped all at once, except at the ends of the
    task, where a run may go on. Runs of at most FANOUT entries, which make one node, come many
    at a time, with None for their going on.
    """
    names = (*_ENTRY, "band")
    held, first = {n: np.empty(0, np.int64) for n in names}, True
    for chunk in _chunks(batches, names):
        held = {n: np.concatenate([held[n], chunk[n]]) for n in names}
        keys = _keys(held, width)
        cuts = np.flatnonzero((held["band"][1:] != held["band"][:-1]) | (keys[1:] != keys[:-1])) + 1
        edges = np.r_[0, cuts, len(keys)]
        whole = edges[:-1]
        if len(whole) == 1 and len(keys) < LEAF:
            continue
        sizes = np.diff(edges)
        small = (sizes > 1) & (sizes <= FANOUT)
        small[0] &= not first
        small[-1] = False
        if small.any():
            inside = np.repeat(small, sizes)
            yield {n: c[inside] for n, c in held.items()}, None
        for k in np.flatnonzero(~small & ((sizes > 1) | (whole == 0))).tolist():
            start, end = int(edges[k]), int(edges[k + 1])
            last = k == len(whole) - 1
            if last and end - start < LEAF:
                break
            for at in range(start, end, LEAF):
                # What is left of the last run waits for more of it.
                if last and end - at < LEAF:
                    break
                yield {n: held[n][at : min(end, at + LEAF)] for n in names}, first or last or end - start > LEAF
            first = False
        rest = int(edges[-2])
        if len(keys) - rest >= LEAF:
            rest += (len(keys) - rest) // LEAF * LEAF
            first = True
        else:
            first = first and len(whole) == 1
        held = {n: held[n][rest:] for n in names}
    if len(held["id"]):
        yield held, True


def _pairs_ahead(rows: dict, width: int, ahead: int):
    """(a, b) arrays, a < b, of near entries of one band and key at most `ahead` places apart."""
    keys = _keys(rows, width)
    for step in range(1, min(ahead, len(keys) - 1) + 1):
        at = np.flatnonzero((rows["band"][:-step] == rows["band"][step:]) & (keys[:-step] == keys[step:]))
        if not len(at):
            return
        left, right = {n: c[at] for n, c in rows.items()}, {n: c[at + step] for n, c in rows.items()}
        near = _close(left, right, REACH)
        x, y = left["id"][near], right["id"][near]
        yield np.minimum(x, y), np.maximum(x, y)


def _nearest_ahead(rows: dict, width: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) arrays, a < b: each entry with the nearest of the near ones at most `ahead` places from it."""
    a, b, _ = _nearest_places(rows, width, ahead)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _nearest_places(rows: dict, width: int, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, differing bits): each entry's nearest of the near ones at most `ahead` places from it.

    An entry gives one pair at most, however many entries share its key.
    """
    keys, none, span = _keys(rows, width), np.iinfo(np.int64).max, 2 * ahead + 1
    best = np.full(len(keys), none)
    for step in range(1, min(ahead, len(keys) - 1) + 1):
        at = np.flatnonzero((rows["band"][:-step] == rows["band"][step:]) & (keys[:-step] == keys[step:]))
        left, right = {n: c[at] for n, c in rows.items()}, {n: c[at + step] for n, c in rows.items()}
        near = _close(left, right, REACH)
        at, bits = at[near], sum(_differing(left, right, n)[near] for n in _FINGERPRINTS)
        best[at] = np.minimum(best[at], bits * span + ahead + step)
        best[at + step] = np.minimum(best[at + step], bits * span + ahead - step)
    found = np.flatnonzero(best < none)
    return rows["id"][found], rows["id"][found + best[found] % span - ahead], best[found] // span


def _neighbours(sets: DataFrame, turns: int, width: int, ahead: int) -> DataFrame:
    """(id, other, bits): each entry and the nearest in its key at most `ahead` places from it in Gray order."""

    def task(batches):
        names, before = (*_ENTRY, "band"), None
        for rows in _chunks(batches, names):
            if before is not None:
                rows = {n: np.concatenate([before[n], rows[n]]) for n in names}
            before = {n: c[-ahead:] for n, c in rows.items()}
            a, b, bits = _nearest_places(rows, width, ahead)
            yield {"id": a, "other": b, "bits": bits}

    return arrow_rows(_entries(sets, turns), task, "id long, other long, bits long", numbers=True)


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs a < b of rows (id, other)."""
    return rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def neighbour_pairs(sets: DataFrame, turns: int, width: int, ahead: int = 1) -> DataFrame:
    """Pairs a < b of entries and the nearest in their key at most `ahead` places apart in Gray order."""
    return _pairs(_neighbours(sets, turns, width, ahead))


def untried_pairs(sets: DataFrame, turns: int, width: int, ahead: int, tried: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of each set and the NEAREST of its neighbours in all bands that are not in `tried`.

    A set's neighbours, a few a band, and those it was tried with are one row each, so that what
    meets here grows with the sets, not with the pairs of a group.
    """
    found = _neighbours(sets, turns, width, ahead)
    ends = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("other"), "bits") for x, y in (("id", "other"), ("other", "id"))))
    found = found.select(F.inline(ends)).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("bits", "other"))).alias("near"))
    found = found.select("id", F.array_distinct(F.col("near")["other"]).alias("near"))
    if tried is not None:
        ends = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x, y in ("ab", "ba")))
        past = tried.select(F.inline(ends)).groupBy("id").agg(F.collect_set("other").alias("past"))
        found = found.join(past, "id", "left").withColumn("past", F.coalesce("past", F.array().cast("array<long>")))
        found = found.withColumn("near", F.array_except("near", "past"))
    return _pairs(found.select("id", F.explode(F.slice("near", 1, NEAREST)).alias("other")))


def _differing(left: dict, right: dict, name: str) -> np.ndarray:
    return np.bitwise_count((left[name] ^ right[name]).view(np.uint64)).astype(np.int64)


def _close(left: dict, right: dict, radius: int) -> np.ndarray:
    """Which pairs of entries are of two groups and near in their own and in the side fingerprints."""
    bits, *others = (_differing(left, right, n) for n in _FINGERPRINTS)
    sides = sum(others)
    return (left["group"] != right["group"]) & (bits <= radius) & (sides <= SIDE_REACH)


def walked_pairs(left: dict, right: dict | None, radius: int):
    """Near pairs of entries of one leaf or of two, some at a time, as two dicts of columns.

    Upper nodes hold the bits that their members share; node pairs whose shared bits differ in more
    than `radius` places, or that hold one and the same group only, are never opened.
    """
    alone, other = right is None, left if right is None else right
    x, y = left["turned"].view(np.uint64), other["turned"].view(np.uint64)

    def walk(a, b, size):
        if alone:
            keep = a <= b
            a, b = a[keep], b[keep]
        if size == 1:
            keep = a < b if alone else slice(None)
            mine = {n: c[a[keep]] for n, c in left.items()}
            theirs = {n: c[b[keep]] for n, c in other.items()}
            near = _close(mine, theirs, radius)
            yield {n: c[near] for n, c in mine.items()}, {n: c[near] for n, c in theirs.items()}
            return
        (ones_l, any_l), (ones_r, any_r) = _nodes(x, size), _nodes(y, size)
        apart = (ones_l[a] & ~any_r[b]) | (ones_r[b] & ~any_l[a])
        spans = []
        for groups in (left["group"], other["group"]):
            at = np.arange(0, len(groups), size)
            spans.append((np.minimum.reduceat(groups, at), np.maximum.reduceat(groups, at)))
        one_group = np.minimum(spans[0][0][a], spans[1][0][b]) == np.maximum(spans[0][1][a], spans[1][1][b])
        near = (np.bitwise_count(apart) <= radius) & ~one_group
        a, b = a[near], b[near]
        lower, step = size // FANOUT, np.arange(FANOUT)
        for at in range(0, len(a), OPENED):
            mine = np.repeat((a[at : at + OPENED, None] * FANOUT + step).ravel(), FANOUT)
            theirs = np.tile(b[at : at + OPENED, None] * FANOUT + step, FANOUT).ravel()
            inside = (mine * lower < len(x)) & (theirs * lower < len(y))
            yield from walk(mine[inside], theirs[inside], lower)

    size = FANOUT * FANOUT
    grid = np.meshgrid(np.arange(-(-len(x) // size)), np.arange(-(-len(y) // size)), indexing="ij")
    yield from walk(*(g.ravel() for g in grid), size)


def group_leaves(sets: DataFrame, turns: int, width: int) -> tuple[DataFrame, DataFrame]:
    """What may hold near pairs of entries that share the leading `width` bits of a band.

    Runs of one key are leaves of at most LEAF entries; those of one key meet in a join, pruned by
    the bits that each leaf's members share. Whole runs that make one node are opened where they
    stand, and runs of a single entry that cannot go on are left out. Returns the near pairs (a, b)
    of the opened runs, fewer than FANOUT for each entry, and the meetings (band, leaf, leaf_r,
    left, right) of leaves; `right` is null where a leaf meets itself.
    """
    def leaves(batches):
        part, made = TaskContext.get().partitionId(), 0
        for run, goes_on in _runs(batches, width):
            if goes_on is None:
                for a, b in _pairs_ahead(run, width, FANOUT - 1):
                    if len(a):
                        yield {n: [None] for n in ("band", "key", "leaf", "ones", "zeros", *_ENTRY)} | {"a": [a], "b": [b]}
                continue
            if len(run["id"]) < 2 and not goes_on:
                continue
            values = run["turned"]
            yield {
                "band": [int(run["band"][0])], "key": [int(_keys(run, width)[0])], "leaf": [(part << 32) + made],
                "ones": [int(np.bitwise_and.reduce(values))], "zeros": [int(~np.bitwise_or.reduce(values))],
                **{n: [run[n]] for n in _ENTRY}, "a": [None], "b": [None],
            }
            made += 1

    arrays = ", ".join(f"{n} array<long>" for n in _ENTRY)
    schema = f"band int, key long, leaf long, ones long, zeros long, {arrays}, a array<long>, b array<long>"
    found = stored(arrow_rows(_entries(sets, turns), leaves, schema, numbers=True), "simhash-leaves")
    opened = found.filter("leaf is null").select(F.inline(F.arrays_zip("a", "b")))
    found = found.filter("leaf is not null").drop("a", "b")
    heads = found.select("band", "key", "leaf", "ones", "zeros")
    apart = F.expr("bit_count((l.ones & r.zeros) | (l.zeros & r.ones))")
    meeting = heads.alias("l").join(
        heads.alias("r"),
        (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.leaf") < F.col("r.leaf")) & (apart <= REACH),
    ).select("l.leaf", F.col("r.leaf").alias("leaf_r"))
    entry = F.struct(*_ENTRY)
    across = meeting.join(found.select("band", "leaf", entry.alias("left")), "leaf").join(
        found.select(F.col("leaf").alias("leaf_r"), entry.alias("right")), "leaf_r"
    ).select("band", "leaf", "leaf_r", "left", "right")
    within = found.filter(F.size("id") > 1).select(
        "band", "leaf", F.col("leaf").alias("leaf_r"), entry.alias("left"),
        F.lit(None).cast(dict(across.dtypes)["right"]).alias("right"),
    )
    return opened, within.unionByName(across)


def _walked(left: dict, right: dict | None):
    """The near pairs of a meeting of leaves, some at a time."""
    return walked_pairs(*(
        None if leaf is None else {n: np.array(leaf[n], np.int64) for n in _ENTRY} for leaf in (left, right)
    ), REACH)


def group_pairs(sets: DataFrame, turns: int, width: int) -> DataFrame:
    """All near pairs a < b of entries of two groups that share the leading `width` bits of a band.

    They may be as many as the pairs of a large group; `leaf_members` and `block_links` compare the
    members of leaves without listing them.
    """
    opened, meetings = group_leaves(sets, turns, width)

    def task(batches):
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"]):
                for x, y in _walked(left, right):
                    yield {
                        "a": np.minimum(x["id"], y["id"]).tolist(), "b": np.maximum(x["id"], y["id"]).tolist()
                    }

    return arrow_rows(meetings.select("left", "right"), task, "a long, b long").unionByName(opened).distinct()


def leaf_members(meetings: DataFrame) -> DataFrame:
    """(band, leaf, leaf_r, of_right, id): the members of meetings that are near any other one there."""

    def task(batches):
        for batch in batches:
            for band, leaf, leaf_r, left, right in zip(*(batch[n] for n in ("band", "leaf", "leaf_r", "left", "right"))):
                found = [np.empty(0, np.int64)] * 2
                for pair in _walked(left, right):
                    found = [np.union1d(own, rows["id"]) for own, rows in zip(found, pair)]
                if right is None:
                    found = np.union1d(*found), found[0][:0]
                for of_right, ids in enumerate(found):
                    count = len(ids)
                    yield {
                        "band": [band] * count, "leaf": [leaf] * count, "leaf_r": [leaf_r] * count,
                        "of_right": [bool(of_right)] * count, "id": ids.tolist(),
                    }

    return arrow_rows(meetings, task, "band int, leaf long, leaf_r long, of_right boolean, id long")


def _of_each(rows: DataFrame) -> DataFrame:
    """(id, places): all rows of an id in one, so that joins by id have a row for each id."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(*(n for n in rows.columns if n != "id"))).alias("places"))


def _in_blocks(members: DataFrame) -> DataFrame:
    """`members` (with size) for each block i, j that they are in: parts of the left and the right side.

    A part holds the hashes of about BLOCK_BYTES or of a single set. Where a leaf meets itself, its
    parts meet each other, and themselves.
    """
    side = Window.partitionBy("leaf", "leaf_r", "of_right").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    meeting = Window.partitionBy("leaf", "leaf_r")
    before = F.coalesce(F.sum("size").over(side), F.lit(0))
    parted = members.withColumn("part", F.floor(8 * before / BLOCK_BYTES).cast("int"))
    parted = parted.withColumn("last", F.max(F.when(~F.col("of_right"), F.col("part"))).over(meeting))
    parted = parted.withColumn("last_r", F.max(F.when(F.col("of_right"), F.col("part"))).over(meeting))

    def as_left(first, last):
        return F.transform(
            F.sequence(first, last), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(False).alias("second"))
        )

    def as_right(last):
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(True).alias("second"))
        )

    own = as_left(F.col("part"), F.col("last"))
    own = F.when(F.col("part") > 0, F.concat(own, as_right(F.col("part") - 1))).otherwise(own)
    places = (
        F.when(F.col("leaf") == F.col("leaf_r"), own)
        .when(F.col("of_right"), as_right(F.col("last"))).otherwise(as_left(F.lit(0), F.col("last_r")))
    )
    return parted.select("band", "leaf", "leaf_r", "id", F.inline(places))


def _first_band(differ: np.ndarray, bits: np.ndarray, turns: int, width: int) -> np.ndarray:
    """The first band that proposes each pair, of the bits in which its fingerprints differ and their counts."""
    sides = sum(np.roll(bits, -k, axis=1) for k in range(1, SIDES + 1))
    near = (bits <= REACH) & (sides <= SIDE_REACH)
    near[:, turns:] = False
    led = [(_turn(differ, place * (BITS // PLACES)) >> np.uint64(BITS - width)) == 0 for place in range(PLACES)]
    proposed = near[:, :, None] & np.stack(led, axis=2)
    return proposed.reshape(len(bits), bits.shape[1] * PLACES).argmax(axis=1)


def _block_links(block: dict, turns: int, width: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning pairs of at least `similarity` between the groups of a block.

    Every pair is compared in the first band that proposes it, unless its groups are united by then.
    """
    prints = np.array(block["fps"], np.int64).view(np.uint64)
    turn, place = block["band"] // PLACES, block["band"] % PLACES
    turned = _turn(prints[:, turn], place * (BITS // PLACES))
    columns = {"id": np.arange(len(prints)), "group": np.array(block["group"], np.int64), "turned": turned.view(np.int64)}
    for k in range(1, SIDES + 1):
        columns[f"side_{k}"] = np.ascontiguousarray(prints[:, (turn + k) % prints.shape[1]]).view(np.int64)
    second, order = np.array(block["second"]), np.argsort(turned, kind="stable")
    left, right = ({n: c[order[second[order] == of]] for n, c in columns.items()} for of in (False, True))
    if block["i"] == block["j"] and block["leaf"] == block["leaf_r"]:
        right = None
    elif not len(left["id"]) or not len(right["id"]):
        return []
    sizes, hashes = np.array(block["size"]), [np.frombuffer(h, np.uint64) for h in block["hashes"]]
    chance, count = differing(similarity), BITS * prints.shape[1]
    long = chance + STRAY * math.sqrt(chance * (1 - chance) / count)
    root, links = {g: g for g in block["group"]}, []

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    for x, y in walked_pairs(left, right, REACH):
        for at in range(0, len(x["id"]), CHUNK):
            a, b = x["id"][at : at + CHUNK], y["id"][at : at + CHUNK]
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            fits = small >= similarity * large - 1e-9
            a, b, small = a[fits], b[fits], small[fits]
            differ = prints[a] ^ prints[b]
            bits = np.bitwise_count(differ).astype(np.int64)
            total = bits.sum(axis=1)
            near = total <= np.where(small >= LONG, long, FAR) * count
            near[near] = _first_band(differ[near], bits[near], turns, width) == block["band"]
            at_once = np.flatnonzero(near)
            for k in at_once[np.argsort(total[at_once], kind="stable")].tolist():
                i, j = int(a[k]), int(b[k])
                mine, theirs = find(block["group"][i]), find(block["group"][j])
                if mine != theirs and jaccard(hashes[i], hashes[j]) >= similarity:
                    root[mine] = theirs
                    links.append((block["id"][i], block["id"][j]))
    return links


def block_links(members: DataFrame, groups: DataFrame, sets: DataFrame, hashed: DataFrame,
                turns: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of at least `similarity` that span the groups that such pairs of `members` unite.

    Of the pairs of a meeting only spanning ones leave its task, however many are compared.
    """
    sizes = sets.select("id", "size")
    key = ("leaf", "leaf_r", "i", "j")
    sized = _of_each(members).join(sizes, "id").select("id", "size", F.inline("places"))
    placed = _of_each(_in_blocks(sized)).join(groups, "id").join(sizes, "id").join(hashed, "id")
    rows = placed.select("id", "group", "size", "fps", "hashes", F.inline("places"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *key).sortWithinPartitions(*key)
    fixed, names = ("band", *key), ("id", "group", "size", "fps", "second", "hashes")

    def task(batches):
        block = None

        def linked():
            pairs = _block_links(block, turns, width, similarity) if block else []
            return {"a": [min(p) for p in pairs], "b": [max(p) for p in pairs]}

        for batch in batches:
            for values in zip(*(batch[n] for n in (*fixed, *names))):
                head = values[: len(fixed)]
                if block is None or tuple(block[n] for n in fixed) != head:
                    yield linked()
                    block = dict(zip(fixed, head)) | {n: [] for n in names}
                for n, value in zip(names, values[len(fixed) :]):
                    block[n].append(value)
        yield linked()

    return arrow_rows(rows.select(*fixed, *names), task, "a long, b long")


def nearest_first(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """`pairs` with the bits in which all fingerprints differ; those far beyond any true pair go."""
    left = sets.select(F.col("id").alias("a"), F.col("fps").alias("fps_a"), F.col("size").alias("size_a"))
    right = sets.select(F.col("id").alias("b"), F.col("fps").alias("fps_b"), F.col("size").alias("size_b"))
    bits = F.aggregate(
        F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m
    )
    chance, count = differing(similarity), BITS * F.size("fps_a")
    long = chance + STRAY * F.sqrt(chance * (1 - chance) / count)
    far = F.when(F.least("size_a", "size_b") >= LONG, long).otherwise(FAR)
    found = pairs.join(left, "a").join(right, "b")
    # A set cannot be as similar to one that is so much smaller.
    found = found.filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9)
    found = found.select("a", "b", bits.alias("bits"), (far * count).alias("most"))
    return found.filter("bits <= most").select("a", "b", "bits")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted arrays without repeats; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def sorted_hashes(ids: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the sorted shingle hashes of the sets of some distinct ids, shingled once."""
    asked = sets.select("id", "digest").join(ids, "id", "left_semi")
    texts = documents_of(docs, F.monotonically_increasing_id().alias("id")).join(asked, "id")

    def hashes(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(text, k)).tobytes() for text in batch["text"]]
            for octets, digest in zip(found, batch["digest"]):
                if _digest(octets) != digest:
                    raise RuntimeError("rows are numbered otherwise than before; read them from files")
            yield {"id": batch["id"], "hashes": found}

    return stored(
        arrow_rows(texts.select("id", "digest", "text"), hashes, "id long, hashes binary"), "simhash-hashes"
    )


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, similarity: float,
             sorted_sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are as similar as asked, exactly.

    Texts that stand in a pair are shingled once, or come as `sorted_hashes`; these meet in the joins.
    """
    if sorted_sets is None:
        sorted_sets = sorted_hashes(_ends(pairs), docs, sets, k)
    left = sorted_sets.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a"))
    right = sorted_sets.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b"))

    def task(batches):
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(batch["a"], batch["b"], batch["hashes_a"], batch["hashes_b"]):
                if jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity:
                    a.append(i)
                    b.append(j)
            yield {"a": a, "b": b}

    return arrow_rows(pairs.select("a", "b").join(left, "a").join(right, "b"), task, "a long, b long")


def verified_groups(docs: DataFrame, sets: DataFrame, k: int, turns: int, similarity: float) -> DataFrame:
    """(id, group) of `sets`: components over pairs of at least `similarity`.

    First, in rounds, every set is compared with the nearest of its neighbours in Gray order that
    belongs to another group and was not compared with it yet, which unites large groups with few
    links a member. Then all candidates between two groups are compared; what the rounds leave
    open changes the work of that step, not its result.
    """
    def grouped(links: DataFrame) -> DataFrame:
        found = components(links, "simhash-components").select(F.col("node").alias("id"), F.col("root").alias("group"))
        return sets.select("id", "fps").join(found, "id", "left").withColumn("group", F.coalesce("group", "id"))

    def nearest(pairs: DataFrame) -> DataFrame:
        ends = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x, y in ("ab", "ba")))
        best = pairs.select("bits", F.inline(ends)).groupBy("id").agg(F.min(F.struct("bits", "other")).alias("best"))
        other = F.col("best.other")
        return best.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()

    width = band_width(sets.count())
    alone = sets.select("id", "fps", F.col("id").alias("group"))
    pairs = stored(
        nearest_first(untried_pairs(alone, min(turns, FIRST_TURNS), width, 1), sets, similarity), "simhash-near"
    )
    # Sets without any neighbour wait for the last step.
    near_ids = _ends(pairs)
    tried = stored(nearest(pairs), "simhash-near")
    linked = stored(verified(tried, docs, sets, k, similarity), "simhash-verified")
    for _ in range(1, ROUNDS):
        groups = stored(grouped(linked), "simhash-groups")
        pairs = untried_pairs(groups.join(near_ids, "id", "left_semi"), turns, width, AHEAD, tried)
        pairs = nearest_first(pairs, sets, similarity)
        pairs = stored(nearest(pairs), "simhash-near")
        found = stored(verified(pairs, docs, sets, k, similarity), "simhash-verified")
        gained, compared = found.count(), pairs.count()
        tried, linked = tried.unionByName(pairs), linked.unionByName(found)
        if gained * GAIN <= compared:
            break
    groups = stored(grouped(linked), "simhash-groups")
    opened, meetings = group_leaves(groups, turns, width)
    between = opened.distinct().join(tried, ["a", "b"], "left_anti")
    between = stored(nearest_first(between, sets, similarity).select("a", "b"), "simhash-between")
    members = stored(leaf_members(meetings), "simhash-members")
    hashed = sorted_hashes(_ends(between).unionByName(members.select("id")).distinct(), docs, sets, k)
    more = stored(verified(between, docs, sets, k, similarity, hashed), "simhash-verified")
    across = stored(block_links(members, groups, sets, hashed, turns, width, similarity), "simhash-verified")
    return grouped(linked.unionByName(more).unionByName(across)).select("id", "group")


def distinct_sets(docs: DataFrame, k: int, turns: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and the distinct ones (digest, id, place, size, fps), named by a least row."""
    found = stored(shingle_sets(docs, k, turns), "simhash-sets")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row")
    sets = found.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "size", "fps")).alias("least"))
    sets = sets.select(
        "digest", F.col("least.place.row").alias("id"), F.col("least.place").alias("place"),
        F.col("least.size").alias("size"), F.col("least.fps").alias("fps"),
    )
    return found, stored(sets, "simhash-distinct")


def keep_one(docs: DataFrame, k: int, turns: int, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each component the row of the least doc_id stays.

    Near copies share `similarity` of their distinct shingles, exactly: fingerprints only propose
    pairs, out of the Gray-ordered index. A pair is proposed if in one of the fingerprints a band of
    leading bits is the same and few of the others differ. Both the width of a band and the number
    of fingerprints (`turns` at least) grow with the logarithm of the number of rows, so that chance
    pairs stay few and MISSED of the pairs at a similarity of 0.8 are missed, fewer above.

    All columns stay, whatever their names. Rows of equal ids are told apart by their place in the
    input, so of repeated rows one stays; null texts are empty texts, which are copies of each
    other; null ids come last. `docs` must be read from files, so that places are the same in each
    pass; a different order is an error where it would matter.
    """
    turns = max(turns, turns_for(docs.count(), similarity))
    _, sets = distinct_sets(docs, k, turns)
    groups = verified_groups(docs, sets, k, turns, similarity)
    kept = groups.join(sets.select("id", "place"), "id").groupBy("group").agg(F.min("place").alias("first"))
    row = "_row"
    while row in docs.columns:
        row += "_"
    kept = kept.select(F.col("first.row").alias(row))
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    return rows.join(kept, row, "left_semi").drop(row)
