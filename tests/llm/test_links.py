"""Components, and the index that proposes near copies, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from newsloom.llm import components, simhash
from newsloom.llm.common import prepare


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def plain_roots(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("size", [3, 40, 10_000])
def test_components(session, size):
    rng = random.Random(size)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, n) for n in range(500, 620)]
    mixed = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(130)]
    links = path + star + [(b, a) for a, b in star[:20]] + mixed + [(5, 5), (-3, 2**40)]
    rng.shuffle(links)
    rows = session.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(rows, size=size).collect()}
    assert found == plain_roots((a, b) for a, b in links if a != b)


def test_components_of_nothing(session):
    for links in ([], [(1, 1)]):
        rows = session.createDataFrame(links, "a long, b long")
        assert components.components(rows).collect() == []


@pytest.mark.parametrize("leaf", [simhash.LEAF, 32])
def test_index_proposes_all_near_pairs_of_a_band(session, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(leaf)
    turns, width, fps = 3, 16, []
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in range(turns)]
        for _ in range(rng.randint(1, 60)):
            fps.append([v ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (2**64 - 1) for v in base])
    groups = [rng.choice([i, i, i // 8 * 8]) for i in range(len(fps))]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    sets = session.createDataFrame(list(zip(range(len(fps)), signed, groups)), "id long, fps array<long>, group long")

    def bits(x, y):
        return (x ^ y).bit_count()

    def led(v, place):
        left = 16 * place
        return ((v << left | v >> (64 - left)) & (2**64 - 1)) >> (64 - width)

    expected = set()
    for a in range(len(fps)):
        for b in range(a + 1, len(fps)):
            x, y = fps[a], fps[b]
            for t in range(turns):
                sides = sum(bits(x[(t + k) % turns], y[(t + k) % turns]) for k in (1, 2))
                near = bits(x[t], y[t]) <= simhash.REACH and sides <= simhash.SIDE_REACH
                if near and groups[a] != groups[b] and any(led(x[t], p) == led(y[t], p) for p in range(4)):
                    expected.add((a, b))
    found = {(r["a"], r["b"]) for r in simhash.group_pairs(sets, turns, width).collect()}
    assert len(expected) > 500 and found == expected
    beside = {(r["a"], r["b"]) for r in simhash.neighbour_pairs(sets, turns, width).collect()}
    assert beside <= expected and len(beside) < 12 * len(fps)


def test_width_and_turns_grow_with_the_rows():
    assert [simhash.band_width(n) for n in (0, 1000, 10**6, 10**9)] == [16, 16, 20, 30]
    for rows in (1000, 10**6):
        missed = (1 - (1 - 0.1517) ** simhash.band_width(rows)) ** (4 * simhash.turns_for(rows))
        assert missed <= 0.0101


def test_changed_numbers_of_rows_are_an_error(session, tmp_path):
    rows = [(i, f"a b c d e f {i}") for i in range(6)]
    session.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = session.read.parquet(f"{tmp_path}/d")
    _, sets = simhash.distinct_sets(docs, 5, 2)
    pairs = session.createDataFrame([(0, 1)], "a long, b long")
    other = session.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="numbered otherwise"):
        simhash.verified(pairs, other, sets, 5, 0.8).collect()


def test_names_of_columns_stay(session, tmp_path):
    rows = [(1, "same words in this text", "x"), (2, "same words in this text", "y"), (3, None, None)]
    session.createDataFrame(rows, "doc_id long, text string, _row string").write.parquet(f"{tmp_path}/d")
    kept = simhash.keep_one(session.read.parquet(f"{tmp_path}/d"), 5, 2)
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_each_entry_gives_one_neighbour_pair():
    """However many near entries share a key, an entry is paired with its nearest only."""
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(3)]
    size, ahead = 200, 4
    noise = lambda k: sum(1 << b for b in rng.sample(range(40), rng.randint(0, k)))
    rows = {"id": range(size), "group": range(size), "band": [0] * size, "turned": [base[0] ^ noise(6) for _ in range(size)]}
    rows |= {f"side_{k}": [base[k] ^ noise(6) for _ in range(size)] for k in (1, 2)}
    rows = {n: np.array(list(c), np.int64) for n, c in rows.items()}
    a, b = simhash._nearest_ahead(rows, 16, ahead)
    bits = lambda i, j: sum(int(rows[n][i] ^ rows[n][j]).bit_count() for n in simhash._FINGERPRINTS)
    allowed = {(min(x, y), max(x, y)) for p in simhash._pairs_ahead(rows, 16, ahead) for x, y in zip(*map(list, p))}
    assert len(a) <= size < len(allowed) and set(zip(a.tolist(), b.tolist())) <= allowed
    for i in range(size):
        near = [bits(i, j) for j in range(size) if (min(i, j), max(i, j)) in allowed]
        mine = [bits(x, y) for x, y in zip(a.tolist(), b.tolist()) if i in (x, y)]
        assert min(mine, default=None) == min(near, default=None)


@pytest.mark.parametrize("leaf, block", [(simhash.LEAF, simhash.BLOCK_BYTES), (48, 12_000)])
def test_large_groups_list_no_pairs(session, tmp_path, monkeypatch, leaf, block):
    """Texts that hardly are near copies: groups as over all proposed pairs, but rows as the index entries."""
    rng, turns, width = random.Random(leaf), 4, 16
    base, count = [f"w{i}" for i in range(100)], 260
    texts = []
    for i in range(count):
        words = list(base)
        for k in range(rng.choice([1, 1, 2, 2, 3])):
            words[rng.randrange(100)] = f"x{i}-{k}"
        texts.append(" ".join(words))
    rows = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = session.read.parquet(f"{tmp_path}/d")
    _, sets = simhash.distinct_sets(docs, 5, turns)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    alone = sets.selectExpr("id", "fps", "id AS group")
    proposed = simhash.nearest_first(simhash.group_pairs(alone, turns, width), sets, 0.8).collect()
    shingles = {r["id"]: simhash.shingle_hashes(texts[r["place"]["doc_id"]], 5) for r in sets.collect()}
    links = [
        (r["a"], r["b"]) for r in proposed
        if simhash.jaccard(np.unique(shingles[r["a"]]), np.unique(shingles[r["b"]])) >= 0.8
    ]
    entries = turns * simhash.PLACES * count
    assert len(proposed) > 2 * entries > 0 < len(links)

    counts, stored = [], simhash.stored

    def counted(df, purpose):
        found = stored(df, purpose)
        counts.append(found.count())
        return found

    monkeypatch.setattr(simhash, "stored", counted)
    found = {r["id"]: r["group"] for r in simhash.verified_groups(docs, sets, 5, turns, 0.8).collect()}
    assert found == {i: i for i in shingles} | plain_roots(links)
    assert max(counts) <= entries * (1 if leaf == simhash.LEAF else -(-count // leaf))


def test_untried_pairs_grow_with_the_sets(session):
    """A set offers its nearest neighbours only, over all bands, and none that it was compared with."""
    rng, turns, count = random.Random(9), 6, 150
    base = [rng.getrandbits(64) for _ in range(turns)]
    fps = [[v ^ sum(1 << b for b in rng.sample(range(64), 3)) for v in base] for _ in range(count)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    sets = session.createDataFrame([(i, f, i) for i, f in enumerate(signed)], "id long, fps array<long>, group long")
    near = {(r["a"], r["b"]) for r in simhash.group_pairs(sets, turns, 16).collect()}
    beside = simhash.neighbour_pairs(sets, turns, 16, 4).count()
    first = {(r["a"], r["b"]) for r in simhash.untried_pairs(sets, turns, 16, 4).collect()}
    assert first < near and len(first) <= simhash.NEAREST * count < beside
    tried = session.createDataFrame(sorted(first), "a long, b long")
    second = {(r["a"], r["b"]) for r in simhash.untried_pairs(sets, turns, 16, 4, tried).collect()}
    assert second <= near - first and count / 2 <= len(second) <= simhash.NEAREST * count


def test_stored_tables_leave_no_shuffle_files(session):
    """What was shuffled for a stored table is gone from the disk with the write."""
    def files():
        manager = session.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return manager.getAllFiles().size()

    rows = session.range(1000).selectExpr("id % 7 AS a", "id AS b")
    before = files()
    found = simhash.stored(rows.groupBy("a").count(), "shuffled")
    assert sorted(r["count"] for r in found.collect()) == [142] + [143] * 6
    assert files() <= before
