"""The pipeline's stages on a small table, each against its operator or a plain rule."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from newsloom.llm import decontaminate, simhash
from newsloom.llm.common import load, prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    prepare(spark)
    docs, results = load(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        results[name] = (before, docs)
    return results


def test_filters_keep_columns_and_only_drop(stages):
    for name in ("toxicity", "simhash_near_dedup", "benchmark_decontamination"):
        before, after = stages[name]
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash_near_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    kept = [r.doc_id for r in after.collect()]
    assert len({texts[i] for i in kept}) == len(kept)
    groups = simhash.near_duplicates(before, 5, 4, corpus_pipeline.TURNS).collect()
    assert sorted(kept) == sorted({r.component_id for r in groups})


def test_no_benchmark_item_is_left(stages, spark):
    _, after = stages["benchmark_decontamination"]
    assert decontaminate.find_contaminated(after, load(spark, SF, "benchmark")).count() == 0


def test_last_stage_decodes_to_its_input(stages):
    before, after = stages["byte_level_bpe"]
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def planted(seed: int = 5) -> list[str]:
    """Pairs of random texts whose similarity lies around the bar, and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = []
    for n in range(240):
        base = [word() for _ in range(300)]
        other = list(base)
        # Words at the end fall away or are new, which sets the share of common runs.
        cut = rng.randint(5, 60)
        other[-cut:] = [word() for _ in range(cut if n % 2 else 0)]
        texts += [" ".join(base), " ".join(other)]
    return texts + ["a b c d e f g h", "a b c d e f g h", "", None]


def test_near_copies_are_those_of_the_exact_similarity(spark, tmp_path):
    texts = planted()
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    runs = [set(simhash.shingle_hashes(t or "", 5).tolist()) for t in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    repeated = {i for i in range(1, len(texts), 2) if near(runs[i - 1], runs[i])}
    assert 60 < len(repeated) < 220
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert len(repeated & kept) <= 0.02 * len(repeated)
    assert set(range(len(texts))) - kept <= repeated


def test_near_copies_chain_and_large_groups(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(700)]
    chain = [" ".join(words[20 * i : 20 * i + 400]) for i in range(12)]
    base = [f"g{i}" for i in range(400)]
    group = []
    for _ in range(150):
        other = list(base)
        other[rng.randrange(400)] = "x%d" % rng.randrange(10**6)
        group.append(" ".join(other))
    rows = list(enumerate(chain + group))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert kept == [0, len(chain)]
