"""Queries of these operators over whole tables, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    brown_lm,
    byte_bpe,
    chat,
    decontaminate,
    importance,
    page_text,
    pii,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    whitening,
    winnowing,
)
from newsloom.llm.common import load, prepare

Query = Callable[[SparkSession, str], DataFrame]

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNTED_VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024

_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, all stages."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; words in runs of four, four bits apart."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), k=4, radius=4)


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of encoded and decoded documents."""
    path = public_tokenizers.path(BPE_RANKS)
    done = byte_bpe.round_trip(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its roles repaired at least cost, rendered turn by turn."""
    return chat.repair(load(spark, sf_dir, "conversations"))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts, and what of each text fits the limit."""
    path = public_tokenizers.path(COUNTED_VOCABULARY)
    docs = load(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, TOKEN_LIMIT)


@_query
def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based bigram scores of all documents, from nine tenths of them."""
    return brown_lm.score_held_out(load(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.find_contaminated(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    )


@_query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by pattern and by what terms reveal."""
    return pii.digests(pii.find_personal_data(load(spark, sf_dir, "documents")))


@_query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without passages of 400 bytes that occur again."""
    done = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents from labels of two thirds of them."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


@_query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of texts and their edits."""
    return winnowing.edited_fingerprints(load(spark, sf_dir, "documents"))


@_query
def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_text.main_text(load(spark, sf_dir, "pages"))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding along the whitened leading components."""
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents towards the benchmark's word runs, and the ranks of those drawn."""
    return importance.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
