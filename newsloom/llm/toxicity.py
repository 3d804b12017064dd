"""Toxic text by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one that adds to it passages
typical of toxic text. A text is cut into windows; each window is compressed with either, and the
bytes that the toxic dictionary saves are its distance. Statistics of a text's distances go
through a logistic curve, fitted on labelled rows that the dictionaries have not seen, which makes
the score a number from 0 to 1; the curve is placed so that the threshold loses a stated part of
ordinary rows.

Dictionaries are small and matches at least MIN_MATCH bytes long: short chance matches, which
ordinary words are full of, then do not count.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, documents_of

# The bounded sample of labelled rows that a model is fitted on: about so many rows of each kind,
# chosen by a hash of the id, of texts up to so many characters.
FIT_TOXIC = 4_000
FIT_ORDINARY = 8_000
FIT_CHARS = 8_000
# Windows of a text, and how far they reach into the next one, in bytes.
WINDOW = 128
OVERLAP = 16
# Dictionaries: bytes of ordinary text, and of toxic passages on top.
ORDINARY_BYTES = 1_024
TOXIC_BYTES = 4_000
MIN_MATCH = 6
# A term is typical of toxic text if it has at least so many contexts, mostly different ones (else
# it comes from copies of a text), and so many times its share of ordinary texts.
MIN_CONTEXTS = 5
DISTINCT_CONTEXTS = 0.7
MIN_ODDS = 10.0
# The score of rejection, and the part of ordinary calibration rows that may reach it.
THRESHOLD = 0.7
ORDINARY_LOSS = 0.03


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a logistic curve; `constant` stands in where nothing can be fitted."""

    ordinary: bytes = b""
    toxic: bytes = b""
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None


def windows(text: str) -> list[bytes]:
    octets = text.lower().encode("utf-8")
    return [octets[i : i + WINDOW + OVERLAP] for i in range(0, max(1, len(octets)), WINDOW)]


class Distance:
    """Byte savings of the toxic over the ordinary dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        settings = zstd.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=5, min_match=MIN_MATCH,
            target_length=0, strategy=zstd.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.sizes = []
        for content in (ordinary, toxic):
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.sizes.append(zstd.ZstdCompressor(dict_data=held, compression_params=settings).compress)

    def features(self, text: str) -> list[float]:
        """Mean, scaled sum, best three, share of large, mean large and best savings."""
        plain, toxic = self.sizes
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)
        size = max(1, len(text.encode("utf-8")))
        best = np.sort(saved)[::-1]
        return [
            saved.sum() / size * 100, saved.sum() / size**0.5, best[:3].mean(),
            (saved >= 3).mean(), np.maximum(saved - 1, 0).sum() / size * 100, best[0],
        ]


def typical_terms(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words that mark toxic texts, by their share of texts and by how varied their contexts are."""
    in_toxic = Counter(w for words in toxic for w in set(words))
    in_ordinary = Counter(w for words in ordinary for w in set(words))

    def odds(word: bytes) -> float:
        share = (in_toxic[word] + 0.5) / (len(toxic) + 1)
        return share / ((in_ordinary[word] + 0.5) / (len(ordinary) + 1))

    marked = {w for w, n in in_toxic.items() if n >= MIN_CONTEXTS and odds(w) >= MIN_ODDS}
    contexts = defaultdict(set)
    for words in toxic:
        for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
            if word in marked:
                contexts[word].add((before, after))
    return {
        w for w, seen in contexts.items()
        if len(seen) >= max(MIN_CONTEXTS, DISTINCT_CONTEXTS * in_toxic[w])
    }


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on samples; the samples' end if they are too few."""
    try:
        return zstd.train_dictionary(size + 1_200, samples).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def fit(rows: list[tuple[int, str, int]], seed: int = 7) -> Model:
    """A model of (doc_id, text, 0 or 1) rows: dictionaries from one half, curve from the other."""
    rows = sorted(rows)
    random.Random(seed).shuffle(rows)
    half = len(rows) // 2
    learn, calibrate = rows[:half], rows[half:]
    share = sum(y for _, _, y in rows) / len(rows) if rows else 0.0
    texts = [[t for _, t, y in learn if y == kind] for kind in (0, 1)]
    if not all(texts) or len({y for _, _, y in calibrate}) < 2:
        return Model(constant=share)
    words = [[t.lower().encode("utf-8").split() for t in kind] for kind in texts]
    terms = typical_terms(words[1], words[0])
    passages = [
        b" " + w + b" " for t in texts[1] for w in t.lower().encode("utf-8").split() if w in terms
    ]
    plain = [w for t in texts[0] for w in windows(t)]
    ordinary = _trained(plain[:40_000], ORDINARY_BYTES)
    toxic = ordinary + _trained(passages or windows(texts[1][0]), TOXIC_BYTES)

    distance = Distance(ordinary, toxic)
    seen = np.array([distance.features(t) for _, t, _ in calibrate])
    label = np.array([y for _, _, y in calibrate], float)
    centre, spread = seen.mean(axis=0), seen.std(axis=0) + 1e-9
    design = np.column_stack([(seen - centre) / spread, np.ones(len(seen))])
    weights = np.zeros(design.shape[1])
    ridge = 1e-2 * np.eye(len(weights))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        weights += np.linalg.solve(curve, design.T @ (label - p) - ridge @ weights)
    # Few toxic rows leave the curve below the threshold almost everywhere. It is moved, which keeps
    # its order, to where the ordinary calibration rows that may be lost begin.
    ordinary_rows = np.sort((design @ weights)[label == 0])
    bar = ordinary_rows[int((1 - ORDINARY_LOSS) * (len(ordinary_rows) - 1))]
    weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - bar - 1e-6
    return Model(ordinary, toxic, tuple(centre), tuple(spread), tuple(weights))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.constant is None:
            self.distance = Distance(model.ordinary, model.toxic)

    def score(self, text: str) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        seen = (np.array(self.distance.features(text)) - m.centre) / np.array(m.spread)
        z = float(seen @ np.array(m.weights[:-1]) + m.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo `divisor`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model of the `usable` labelled rows; of several labels of a document the highest counts.

    Only ids and labels are counted over all rows. The sample's ids are broadcast: their number is
    bounded by FIT_TOXIC and FIT_ORDINARY, of which it exceeds the sum by chance only.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"] > 0): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    kept = known.filter(
        place < F.when(F.col("toxic") > 0, FIT_TOXIC / max(1, counts.get(1, 0)))
        .otherwise(FIT_ORDINARY / max(1, counts.get(0, 0)))
    )
    rows = documents_of(docs).filter(F.char_length("text") <= FIT_CHARS).join(
        F.broadcast(kept), "doc_id"
    )
    return fit([(r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows.collect()])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every whole text.

    Null texts are empty; an empty text has the score of its single empty window. Rows are
    independent, so repeated rows, null ids and an empty table need no care.
    """

    def task(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch["text"]]
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield {"doc_id": batch["doc_id"], "score": scores, "predicted": predicted}

    return arrow_rows(documents_of(docs), task, "doc_id long, score double, predicted int")


def keep_unrejected(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays below the threshold, with all columns; one narrow pass."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            kept = [scorer.score(t or "") < THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels are learnt from rows not held out."""
    model = learn(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    scored = score_documents(docs, model)
    return scored.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
