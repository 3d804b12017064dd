"""Byte-level BPE encoding and decoding with published ranks.

Text is split by the vocabulary's pattern; each piece starts as its single bytes. Merges follow
the rank order: always the pair of least rank, the leftmost of equal ones. A segment tree over a
piece's byte positions holds at each position the rank of the pair that starts there, and its
root the leftmost minimum, so a merge is a few point updates of logarithmic cost, on the merged
position, the absorbed one and the left neighbour. A piece of n bytes costs O(n log n).

Pieces repeat, so each task remembers the ids of short pieces, in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain

import regex
from pyspark.sql import DataFrame

from newsloom.llm.common import arrow_rows, documents_of

NO_PAIR = 1 << 40
FANOUT = 16
# A task remembers at most this many pieces, none longer than REMEMBERED_BYTES.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and a number on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class MinTree:
    """Leftmost minimum over fixed positions, with point updates; FANOUT children a node."""

    def __init__(self, values: list[int]):
        self.levels = [values]
        while len(values) > FANOUT:
            values = [min(values[i : i + FANOUT]) for i in range(0, len(values), FANOUT)]
            self.levels.append(values)

    def set(self, at: int, value: int) -> None:
        below = self.levels[0]
        below[at] = value
        for level in self.levels[1:]:
            at //= FANOUT
            low = min(below[at * FANOUT : (at + 1) * FANOUT])
            if level[at] == low:
                return
            level[at] = low
            below = level

    def leftmost(self) -> int:
        """The first position that holds the minimum, -1 if no pair is left."""
        top = self.levels[-1]
        low = min(top)
        if low == NO_PAIR:
            return -1
        at = top.index(low)
        for level in self.levels[-2::-1]:
            at = level.index(low, at * FANOUT)
        return at


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    # Live parts are linked: `after` and `before` skip absorbed positions.
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    rank = ranks.get
    tree = MinTree([rank(piece[i : i + 2], NO_PAIR) for i in range(n - 1)] + [NO_PAIR])
    if n <= FANOUT:
        # The tree is its root: the same steps without calls.
        pairs = tree.levels[0]
        while (low := min(pairs)) != NO_PAIR:
            at = pairs.index(low)
            gone = after[at]
            end = after[at] = after[gone]
            pairs[gone] = NO_PAIR
            if end < n:
                before[end] = at
                pairs[at] = rank(piece[at : after[end]], NO_PAIR)
            else:
                pairs[at] = NO_PAIR
            left = before[at]
            if left >= 0:
                pairs[left] = rank(piece[left:end], NO_PAIR)
    while (at := tree.leftmost()) >= 0:
        gone = after[at]
        end = after[at] = after[gone]
        tree.set(gone, NO_PAIR)
        if end < n:
            before[end] = at
            tree.set(at, rank(piece[at : after[end]], NO_PAIR))
        else:
            tree.set(at, NO_PAIR)
        left = before[at]
        if left >= 0:
            tree.set(left, rank(piece[left:end], NO_PAIR))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Pieces(dict):
    """Ids by piece; fills itself, and starts anew when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        octets = piece.encode("utf-8")
        ids = merge_piece(octets, self.ranks)
        if len(octets) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """An encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(ranks)
        self.octets = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.octets.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every whole text.

    Null and empty texts have no ids. Rows are independent: repeated rows, null ids and an empty
    table need no care. `path` names a rank file that every executor has.
    """

    def task(batches):
        bpe = ByteBpe(read_ranks(path), pattern)
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "ids": [bpe.encode(t) for t in batch["text"]]}

    return arrow_rows(documents_of(docs), task, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of ids; null ids decode to nothing."""

    def task(batches):
        bpe = ByteBpe(read_ranks(path), pattern)
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "decoded": [bpe.decode(i or []) for i in batch["ids"]]}

    return arrow_rows(encoded.select("doc_id", "ids"), task, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """Encodes and decodes in one pass: token count, digests of ids and bytes, decoded text.

    Ids are digested as little-endian unsigned 32-bit numbers. `keep` names further columns of
    the documents to return.
    """
    rows = documents_of(docs, *[docs[c] for c in keep])
    schema = ", ".join([
        "doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", "decoded string",
        *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep),
    ])

    def task(batches):
        bpe = ByteBpe(read_ranks(path), pattern)
        for batch in batches:
            out = {n: [] for n in ("n_tokens", "ids_sha256", "decoded_sha256", "decoded")}
            for text in batch["text"]:
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                packed = array("I", ids)
                if array("I", [1]).tobytes() != b"\x01\x00\x00\x00":
                    packed.byteswap()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(packed.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                out["decoded"].append(decoded.decode("utf-8"))
            yield {"doc_id": batch["doc_id"], **out, **{c: batch[c] for c in keep}}

    return arrow_rows(rows, task, schema)
