"""Exact token counts at every prefix of a text, by dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours are: when
the bytes of both together encode to just these two. So each prefix of a piece has one last token,
the only one whose predecessor, the last token of what is left, agrees with it, and

    count(prefix) = count(prefix without its last token) + 1.

A text's count at the end of a piece is the sum over pieces. Cuts inside a piece read that piece's
table; only blanks and contractions split otherwise when cut, which `PrefixCounts.at` allows for.
Truncation and budget questions are then lookups; nothing is encoded again.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from newsloom.llm.common import arrow_rows, documents_of

# A task remembers at most this many pieces, none longer than REMEMBERED_BYTES,
# this many prefixes of such pieces, and this many pairs of tokens.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64
REMEMBERED_PREFIXES = 400_000
REMEMBERED_PAIRS = 400_000
# Bytes that a token's end is looked up by, and the lengths of tokens without such an end.
TAIL = 4
SHORT = tuple(range(TAIL - 1, 0, -1))


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Merge ranks by token bytes, and special strings, of a byte-level BPE `tokenizer.json`.

    Single bytes rank below all merges; tokens that no merge makes are left out.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    octets = lambda token: bytes(letters[c] for c in token)
    ranks = {bytes([b]): b - 256 for b in range(256)}
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(octets(left) + octets(right), rank)
    return ranks, [t["content"] for t in spec["added_tokens"]]


class PrefixTable:
    """For a piece (bytes), the token count at every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # By the last TAIL bytes of tokens, how long they are, longest first; shorter ones may end anywhere.
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= TAIL:
                tails.setdefault(token[-TAIL:], set(SHORT)).add(len(token))
        self.tails = {tail: tuple(sorted(lengths, reverse=True)) for tail, lengths in tails.items()}
        # At most one entry for each token of the vocabulary.
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.agreed: dict[bytes, dict[bytes, bool]] = {}
        self.agreed_size = 0
        # The last token of prefixes, which many pieces share.
        self.lasts: dict[bytes, bytes] = {}

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes a token; None if merging ends elsewhere."""
        if token in self.halves:
            return self.halves[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        none = len(self.ranks)
        while len(parts) > 2:
            pairs = [self.ranks.get(x + y, none) for x, y in zip(parts, parts[1:])]
            low = min(pairs)
            if low == none:
                break
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        made = (parts[0], parts[1]) if len(parts) == 2 else None
        self.halves[token] = made
        return made

    def _agree(self, left: bytes, right: bytes) -> bool:
        """Whether merging the bytes of two tokens gives these two again.

        Merges run in rank order, so while `left` and `right` grow from bytes, its last and its
        first part live side by side for a time. They would merge over the border if their pair
        ranks before the merges that end either part; at the same rank the one further left goes.
        """
        ranks = self.ranks
        none = len(ranks)
        lefts = [left]
        while len(lefts[-1]) > 1:
            lefts.append(self._split(lefts[-1])[1])
        rights = [right]
        while len(rights[-1]) > 1:
            rights.append(self._split(rights[-1])[0])
        x, y = lefts.pop(), rights.pop()
        while True:
            grows_x = ranks[lefts[-1]] if lefts else none
            grows_y = ranks[rights[-1]] if rights else none
            across = ranks.get(x + y, none)
            if across < grows_x and across <= grows_y and across < none:
                return False
            if grows_x == none and grows_y == none:
                return True
            if grows_x <= grows_y:
                x = lefts.pop()
            else:
                y = rights.pop()

    def _check(self, left: bytes, right: bytes) -> bool:
        """Whether `right` is a token that may follow `left`; remembered within bounds."""
        if self.agreed_size >= REMEMBERED_PAIRS:
            self.agreed.clear()
            self.agreed_size = 0
        token = len(right) == 1 or self._split(right) is not None
        known = token and (not left or self._agree(left, right))
        self.agreed.setdefault(left, {})[right] = known
        self.agreed_size += 1
        return known

    def counts(self, piece: bytes) -> list[int]:
        ranks, tails, agreed, lasts = self.ranks, self.tails, self.agreed, self.lasts
        last, counts = [b""], [0]
        for end in range(1, min(len(piece), REMEMBERED_BYTES) + 1):
            token = lasts.get(piece[:end])
            if token is None:
                break
            last.append(token)
            counts.append(counts[end - len(token)] + 1)
        if len(lasts) + len(piece) > REMEMBERED_PREFIXES:
            lasts.clear()
        for end in range(len(last), len(piece) + 1):
            for length in tails.get(piece[end - TAIL : end] if end >= TAIL else b"", SHORT):
                start = end - length
                if start < 0:
                    continue
                token = piece[start:end]
                if token not in ranks:
                    continue
                left = last[start]
                known = agreed[left].get(token) if left in agreed else None
                if known is None:
                    known = self._check(left, token)
                if known:
                    last.append(token)
                    counts.append(counts[start] + 1)
                    if end <= REMEMBERED_BYTES:
                        lasts[piece[:end]] = token
                    break
            else:
                raise ValueError("the vocabulary does not cover all bytes")
        return counts


class PrefixCounts:
    """The token counts of all prefixes of one text, by piece."""

    def __init__(self, text: str, tokenizer: TokenCounter):
        self.text, self.tokenizer = text, tokenizer
        self.pieces = tokenizer.split(text)
        self.counts = [0, *accumulate(map(tokenizer.__getitem__, self.pieces))]
        self.ends: list[int] | None = None

    def total(self) -> int:
        return self.counts[-1]

    def _ends(self) -> list[int]:
        if self.ends is None:
            self.ends = list(accumulate(map(len, self.pieces)))
        return self.ends

    def at(self, cut: int) -> int:
        """The count of `text[:cut]`, for any cut."""
        ends = self._ends()
        if cut <= 0 or not ends:
            return 0
        index = bisect_left(ends, cut)
        if index >= len(ends):
            return self.total()
        special = self.tokenizer.special
        # What is cut off may have held apart: a special string from marks before it, and blanks.
        if self.pieces[index] in special and cut < ends[index] and index:
            index -= self.pieces[index - 1] not in special
        while index and self.pieces[index - 1].isspace():
            index -= 1
        start = ends[index] - len(self.pieces[index])
        tail = self.tokenizer.split(self.text[start:cut])
        return self.counts[index] + sum(map(self.tokenizer.__getitem__, tail))

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of whole pieces with at most `budget` tokens."""
        if self.total() <= budget:
            return len(self.text)
        index = bisect_right(self.counts, budget) - 1
        return self._ends()[index - 1] if index > 0 else 0


class TokenCounter(dict):
    """Counts by piece for one byte-level BPE vocabulary; starts anew when it is full.

    A special string in a text is one token.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        ranks, special = read_tokenizer(path)
        self.table = PrefixTable(ranks)
        self.special = frozenset(special)
        either = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
        self.pattern = regex.compile(pattern)
        self.marks = regex.compile(f"({either})") if special else None

    def __missing__(self, piece: str) -> int:
        if piece in self.special:
            return 1
        octets = piece.encode("utf-8")
        table = self.table
        whole = octets in table.ranks and table._check(b"", octets)
        count = 1 if whole else table.counts(octets)[-1]
        if len(octets) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = count
        return count

    def split(self, text: str) -> list[str]:
        """Pieces in order; a special string is a piece of its own."""
        if self.marks is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        pieces = []
        for part in self.marks.split(text):
            pieces += [part] if part in self.special else self.pattern.findall(part)
        return pieces

    def prefixes(self, text: str) -> PrefixCounts:
        return PrefixCounts(text, self)

    def count(self, text: str) -> int:
        return self.prefixes(text).total()


def count_tokens(docs: DataFrame, path: str, pattern: str, budget: int) -> DataFrame:
    """Bytes, tokens, whether they exceed `budget`, and the characters that fit it.

    `fits_chars` is the longest prefix of whole pieces within the budget. Null texts count as
    empty: no bytes, no tokens. Rows are independent, so repeated rows, null ids and an empty
    table need no care.
    """

    def task(batches):
        counter = TokenCounter(path, pattern)
        for batch in batches:
            out = {n: [] for n in ("n_bytes", "n_tokens", "over_limit", "fits_chars")}
            for text in batch["text"]:
                prefixes = counter.prefixes(text)
                total = prefixes.total()
                out["n_bytes"].append(len(text.encode("utf-8")))
                out["n_tokens"].append(total)
                out["over_limit"].append(total > budget)
                out["fits_chars"].append(prefixes.fit(budget))
            yield {"doc_id": batch["doc_id"], **out}

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
    return arrow_rows(documents_of(docs), task, schema)
