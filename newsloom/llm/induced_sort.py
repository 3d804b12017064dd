"""Suffix order and common prefixes by induced sorting, with priority queues that spill to disk.

A suffix is of type S if it is less than the one that follows it, else L. S suffixes after an L
(S*) are sorted first: by the ranks of the pieces between them, doubled where pieces repeat, or
recursively if there are too many for that. A forward pass then induces all L suffixes, a backward
pass all S suffixes: each suffix that a queue gives out puts the suffix before it into the queue,
by first letter and order of arrival. What a queue holds of one letter goes in and out as arrays.

Common prefixes travel along. Two neighbours that begin alike have one letter more in common than
the suffixes that induced them, and those share the least value between them in the pass: within an
array a range minimum, between arrays a running minimum for each letter. Values are measured only
among S* suffixes and where L meets S.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

# Entries of one letter that a queue holds in memory before it writes them to disk.
QUEUE_ITEMS = 200_000
# S* suffixes, as a multiple of a queue's entries, that are ranked by doubling.
RANKED = 4
# An item is a place of a suffix above the letters it shares with the item before it.
SHARED_BITS = 16
SHARED_MASK = (1 << SHARED_BITS) - 1
# More letters than any two suffixes share.
FAR = 1 << 30
# Items of an array that are not worth the fixed cost of array steps.
FEW = 6


class DiskQueue:
    """A priority queue by letter, and by arrival within a letter.

    Induction never adds a letter that has been passed, so each letter is a row of blocks that is
    read once, first to last; full blocks wait in a scratch file.
    """

    def __init__(self, limit: int = QUEUE_ITEMS):
        self.limit = limit
        self.open: dict[int, list[np.ndarray]] = {}
        self.held: dict[int, int] = {}
        self.letters: list[int] = []
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def push(self, letter: int, items: np.ndarray) -> None:
        arrays = self.open.get(letter)
        if arrays is None:
            arrays = self.open[letter] = []
            self.held[letter] = 0
            heapq.heappush(self.letters, letter)
        arrays.append(items)
        self.held[letter] += len(items)
        if self.held[letter] >= self.limit:
            self._spill(letter, arrays)

    def _spill(self, letter: int, arrays: list[np.ndarray]) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(np.concatenate(arrays).tobytes())
        self.blocks.setdefault(letter, []).append((at, self.held[letter]))
        self.held[letter] = 0
        arrays.clear()

    def take(self, letter: int) -> np.ndarray:
        """The next block of a letter; an empty one ends it."""
        waiting = self.blocks.get(letter)
        if waiting:
            at, count = waiting.pop(0)
            self.file.seek(at)
            return np.frombuffer(self.file.read(8 * count), np.int64)
        arrays = self.open[letter]
        if arrays:
            self.open[letter], self.held[letter] = [], 0
            return np.concatenate(arrays)
        del self.open[letter]
        heapq.heappop(self.letters)
        return np.empty(0, np.int64)

    def least(self) -> int:
        """The least letter that has items, -1 if there is none."""
        return self.letters[0] if self.letters else -1


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], ends included, for each pair of ends."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _pass(codes: np.ndarray, wanted: np.ndarray, cap: int, queue: DiskQueue):
    """One pass of induction: a function that takes the suffixes in the order they come out.

    Each with the letters it shares with the one before it; it queues the wanted suffixes before
    them, with what these share with the last one queued of their letter.
    """
    # What the suffixes that came out since the last one queued of a letter share; -1 if none was.
    since = np.full(int(codes.max()) + 1, -1, np.int64)
    narrow = np.min_scalar_type(len(since))  # which NumPy sorts by radix if it can

    def give(places: np.ndarray, common: np.ndarray) -> None:
        if len(places) <= FEW:
            for place, shared in zip(places.tolist(), common.tolist()):
                np.minimum(since, shared, out=since)
                if place and wanted[place - 1]:
                    letter = int(codes[place - 1])
                    carried = min(int(since[letter]) + 1, cap)
                    since[letter] = FAR
                    queue.push(letter, np.array([place - 1 << SHARED_BITS | carried]))
            return
        source = np.flatnonzero(places)
        source = source[wanted[places[source] - 1]]
        if not len(source):
            np.minimum(since, common.min(), out=since)
            return
        before = places[source] - 1
        letters = codes[before]
        order = np.argsort(letters.astype(narrow), kind="stable")
        source, before, letters = source[order], before[order], letters[order]
        first = np.flatnonzero(np.diff(letters, prepend=-1))
        ends = np.append(first[1:], len(letters))
        items = before << SHARED_BITS
        if cap:
            # One letter more than their sources share.
            carried = np.empty(len(source), np.int64)
            later = np.ones(len(source), bool)
            later[first] = False
            later = np.flatnonzero(later)
            carried[later] = _range_least(common, source[later - 1] + 1, source[later])
            carried[first] = np.minimum(since[letters[first]], np.minimum.accumulate(common)[source[first]])
            items |= np.minimum(carried + 1, cap)
            rest = np.append(np.minimum.accumulate(common[::-1])[::-1], FAR)
            np.minimum(since, rest[0], out=since)
            since[letters[first]] = rest[source[ends - 1] + 1]
        for letter, a, b in zip(letters[first].tolist(), first.tolist(), ends.tolist()):
            queue.push(letter, items[a:b])

    return give


def _types(codes: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last letter is the least and stands once."""
    step = np.sign(np.diff(codes))
    # A run of equal letters has the type that its end has.
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.append(step, 1)[at] > 0
    return np.append(rising, True)


class _Text:
    """The letters of a text, from 1 on, and the next few from each place on in one word."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = next(b for b in (8, 16, 32) if int(codes.max()) < (1 << b) - 1)
        self.per = 64 // self.bits
        padded = np.append(codes, np.zeros(self.per, np.int64)).astype(np.uint64)
        self.words = np.zeros(len(codes) + 1, np.uint64)
        for k in range(self.per):
            self.words[:-1] |= padded[k : k + len(codes)] << np.uint64(64 - self.bits * (k + 1))

    def common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Letters that the suffixes at two places have in common, at most `cap`."""
        out = np.full(len(a), cap, np.int64)
        left, done, last = np.arange(len(a)), 0, len(self.codes)
        while len(left) and done < cap:
            x = self.words[np.minimum(a[left] + done, last)] ^ self.words[np.minimum(b[left] + done, last)]
            apart = x != 0
            found = left[apart]
            x, same = x[apart], np.zeros(len(found), np.int64)
            for k in range(1, self.per):
                same += (x >> np.uint64(64 - self.bits * k)) == 0
            out[found] = np.minimum(done + same, cap)
            left, done = left[~apart], done + self.per
        return out

    def names(self, stars: np.ndarray) -> np.ndarray:
        """The rank of the piece from each S* to the next, both included; a piece that goes on is less."""
        ends = np.append(stars[1:], stars[-1])
        size = ends - stars + 1
        words, rank = self.words[stars], np.zeros(len(stars), np.int64)
        short = size < self.per
        # Behind its end a short piece has the greatest letter.
        fill = (np.uint64(1) << (self.bits * (self.per - size[short])).astype(np.uint64)) - np.uint64(1)
        words[short] |= fill
        long = np.flatnonzero(~short)
        if len(long):
            octets = self.codes.astype(">u4").tobytes()
            spans = zip((4 * stars[long]).tolist(), (4 * ends[long] + 4).tolist())
            pieces = [octets[a:b] + b"\xff\xff\xff\xff" for a, b in spans]
            place = {piece: i for i, piece in enumerate(sorted(set(pieces)))}
            rank[long] = [place[piece] for piece in pieces]
        words = np.unique(words, return_inverse=True)[1].reshape(-1)
        return np.unique(words * (len(long) + 1) + rank, return_inverse=True)[1].reshape(-1)


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of `names`, whose last is least and stands once, by rank doubling.

    A rank is the number of lesser suffixes; only what still shares its rank is looked at again.
    """
    order = np.argsort(names, kind="stable")
    ranks, length, n = np.empty(len(names), np.int64), 1, len(names)
    new = np.append(True, np.diff(names[order]) != 0)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        open_ = np.flatnonzero(np.bincount(ranks, minlength=n)[ranks] > 1)
        if not len(open_):
            order = np.empty(n, np.int64)
            order[ranks] = np.arange(n)
            return order
        # The last name stands once, so suffixes of equal rank end behind their first `length` names.
        keys = ranks[open_] * n + ranks[open_ + length]
        by_key = np.argsort(keys, kind="stable")
        keys, at = keys[by_key], np.arange(len(open_))
        group, own = np.append(True, np.diff(keys // n) != 0), np.append(True, np.diff(keys) != 0)
        first, mine = (np.maximum.accumulate(np.where(cut, at, 0)) for cut in (group, own))
        ranks[open_[by_key]] = keys // n + mine - first
        length *= 2


def _sorted_stars(text: _Text, stars: np.ndarray, limit: int) -> np.ndarray:
    """S* suffixes in order, by the names of the pieces between them."""
    names = text.names(stars)
    if len(stars) <= RANKED * limit:
        return stars[_doubled(names)]
    if int(names.max()) + 1 == len(stars):
        return stars[np.argsort(names)]
    return stars[sorted_suffixes(names, 0, limit)[0]]


def suffixes(text: str, cap: int, limit: int = QUEUE_ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a text in order, and what each shares with the one before it, up to `cap`.

    The text ends with its least letter, which occurs nowhere else. A cap of 0 leaves the second
    array zero.
    """
    return sorted_suffixes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), cap, limit)


def sorted_suffixes(letters: np.ndarray, cap: int, limit: int = QUEUE_ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """`suffixes` of a text given as the numbers of its letters."""
    n = len(letters)
    present = np.bincount(letters) > 0
    codes = np.cumsum(present)[letters].astype(np.int64)
    rising = _types(codes)
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if not len(stars):
        return np.arange(n - 1, -1, -1), np.zeros(n, np.int64)
    text = _Text(codes)
    order = _sorted_stars(text, stars, limit)
    shared = np.zeros(len(order), np.int64)
    if cap:
        shared[1:] = text.common(order[:-1], order[1:], cap)
    lows, low_shared = _forward(text, ~rising, order, shared, cap, limit)
    return _backward(text, rising, lows, low_shared, cap, limit)


def _induced(text: _Text, codes, wanted, order, shared, cap, limit):
    """(from the queue, places, shared) of all suffixes, as arrays in the order in which they come out.

    `order` holds the suffixes that are known, by letter; those of one letter follow the induced ones.
    """
    queue = DiskQueue(limit)
    give = _pass(codes, wanted, cap, queue)
    known = codes[order]
    at = 0
    while True:
        code = queue.least()
        if at < len(order) and (code < 0 or known[at] < code):
            code = int(known[at])
        if code < 0:
            return
        last = None
        while queue.least() == code:
            items = queue.take(code)
            if len(items):
                places, common = items >> SHARED_BITS, items & SHARED_MASK
                yield True, places, common
                give(places, common)
                last = places[-1:]
        end = int(np.searchsorted(known, code, "right"))
        if end > at:
            here, common = order[at:end], shared[at:end].copy()
            common[0] = text.common(last, here[:1], cap)[0] if cap and last is not None else 0
            yield False, here, common
            give(here, common)
            at = end


def _forward(text, falling, order, shared, cap, limit):
    """All L suffixes in order, from the S* suffixes; each with what it shares with the last L."""
    found = [(p, c) for queued, p, c in _induced(text, text.codes, falling, order, shared, cap, limit) if queued]
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _backward(text, rising, lows, low_shared, cap, limit):
    """All suffixes in order, S suffixes induced from the last to the first."""
    flipped = int(text.codes.max()) - text.codes  # the greatest letter comes first
    back = np.append(0, low_shared[:0:-1])
    found = [(p, c) for _, p, c in _induced(text, flipped, rising, lows[::-1], back, cap, limit)]
    order, common_next = (np.concatenate(parts) for parts in zip(*found))
    # The least suffix, the last letter alone, comes first and shares nothing.
    order = np.append(len(text.codes) - 1, order[::-1])
    return order, np.concatenate([[0, 0], common_next[:0:-1]])
