"""Each operator against a plain version, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import (
    brown_lm, byte_bpe, chat, decontaminate, induced_sort, pii, simhash, suffix_dedup,
    token_counts, toxicity, winnowing,
)
from newsloom.llm.common import prepare
from newsloom.llm.queries import BPE_RANKS, COUNTED_VOCABULARY

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, key string, n string"
PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path(BPE_RANKS)
VOCABULARY = public_tokenizers.path(COUNTED_VOCABULARY)


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def frame(session, texts):
    """Documents with these texts, and columns whose names the operators use inside."""
    rows = [(i, t, None, "s", 1, "x", "y", "z", "w") for i, t in texts]
    return session.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(session):
    return session.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(session):
    long_text = "word " * 5_000 + "x" * 20_000
    return frame(session, [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "tie tie tie"), (5, "tie tie tie"),
        (None, "no id here at all"), (7, long_text), (8, long_text), (9, "漢字かな" * 50),
    ])


@pytest.fixture(scope="module")
def nothing(session):
    return frame(session, [])


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_one": lambda d: simhash.keep_one(d, 5, 3),
    "encode": lambda d: byte_bpe.encode_documents(d, RANKS, PATTERN),
    "round_trip": lambda d: byte_bpe.round_trip(d, RANKS, PATTERN, "lang"),
    "token_counts": lambda d: token_counts.count_tokens(d, VOCABULARY, PATTERN, 10),
    "brown_lm": lambda d: brown_lm.score_held_out(d),
    "pii": lambda d: pii.find_personal_data(d),
    "sanitise": lambda d: pii.sanitise(d),
    "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d),
    "winnowing": lambda d: winnowing.edited_fingerprints(d),
    "fingerprints": lambda d: winnowing.fingerprint_documents(d),
    "toxicity": lambda d: toxicity.classify(d, labels_of(d)),
    "decontaminate": lambda d: decontaminate.find_contaminated(d, items_of(d)),
    "clean": lambda d: decontaminate.clean_documents(d, items_of(d)),
}
ONE_EACH = {
    "simhash", "encode", "round_trip", "token_counts", "brown_lm", "pii", "sanitise",
    "suffix_dedup", "winnowing", "fingerprints", "toxicity",
}


def labels_of(docs):
    return docs.sparkSession.createDataFrame([(1, 1, None), (2, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


def items_of(docs):
    return docs.sparkSession.createDataFrame(
        [(1, None), (2, ""), (3, "no id here at all"), (None, "a b c")], "item_id long, text string"
    )


@pytest.fixture(scope="module")
def on_files(session, awkward, nothing, tmp_path_factory):
    root = tmp_path_factory.mktemp("awkward")
    awkward.write.parquet(f"{root}/some")
    nothing.write.parquet(f"{root}/none")
    return session.read.parquet(f"{root}/some"), session.read.parquet(f"{root}/none")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(name, on_files):
    some, none = on_files
    result = OPERATORS[name](some).collect()
    if name in ONE_EACH:
        assert len(result) == 10
    assert OPERATORS[name](none).count() == 0


def test_simhash_components(docs, session):
    rows = docs.collect()

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {r.doc_id: fingerprint(r.text) for r in rows}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("radius", [2, 4])
def test_leaf_links_span_all_near_pairs(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (6, 200, 3)).astype(np.uint64)
    values = np.unique(np.concatenate([base[i] ^ np.bitwise_xor.reduce(flips[i], axis=1) for i in range(6)]))
    a, b = simhash.leaf_links(values, None, radius)
    root = simhash._roots(len(values), a, b)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    i, j = np.nonzero(near)
    assert (root == simhash._roots(len(values), i, j)).all()
    half = len(values) // 2
    c, d = simhash.leaf_links(values[:half], values[half:], radius)
    across = near.copy()
    across[:half, :half] = across[half:, half:] = False
    i, j = np.nonzero(across)
    assert (simhash._roots(len(values), c, d) == simhash._roots(len(values), i, j)).all()


def random_texts(count, seed):
    rnd = random.Random(seed)
    bits = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", "é", "!", "<|endoftext|>", "漢", " on", "the"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(count)]


def test_bpe_as_the_library(docs):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.ByteBpe(ranks, PATTERN)
    texts = [r.text or "" for r in docs.collect()] + random_texts(500, 1) + ["ab" * 5_000]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_min_tree_is_leftmost_minimum():
    rnd = random.Random(3)
    values = [rnd.randint(0, 9) for _ in range(700)]
    tree = byte_bpe.MinTree(list(values))
    for _ in range(600):
        assert tree.leftmost() == values.index(min(values))
        at = rnd.randrange(700)
        values[at] = rnd.randint(0, 9)
        tree.set(at, values[at])


def test_counts_at_every_prefix():
    library = Tokenizer.from_file(VOCABULARY)
    own = token_counts.TokenCounter(VOCABULARY, PATTERN)
    for text in random_texts(150, 2):
        prefixes = own.prefixes(text)
        for cut in range(len(text) + 1):
            assert prefixes.at(cut) == len(library.encode(text[:cut], add_special_tokens=False).ids)


def test_token_counts_as_the_library(docs):
    library = Tokenizer.from_file(VOCABULARY)
    counted = {r.doc_id: r for r in token_counts.count_tokens(docs, VOCABULARY, PATTERN, 100).collect()}
    for row in docs.collect():
        got = counted[row.doc_id]
        assert got.n_tokens == len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert got.over_limit == (got.n_tokens > 100)
        assert len(library.encode((row.text or "")[: got.fits_chars], add_special_tokens=False).ids) <= 100


def test_chat_costs_and_pieces(session, monkeypatch):
    rnd = random.Random(4)
    names = ["user", "assistant", "system", "human", None, "x"]
    talks = {c: [rnd.choice(names) for _ in range(rnd.randint(1, 9))] for c in range(60)}
    rows = [(c, i, r, f"t{i}", "extra") for c, roles in talks.items() for i, r in enumerate(roles)]
    frame = session.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")

    def least(roles):
        best = {chat.START: 0}
        for role in map(chat.role_of, roles):
            after = {}
            for state, cost in best.items():
                for more, to, _, _ in chat.choices(state, role):
                    after[to] = min(after.get(to, 1 << 50), cost + more)
            best = after
        return min(cost + chat.closing(state) for state, cost in best.items())

    for size in (2_048, 2):
        monkeypatch.setattr(chat, "PIECE_TURNS", size)
        done = {}
        for r in sorted(chat.repair(frame).collect(), key=lambda r: (r.conv_id, r.piece, r.position)):
            done.setdefault(r.conv_id, []).append(r)
        for c, roles in talks.items():
            assert done[c][0].cost == least(roles)
            assert sum(r.turn is not None for r in done[c]) == len(roles)
            spoken = [r.role for r in done[c] if r.action != "merge"]
            if spoken[0] == "system":
                spoken = spoken[1:]
            assert spoken == ["user", "assistant"] * (len(spoken) // 2)
            whole = "".join(r.rendered for r in done[c])
            assert whole.count("<|end|>") == sum(r.action != "merge" for r in done[c])
    assert chat.repair(frame.filter("false")).count() == 0


def test_language_model(docs):
    rows = docs.collect()
    scored = {r.doc_id: r for r in brown_lm.score_held_out(docs).collect()}
    counts = Counter()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in rows}
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words)
    total, kinds = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        assert scored[i].base_score == pytest.approx(base, rel=1e-9)
        assert scored[i].n_known == sum(counts[w] > 0 for w in words)
        assert (scored[i].n_tokens, scored[i].train_tokens) == (len(words), total)
    held_out = [r for r in scored.values() if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_language_model_joins_rare_words_only(docs, session, monkeypatch):
    """Counts of the next words come from a table in the task; which words it holds changes no score."""
    train = F.col("doc_id") % 3 != 0
    by_join = []
    for counted in (0, 300, 1_000_000):
        monkeypatch.setattr(brown_lm, "COUNTED", counted)
        found = brown_lm.score_documents(docs, train, 200, 8, 1)
        by_join.append(sorted(tuple(round(v, 6) for v in r) for r in found.collect()))
    assert by_join[0] == by_join[1] == by_join[2]
    assert "ShuffledHashJoin" in found._jdf.queryExecution().toString()


def test_neighbours_hold_all_bigrams(session, monkeypatch):
    rng = np.random.default_rng(4)
    table = rng.integers(0, 3, (40, 40))
    a, b = np.nonzero(table)
    rows = [(int(i), int(j), int(table[i, j])) for i, j in zip(a, b)]
    monkeypatch.setattr(brown_lm, "HELD_COUNTS", 50)
    bigrams = session.createDataFrame(rows, "a int, b int, n long").repartition(3)
    found = brown_lm.neighbours(bigrams).collect()
    after = {
        (r.w, int(o), int(n))
        for r in found for o, n in zip(np.frombuffer(r.after, np.int32), np.frombuffer(r.after_n, np.int64))
    }
    before = {(int(o), r.w) for r in found for o in np.frombuffer(r.before, np.int32)}
    assert len(found) == len({r.w for r in found}) and after == set(rows)
    assert before == {(i, j) for i, j, _ in rows if i != j}
    classes = np.arange(40) % 7
    expected = np.zeros((7, 7))
    np.add.at(expected, (classes[:, None], classes[None, :]), table)
    assert (brown_lm._class_table(brown_lm.neighbours(bigrams), classes) == expected).all()


def test_frequent_words_are_bounded(session):
    counts = session.createDataFrame([(bytes([i]), n) for i, n in enumerate([9, 7, 7, 5, 5, 5])], "word binary, n long")
    assert [brown_lm.frequent(counts, k).count() for k in (0, 1, 2, 3, 5, 6)] == [0, 1, 1, 3, 3, 6]


def test_exchange_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(2)
    words, k = 12, 4
    bigrams = rng.integers(0, 6, (words, words)).astype(float)
    classes = rng.integers(0, k, words)

    def likelihood(of):
        table = np.zeros((k, k))
        np.add.at(table, (of[:, None], of[None, :]), bigrams)
        log = brown_lm._log
        return log(table).sum() - log(table.sum(axis=0)).sum() - log(table.sum(axis=1)).sum()

    w = 5
    others = np.arange(words) != w
    out = np.bincount(classes[others], bigrams[w, others], k)
    into = np.bincount(classes[others], bigrams[others, w], k)
    rest = np.zeros((k, k))
    kept = np.ix_(others, others)
    np.add.at(rest, (classes[others][:, None], classes[others][None, :]), bigrams[kept])
    gain = brown_lm._gains(rest, out, into, bigrams[w, w], k)
    moved = []
    for c in range(k):
        trial = classes.copy()
        trial[w] = c
        moved.append(likelihood(trial))
    assert gain - gain[0] == pytest.approx(np.array(moved) - moved[0])


def test_block_max_search_finds_all_above_threshold(monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(4, 20)))) for i in range(150)]
    df = Counter(t for _, text in items for t in set(text.split()))
    mean = sum(len(t.split()) for _, t in items) / len(items)
    for block in (1, 4, 16):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        index = decontaminate.Index.build(items, df, len(items), mean)
        for _ in range(40):
            terms = sorted({index.terms[w] for w in rnd.choices(vocabulary, k=25) if w in index.terms})
            scores = Counter()
            for t in terms:
                for at, weight in zip(*index.postings[t]):
                    scores[at] += weight
            for threshold in (0.3, 0.5, 0.8):
                found = dict(decontaminate.search(index, terms, threshold))
                assert set(found) == {a for a, s in scores.items() if s >= threshold - 1e-9}


def test_contaminated_documents(session):
    item = "What is the capital of the old northern kingdom? It is the harbour town of Vell."
    near = item.replace("northern", "southern")
    docs = frame(session, [
        (1, "lead words here. " + item + " more words follow"), (2, "What is the capital of the old town?"),
        (3, "filler " * 300 + near), (4, "It is the harbour town of Vell."),
    ])
    items = session.createDataFrame([(10, item), (11, "entirely different words. nothing alike here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, items).collect()}
    assert found == {(1, 10), (3, 10)}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, items).collect()} == {2, 4}


def test_personal_data_patterns():
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    address = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")

    def plain(text):
        found = [(0, *m.span()) for m in email.finditer(text)]
        found += [(1, *m.span()) for m in address.finditer(text) if all(int(p) < 256 for p in m.group().split("."))]
        for m in card.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            odd, even = digits[-1::-2], digits[-2::-2]
            total = sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)
            if 16 <= len(digits) <= 19 and total % 10 == 0:
                found.append((2, *m.span()))
        return found + [
            (3, *m.span()) for m in phone.finditer(text) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15
        ]

    rnd = random.Random(7)
    bits = ["a", "B", "@", ".", "-", "1", "12", "256", "001", " ", "+", "(", "é", "4111 1111 1111 1111", "x.y", "+1 "]
    for _ in range(4_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20)))
        assert pii.pattern_spans(text) == plain(text), text


def test_terms_that_reveal_an_entity(session):
    texts = [(i, f"write to Quillon at quill.on@mail.example.com about plan{i} word") for i in range(8)]
    texts += [(100 + i, f"other plain word text number {i}") for i in range(80)]
    found = pii.find_personal_data(frame(session, texts)).collect()
    for row in found:
        terms = [s for s in row.found if s["kind"] == 4]
        words = {dict(texts)[row.doc_id][s["start"] : s["stop"]].lower() for s in terms}
        assert ("quillon" in words) == (row.doc_id < 8) and "word" not in words
    assert pii.mask("a b@c.d e", [(0, 2, 7)]) == "a <EMAIL> e"


def test_terms_of_entities_in_few_documents(session):
    filler = " ".join("plain common words of every text".split() * 3)
    texts = []
    for n, copies in enumerate((1, 2, 3, 4)):
        name = "Zeb" + "abcd"[n] * 3
        texts += [
            (10 * n + i, f"{name} lives here {filler} mail p{n}@mail.example.com {filler} own{'xyzw'[i]}{'abcd'[n]}")
            for i in range(copies)
        ]
    # Copies count once as evidence, so each of these texts differs.
    texts += [(100 + i, f"{filler} lives here mail {chr(97 + i % 20) * (2 + i // 20)}") for i in range(400)]
    for row in pii.find_personal_data(frame(session, texts)).collect():
        text = dict(texts)[row.doc_id]
        words = {text[s["start"] : s["stop"]] for s in row.found if s["kind"] == 4}
        # An entity of one document leaves its words undecided.
        assert words == ({text.split()[0]} if 10 <= row.doc_id < 100 else set())


def test_copies_of_a_text_reveal_nothing(session):
    """A rare word that only copies of one text hold is no evidence, however many they are."""
    texts = [(i, "Zebulon wrote it from p@mail.example.com to all") for i in range(30)]
    texts += [(100 + i, f"all of it was plain {chr(97 + i % 20) * (2 + i // 20)}") for i in range(200)]
    found = pii.find_personal_data(frame(session, texts)).collect()
    assert len(found) == 230 and sum(r.n_email for r in found) == 30
    assert not any(s["kind"] == 4 for r in found for s in r.found)


def test_induced_sort():
    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 40))) + chr(0)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = [0]
        for a, b in zip(order, order[1:]):
            same = 0
            while same < 7 and text[a + same : a + same + 1] == text[b + same : b + same + 1] != "":
                same += 1
            shared.append(same)
        got = induced_sort.suffixes(text, 7, rnd.choice([2, 1000]))
        assert [list(x) for x in got] == [order, shared]


def test_induced_sort_takes_few_steps(monkeypatch):
    """What a queue holds of a letter is induced at once; long runs, long pieces and spilled blocks stay right."""
    rnd, calls = random.Random(6), []
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    text = " ".join(rnd.choice(words) for _ in range(900)) + "a" * 60 + "".join(map(chr, range(97, 160))) * 2 + chr(0)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        same = next(k for k in range(len(text)) if k == 30 or text[a + k] != text[b + k])
        shared.append(same)
    take = induced_sort.DiskQueue.take
    monkeypatch.setattr(induced_sort.DiskQueue, "take", lambda self, letter: calls.append(letter) or take(self, letter))
    got = induced_sort.suffixes(text, 30)
    assert [list(x) for x in got] == [order, shared] and len(calls) < len(text) / 5
    assert [list(x) for x in induced_sort.suffixes(text, 30, 50)] == [order, shared]


@pytest.mark.parametrize("group_rows", [1_024, 2])
def test_repeated_bytes(docs, monkeypatch, group_rows):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    length = suffix_dedup.LENGTH
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    for row in suffix_dedup.remove_repeats(docs).collect():
        text = texts[row.doc_id]
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        assert (row.n_bytes, row.n_removed, bytes(row.kept)) == (len(text), int(gone.sum()), kept)
        assert row.n_spans == len(suffix_dedup._runs(gone))


def test_toxicity_on_held_out_rows(session):
    docs = session.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = session.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in scored)
    # The table has few toxic rows to learn from: order is tested, not the threshold's yield.
    toxic, plain = [r.score for r in scored if r.toxic], [r.score for r in scored if not r.toxic]
    wins = sum((t > p) + 0.5 * (t == p) for t in toxic for p in plain)
    assert wins / (len(toxic) * len(plain)) > 0.75


def test_winnowing(docs, session):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    by_text = {}
    for row in winnowing.edited_fingerprints(docs).collect():
        text, following = texts[row.doc_id], texts[ids[(ids.index(row.doc_id) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1


def test_winnowing_keeps_rightmost_minima(session):
    rnd = random.Random(8)
    texts = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 25)))) for i in range(60)]
    frame_ = frame(session, texts).withColumn("kept", winnowing.winnow(F.col("text")))
    rows = frame_.select("text", winnowing.hashes(F.col("kept")).alias("h"), winnowing.positions(F.col("kept")).alias("p"))
    grams = frame(session, texts).select("text", F.col("text").alias("t"))
    known = {}
    for row in grams.select("text", winnowing._packed(F.split("t", " "), winnowing.K).alias("g")).collect():
        known[row.text] = [(g >> winnowing.POSITION_BITS) for g in row.g]
    for row in rows.collect():
        if not row.text:
            assert row.h == []
            continue
        h = known[row.text]
        spans = [h[i : i + winnowing.WINDOW] for i in range(max(1, len(h) - winnowing.WINDOW + 1))]
        places = {i + max(j for j, x in enumerate(s) if x == min(s)) for i, s in enumerate(spans)}
        assert row.p == sorted(places) and row.h == [h[p] for p in row.p]


def test_token_counts_share_prefixes(monkeypatch):
    """Last tokens of prefixes are found once for all pieces, within bounds that change no count."""
    ranks, _ = token_counts.read_tokenizer(VOCABULARY)
    table = token_counts.PrefixTable(ranks)
    plain = table.counts(b"unbelievable")
    known = dict(table.lasts)
    assert len(known) == len(b"unbelievable") and table.counts(b"unbelievably")[:11] == plain[:11]
    assert len(table.lasts) == len(known) + 1
    rng = random.Random(11)
    pieces = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    monkeypatch.setattr(token_counts, "REMEMBERED_PREFIXES", 100)
    for piece in pieces:
        assert table.counts(piece) == token_counts.PrefixTable(ranks).counts(piece)
    assert len(table.lasts) <= 190


def test_common_words_are_not_counted_in_all_texts(session, monkeypatch):
    """A word that many texts with shared entities hold reveals none; its frequency is not asked for."""
    texts = [(i, f"w{'abcdefghij'[i // 3]}x common words here mail p{i // 3}@ex.org") for i in range(30)]
    texts = [(i, t + " " + "qrstuvwxyz"[i % 10] * 3) for i, t in texts] + [(100 + i, "zz other " + "abcdefghij"[i % 10] * (2 + i)) for i in range(40)]
    asked = []
    counted = pii.term_frequencies

    def spy(docs, found, wanted):
        asked.extend(w for w in ("common", "words", "here", "mail", "wax") if pii.in_bitmap(wanted, w))
        return counted(docs, found, wanted)

    monkeypatch.setattr(pii, "term_frequencies", spy)
    found = {r.doc_id: r for r in pii.find_personal_data(frame(session, texts)).collect()}
    assert asked == ["wax"] and len(found) == 70
