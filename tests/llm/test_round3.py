"""Page text, whitening and importance resampling against plain versions, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import importance, page_text, whitening
from newsloom.llm.common import prepare
from newsloom.llm.queries import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


# Page text

PAGE = "page_id long, url string, html string, host string, digest string, outside string, spans string"


def pages(session, rows):
    return session.createDataFrame([(i, u, h, "a", "b", "c", "d") for i, u, h in rows], PAGE)


def article_text(page: str) -> str:
    return "\n".join(text for zone, text in page_text.page_blocks(page) if zone == page_text.ARTICLE)


@pytest.mark.parametrize("page, text", [
    ("<article><h1>T</h1><p>a\n b&nbsp;<b>c</b></p><p>d</article>", "T\na b c\nd"),
    ("<nav><ul><li>Home<article><p>lost end tag</p></article>", "lost end tag"),
    ("<form><div><article>in a form</article></div></form>", "in a form"),
    ("<article>one</article><p>x</p><article>two</article>", "one\ntwo"),
    ("<aside><article>teaser</article></aside><article>main</article>", "main"),
    ("<article><p>text</p><div class='comments'><p>first!</p></div></article>", "text"),
    ("<article><header><h1>Head</h1><p>by me</p></header><p>text</p></article>", "Head\ntext"),
    ("<article>before <span class=ad>buy</span>after<!-- </article> --></article>", "before after"),
    ("<article><p class='cookieNotice'>ok?<p>text</article>", "text"),
    ("<article><script>var t='</article>'; if (a < b) x()</script>1 < 2 &lt; &#51; &amp;lt;</article>", "1 < 2 < 3 &lt;"),
    ("<article><a title='a > b'>link</a> <a title=it's>s</a></article>", "link s"),
    ("<article><table><tr><td>x<td>y</table><p>p<ul><li class=ad>n<li>y2</ul></article>", "x\ny\np\ny2"),
    ("<ARTICLE CLASS=\"post has-sidebar\">up <BR> down</ARTICLE>", "up down"),
])
def test_article_markup(page, text):
    assert article_text(page) == text


@pytest.mark.parametrize("unit", [
    "<", "<p", "<b>", "<p><b>", "<div>", "</p>", "<!--", "<a title='", "&amp", "<p><div><b><hr>", "<a b", "<script>", "<li>", "=\""
])
def test_broken_pages_take_linear_time(unit):
    import time

    began = time.time()
    page_text.page_blocks("<article>" + unit * 60_000)
    assert time.time() - began < 5


def covered_plainly(pages_of_host: list[list[str]], run: int) -> list[list[bool]]:
    """Tokens in a run that another, different page of the host has too, by comparing all windows."""
    seen: dict[tuple, set] = {}
    for words in pages_of_host:
        for i in range(len(words) - run + 1):
            seen.setdefault(tuple(words[i : i + run]), set()).add(tuple(words))
    out = []
    for words in pages_of_host:
        flags = [False] * len(words)
        for i in range(len(words) - run + 1):
            if len(seen[tuple(words[i : i + run])]) > 1:
                flags[i : i + run] = [True] * run
        out.append(flags)
    return out


@pytest.mark.parametrize("segment", [page_text.SEGMENT, 40])
def test_host_runs_equal_plain_windows(session, segment):
    rng = random.Random(7)
    rows, expected = [], []
    for host in ("one.example", "two.example"):
        shared = [[rng.choice("abc") for _ in range(rng.randint(3, 9))] for _ in range(6)]
        words = []
        for _ in range(25):
            page = []
            for _ in range(rng.randint(0, 4)):
                page += rng.choice(shared) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
            words.append(page)
        words[3] = words[4]
        for page, flags in zip(words, covered_plainly(words, 5)):
            text = " ".join(w for w, hit in zip(page, flags) if not hit) or " ".join(page)
            rows.append((len(rows), f"http://{host}/{len(rows)}", f"<body><div>{' '.join(page)}</div>"))
            expected.append(text)
    found = page_text.main_text(pages(session, rows), segment=segment).collect()
    assert {r["page_id"]: r["text"] for r in found} == dict(enumerate(expected))


def test_site_words_go_and_articles_stay(session):
    site = "<div>Welcome to the daily paper of record</div>"
    copy = "<article>the same long story on two pages</article>"
    found = page_text.main_text(pages(session, [
        (1, "http://a.example/1", f"<body>{site}<p>First page here</p>"),
        (2, "http://a.example/2", f"<body>{site}<p>Second page here</p>"),
        (3, "http://b.example/1", f"<body>{site}<p>Only page of another host</p>"),
        (4, "http://c.example/1", copy), (5, "http://c.example/2", copy + "<p>x</p>"),
        (6, "http://d.example/1", f"<form>{site}<p>x</p></form>"), (7, "u", "<main>m</main><p>n</p>"),
    ])).collect()
    assert {r["page_id"]: r["text"] for r in found} == {
        1: "First page here", 2: "Second page here",
        3: "Welcome to the daily paper of record\nOnly page of another host",
        4: "the same long story on two pages", 5: "the same long story on two pages",
        6: "Welcome to the daily paper of record\nx", 7: "m",
    }


def test_awkward_pages(session):
    rows = [(1, None, None), (2, "", ""), (None, "x", "plain"), (None, "x", "plain"), (3, "http://h", "<p>" + "w " * 50_000), (4, "http://h", "\0<>&#0;")]
    found = page_text.main_text(pages(session, rows)).collect()
    texts = Counter((r["page_id"], r["url"], r["text"][:5], r["n_chars"]) for r in found)
    assert texts == Counter([
        (1, None, "", 0), (2, "", "", 0), (None, "x", "plain", 5), (None, "x", "plain", 5),
        (3, "http://h", "w w w", 99_999), (4, "http://h", "\0<>�", 4),
    ])
    assert page_text.main_text(pages(session, [])).count() == 0


def test_op11_gives_the_articles(session):
    """The test pages hold one article each, of headings and paragraphs."""
    import html

    def plain(page):
        inside = re.search(r"(?s)<article>(.*)</article>", page).group(1)
        blocks = (re.sub("<[^>]+>", " ", b) for b in re.split(r"</?(?:p|h1)>", inside))
        return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)

    found = {r["page_id"]: r["text"] for r in registered()["op11_page_text"](session, SF).collect()}
    rows = session.read.parquet(f"{SF}/pages.parquet").collect()
    assert found == {r["page_id"]: plain(r["html"]) for r in rows}


# Whitening

VECTOR = "vec_id long, embedding array<float>, x string, n string, component string, i string, row string"


def vectors(session, rows):
    return session.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], VECTOR)


def check_whitened(found, rows, tolerance=1e-9):
    """Against numpy's eigendecomposition of the covariance of the distinct vectors."""
    x = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for k, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, right = np.linalg.eigh(centred.T @ centred / n)
    values, right = values[::-1], right[:, ::-1]
    by_row = {}
    for r in found:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    kept = len(next(iter(by_row.values())))
    signs = {}
    for k, v in x.items():
        for c in range(kept):
            r = by_row[k][c + 1]
            assert (r["n"], r["deviation"]) == (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)))
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            expected = (v - sums / n) @ right[:, c] / math.sqrt(values[c])
            if abs(expected) > 1e-6:
                signs.setdefault(c, np.sign(expected * r["whitened"]))
            assert r["whitened"] == pytest.approx(signs.get(c, 1) * expected, abs=tolerance)
    return kept


def test_whitening_equals_eigenvectors(session):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[0].tolist()) for i in range(40)]
    found = whitening.whiten(vectors(session, rows)).collect()
    assert len(found) == 340 * 4 and check_whitened(found, rows) == 4


def test_whitening_of_ill_conditioned_and_flat_rows(session):
    rng = np.random.default_rng(5)
    narrow = rng.normal(size=(200, 6)) * [4000, 3, 1, 0.5, 0, 0]
    rows = [(i, (v + [0, 0, 0, 0, 7, -3]).tolist()) for i, v in enumerate(narrow)]
    found = whitening.whiten(vectors(session, rows)).collect()
    assert check_whitened(found, rows, 1e-7) == 4
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    found = whitening.whiten(vectors(session, line)).collect()
    assert check_whitened(found, line) == 1


def test_awkward_vectors(session):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 1.0]), (5, [-inf, 1.0])]
    good = [(None, [0.5, -0.25]), (6, [0.5, -0.25]), (6, [-1.0, 0.0]), (7, [2.0, 2.0]), (8, [1.0]), (9, [])]
    found = whitening.whiten(vectors(session, bad + good)).collect()
    assert Counter(r["vec_id"] for r in found) == {None: 2, 6: 4, 7: 2, 8: 2, 9: 2}
    assert {r["n"] for r in found} == {5} and all(r["identity_error"] < 1e-9 for r in found)
    same = {(r["component"], r["whitened"]) for r in found if r["vec_id"] in (None, 6)}
    assert len(same) == 4
    for rows in ([], bad, [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(vectors(session, rows)).collect() == []


def test_triangular_solve():
    rng = np.random.default_rng(1)
    upper = np.triu(rng.normal(size=(7, 7))) + 5 * np.eye(7)
    rows = rng.normal(size=(20, 7))
    assert np.allclose(whitening.triangular_solve(rows, upper) @ upper, rows)


def test_deviation_beyond_a_long():
    far = np.array([[2**40], [0]])
    assert whitening._deviations(far, 2, np.array([2**40])) == [None, None]
    assert whitening._deviations(np.array([[2**31], [0]]), 1, np.array([0])) == [2**62, 0]


# Importance resampling

DOC = "doc_id long, text string, place string, score string, bucket string, _at string, n string"


def documents(session, rows):
    return session.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOC)


def runs_plainly(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled_plainly(docs, target):
    bucket = lambda run: zlib.crc32(run.encode()) % 10_000
    source = Counter(bucket(r) for _, t in docs for r in runs_plainly(t)[1])
    wanted = Counter(bucket(r) for t in target for r in runs_plainly(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    rows, long_enough = [], []
    for i, text in docs:
        words, runs = runs_plainly(text)
        weight = sum(
            math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))
            for b in map(bucket, runs)
        )
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(runs), weight, score, None])
        if len(words) >= 20:
            long_enough.append(rows[-1])
    long_enough.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, row in enumerate(long_enough[: 5 * len(long_enough) // 100]):
        row[4] = k + 1
    return Counter(map(tuple, rows))


def test_op13_equals_plain_counts(session):
    docs = [(r["doc_id"], r["text"]) for r in session.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in session.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = registered()["op13_importance_resampling"](session, SF)
    assert Counter(map(tuple, found.collect())) == resampled_plainly(docs, target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("chunk, dense", [(1 << 20, importance.DENSE), (7, 40)])
def test_awkward_documents(session, monkeypatch, chunk, dense):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    monkeypatch.setattr(importance, "DENSE", dense)
    rng = random.Random(2)
    words = ["a", "B7", "é", "Éa", "ü-b", "K", "漢字", "x_y", "1", "\xa0z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, " \n.!"), (None, "no id " * 12), (5, docs[5][1]), (6, "tie " * 30), (7, "tie " * 30), (8, "w" * 30_000)]
    target = ["a b7 a", None, "", "漢字 é tie tie"]
    found = importance.resample(documents(session, docs), documents(session, list(enumerate(target))))
    assert Counter(map(tuple, found.collect())) == resampled_plainly(docs, target)


def test_importance_of_nothing(session):
    nothing = documents(session, [])
    assert importance.resample(nothing, nothing).collect() == []
    one = importance.resample(documents(session, [(1, "word " * 25)]), nothing, percent=100).collect()
    assert [r["rank"] for r in one] == [1]
