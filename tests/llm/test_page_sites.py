"""What most articles of a host share is the site's; copies, quotations and versions stay."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from newsloom.llm import page_text
from newsloom.llm.common import prepare

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def texts_of(session, rows, **sizes):
    found = page_text.main_text(session.createDataFrame(rows, PAGE), **sizes).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    return {r["page_id"]: r["text"] for r in found}


def article(*blocks: str) -> str:
    return "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"


NOTICE = "Write to our editors about this story"
LICENCE = "Free to share under the same terms"
QUOTE = "We shall see what the winter brings"


def own(k: int) -> str:
    return " ".join(f"w{k}x{i}" for i in range(12))


def test_a_notice_in_every_article_goes(session):
    rows = [(k, f"http://a.example/{k}", article(own(k), NOTICE, own(k + 50))) for k in range(8)]
    assert texts_of(session, rows) == {k: f"{own(k)}\n{own(k + 50)}" for k in range(8)}


def test_what_fewer_articles_share_stays(session):
    rows = []
    for k in range(8):
        extra = [LICENCE] * (k < 4) + [QUOTE] * (k in (5, 6))
        rows.append((k, f"http://a.example/{k}", article(own(k), *extra, own(k + 50))))
    # A copy, four times more: one article of the host.
    rows += [(k, f"http://a.example/{k}", rows[0][2]) for k in range(8, 12)]
    # Too few articles to tell.
    rows += [(k, f"http://b.example/{k}", article(own(k), NOTICE, own(k + 50))) for k in range(20, 24)]
    # Words of a menu elsewhere on the host, and a sentence that holds the notice's words among others.
    rows.append((30, "http://a.example/30", f"<nav>{QUOTE}</nav><div class=ad>{own(0)}</div>"))
    plain = {k: page.replace("<article><p>", "").replace("</p></article>", "").replace("</p><p>", "\n") for k, _, page in rows}
    assert texts_of(session, rows) == plain | {30: ""}


def test_versions_of_one_text_stay_whole(session):
    rows = [(k, f"http://a.example/{k}", article(own(0), own(1), own(2), f"changed on day {k} by us", NOTICE)) for k in range(9)]
    rows += [(k, None, article(f"{NOTICE} said the mayor {own(k)}", own(k + 50))) for k in range(20, 29)]
    found = texts_of(session, rows)
    assert found[3] == f"{own(0)}\n{own(1)}\n{own(2)}\nchanged on day 3 by us\n{NOTICE}"
    assert found[20] == f"{NOTICE} said the mayor {own(20)}\n{own(70)}"


def plainly(rows: list[tuple[str, list[str]]], run: int, least: int) -> list[list[str]]:
    """The blocks kept of each (host, blocks), by counting all windows of all articles."""
    held, articles = {}, Counter(host for host, _ in {(h, tuple(b)) for h, b in rows})
    for host, blocks in {(h, tuple(b)) for h, b in rows}:
        words = " ".join(blocks).split(" ")
        for window in {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}:
            held[host, window] = held.get((host, window), 0) + 1
    kept = []
    for host, blocks in rows:
        words = " ".join(blocks).split(" ")
        flags = [False] * len(words)
        for i in range(len(words) - run + 1):
            n = held[host, tuple(words[i : i + run])]
            if n >= least and 2 * n > articles[host]:
                flags[i : i + run] = [True] * run
        out, at, gone = [], 0, 0
        for block in blocks:
            size = len(block.split(" "))
            if all(flags[at : at + size]):
                gone += size
            else:
                out.append(block)
            at += size
        kept.append(out if 2 * gone <= len(words) else list(blocks))
    return kept


@pytest.mark.parametrize("segment", [page_text.SEGMENT, 60])
def test_site_runs_equal_plain_counts(session, segment):
    rng = random.Random(11)
    rows = []
    for host in ("one.example", "two.example", "three.example"):
        shared = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(5)]
        for _ in range(rng.choice((12, 30))):
            blocks = [s for s in shared if rng.random() < rng.choice((0.4, 0.6, 0.9))]
            blocks += [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 4))]
            rows.append((host, blocks or ["x"]))
        rows += rows[-3:]
    expected = plainly(rows, page_text.RUN, page_text.SITE)
    changed = sum(kept != blocks for kept, (_, blocks) in zip(expected, rows))
    assert 10 < changed < len(rows) - 10
    tables = [(k, f"http://{host}/{k}", article(*blocks)) for k, (host, blocks) in enumerate(rows)]
    assert texts_of(session, tables, segment=segment) == {k: "\n".join(kept) for k, kept in enumerate(expected)}
