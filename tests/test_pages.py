"""Main text of pages and character references, by rule and against the same rules as SQL."""

from __future__ import annotations

import html
import random
import time

import duckdb
import pandas as pd
import pytest

from newsloom.functions.pages import decode_references, main_text
from newsloom.operators.summaries import extract_body
from newsloom.plans import oracles
from newsloom.session import BATCH_ROWS

CASES = {
    "<body><form><nav>menu</nav><div><p>in a form</p></div></form></body>": "in a form",
    "<body><form><div>no paragraph</div></form></body>": "no paragraph",
    "<article><p>teaser</p></article><p>x</p><article><p>story</p></article>": "teaser\nstory",
    "<form><article>wrapped</article></form>": "wrapped",
    "<article>a<table><tr><td>b<table><tr><td>c</td></tr></table>d</td></tr></table>e</article>": "a\ne",
    "<body><nav>lost <p>end tag</p><p>text</p></body>": "lost\nend tag\ntext",
    "<body><nav>menu</nav></nav></footer><p>text</p></body>": "text",
    "<article><p>read <a href=x>this</a> now please</p><p><a>more</a> | <a>less</a></p><h2><a>head</a></h2></article>":
        "read this now please\nhead",
    "<article>x&#8217;s &mdash; y &#x2014; &#150; &notaname; &amp;lt; &#0; &#xD800; &#99999999; &copy 5</article>":
        "x’s — y — – &notaname; &lt; � � &#99999999; &copy 5",
    "<article>a < b <> c <! d> e </ f> g <1</article>": "a < b <> c e g <1",
    "<article>one<br>two<br/>three\nfour</article>": "one\ntwo\nthree\nfour",
    "<body><p>open para<p>next<!-- <p>no --><script>'<p>no</p>'</script><style>p{}": "open para\nnext",
    "<article><nav>only</nav></article><body><div>rest</div></body>": "rest",
    "<title>T</title><p>loose</p>text": "loose",
    "<b>bare</b>": "", "": "", "<": "", "<article": "", "<script>": "", "<script": "",
}


@pytest.mark.parametrize("page", CASES)
def test_rules(page):
    assert main_text(page) == CASES[page]


def sql_bodies(pages: list[str]) -> dict[int, str]:
    rows = pd.DataFrame({"page_id": range(len(pages)), "url": "u", "html": pages})
    con = duckdb.connect()
    con.register("page_cases", rows)
    ctes = ", ".join(f"{n} as ({q})" for n, (_, q) in oracles.body_ctes("page_cases").items())
    found = con.execute(f"with {ctes} select page_id, body from bodies").fetchall()
    return {k: body or "" for k, body in found}


def test_rules_as_sql():
    rng = random.Random(11)
    parts = [
        "<article>", "</article>", "<nav>", "</nav>", "<form>", "</form>", "<table>", "</table>", "<p>", "</p>", "<a>",
        "</a>", "<b>", "</b>", "<br>", "<body>", "</body>", "<li>", "<aside class='x>'>", "</aside>", "word", " two words ",
        "\n", "&amp;", "&#x41;", "&eacute", "&eacute;", "<h2>", "</h2>", "<", "<!--", "-->", "<div", "<script>", "</script>", "\xa0",
    ]
    pages = [*CASES, *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500))]
    found = sql_bodies(pages)
    different = [(p, main_text(p)[:8000], found[k]) for k, p in enumerate(pages) if main_text(p)[:8000] != found[k]]
    assert not different


def test_references_against_the_library():
    """The library also decodes names without a semicolon, so only closed ones are compared."""
    rng = random.Random(3)
    names = list(html.entities.html5)
    for _ in range(2000):
        name = rng.choice(names).rstrip(";")
        text = f"x &{name}; y &#{rng.randint(161, 50000)}; &#x{rng.randint(161, 50000):X}; &{name};;"
        assert decode_references(text) == html.unescape(text)
    for n in range(0x80, 0xA0):
        assert decode_references(f"&#{n};") == html.unescape(f"&#{n};")


@pytest.mark.parametrize("unit", ["<", "<nav>", "</nav>", "<a>", "<b>x", "<!--", "<script>", "<p><a>", "&", "<article>"])
def test_long_broken_pages_take_linear_time(unit):
    began = time.time()
    main_text("<body>" + unit * 100_000)
    assert time.time() - began < 5


def test_filter_on_the_body_walks_once(spark):
    from tests.conftest import plan_of

    pages = spark.createDataFrame([("<p>x</p>",), (None,), ("",)], "html string")
    kept = extract_body(pages).filter("body is not null")
    assert plan_of(kept).count("ArrowEvalPython") == 1
    assert [r["body"] for r in kept.collect()] == ["x"]


def test_workers_get_few_pages_at_a_time(spark):
    """A batch is bounded by rows, whatever the session allowed before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for allowed in ("10000", "0"):
            spark.conf.set(name, allowed)
            extract_body(spark.createDataFrame([(1, "<body><p>a</p>")], "page_id int, html string"))
            assert int(spark.conf.get(name)) == BATCH_ROWS
        spark.conf.set(name, "7")
        extract_body(spark.createDataFrame([(1, "")], "page_id int, html string"))
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
