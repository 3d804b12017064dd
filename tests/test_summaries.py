from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions.markup import clean_summary, fallback_summary
from newsloom.operators import cache, summaries


def bodies_of(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").coalesce(1)
    return [r["body"] for r in summaries.extract_body(df).orderBy("k").collect()]


def test_extract_body_rules(spark):
    got = bodies_of(
        spark,
        "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1>"
        "<p>One<br>two</p><!-- note --><table><tr><td>no</td></tr></table><p>a &amp;lt; b</p></article>"
        "<footer>foot</footer></body></html>",
        '<body><script>var t="</p></body>";</script><p>Kept</p>',
        "<body><ARTICLE class='x'>never closed <b>bold</b>",
        "",
        "<p>loose</p> text <p>two\n lines</p>",
        "<article>" + "x" * 9000 + "</article>",
        "<article><nav>only menu</nav></article><p>second chance</p>",
        "<style>p{}</style><div>\xa0 \t</div>",
    )
    assert got == [
        "Head\nOne\ntwo\na &lt; b", "Kept", "never closed bold", None, "loose\ntwo\nlines",
        "x" * config.PAGE_BODY_CHARS, "second chance", None,
    ]


ARTICLE = "url string, title string, description string, source string"


def test_body_choice_and_prompts(spark):
    pages = spark.createDataFrame(
        [("a", "<p>page</p>"), ("a", "<p>zz</p>"), ("#", "<p>no</p>"), ("", "<p>no</p>"), ("b", "<nav>x</nav>")],
        "url string, html string",
    )
    articles = spark.createDataFrame(
        [("a", "A", "da", "S"), ("#", "H", " dh ", ""), ("b", " B ", " ", None), ("c", "C", "d" * 1500, "S"),
         ("d", "", "", "S")],
        ARTICLE,
    )
    bodies = summaries.page_bodies(pages)
    assert bodies.count() == 1
    chosen = summaries.choose_body(articles, bodies)
    got = {r["url"]: (r["body"], r["body_source"]) for r in chosen.collect()}
    assert got == {
        "a": ("page", "full_article"), "#": ("dh", "rss_description"), "b": ("B", "rss_description"),
        "c": ("d" * 1200, "rss_description"), "d": ("", "rss_description"),
    }
    prompts = {r["url"]: r["prompt"] for r in summaries.build_prompts(chosen).collect()}
    assert prompts["a"] == "Source: S\nTitle: A\n\nArticle:\npage"
    assert prompts["#"] == "Title: H\n\nArticle:\ndh"
    assert "d" not in prompts


RESPONSE = "url string, attempt int, model string, response_text string, error_text string"


def test_resolution(spark):
    rows = [
        ("first", 1, "primary", " ok ", None), ("first", 2, "primary", "later", None),
        ("blank", 1, "primary", " \n", None), ("blank", 2, "primary", "second", None),
        ("limited", 1, "primary", None, "429 Quota"), ("limited", 2, "primary", "fine", None),
        ("moved", 1, "primary", None, "Model not found"), ("moved", 2, "backup", "saved", None),
        ("gone", 1, "backup", None, "HTTP 404"), ("gone", 2, "backup", "ignored", None),
        ("late", 6, "primary", "too late", None), ("never", 1, "primary", None, "boom"),
        ("both", 1, "backup", None, "quota for model not found"), ("both", 2, "backup", "yes", None),
    ]
    df = spark.createDataFrame(rows, RESPONSE)
    got = {r["url"]: r["response_text"] for r in summaries.resolve_responses(df).collect()}
    assert got == {"first": "ok", "blank": "second", "limited": "fine", "moved": "saved", "both": "yes"}
    classes = {r[0]: r[1] for r in summaries.attempt_error_classes(df).collect()}
    assert classes == {"rate_limit": 2, "model_not_found": 2, "other": 1}


def test_clean_summary(column):
    texts = {
        "**Bold** and *it*\n\n1. one\n2) two\n\n\n- dash\n• dot": "Bold and it\n\none two\n\ndash dot",
        "foo_bar_baz `code` # Head\nC# is": "foobarbaz code Head Cis",
        "* a\n* b\n": "a b",
        "": "",
        "## \n\n": "",
        "a\r\n \r\nb\x0bc\x1cd e\x85f": "a\n\nb c d e f",
        "  1.  x\n 10) y\n3.z": "x y 3.z",
        "__u__ ****": "u ****",
        "para\n \t \n\n two   spaces\xa0here": "para\n\ntwo spaces here",
    }
    assert column(clean_summary, list(texts)) == list(texts.values())


def test_fallback(column):
    texts = {
        None: config.EMPTY_SUMMARY, "": config.EMPTY_SUMMARY,
        "Short. Tiny!": "Short. Tiny!",
        " Exactly 15 chr. A sentence that is long enough. No? ": "A sentence that is long enough.",
        "The first long sentence. The second long sentence!\nStill goes on without end": (
            "The first long sentence.\n\nThe second long sentence!\n\nStill goes on without end"
        ),
    }
    assert column(fallback_summary, list(texts)) == list(texts.values())


def test_summaries_without_and_with_responses(spark):
    articles = spark.createDataFrame(
        [("a", "Title a", "", "S"), ("b", "Title b", "A description of b.", "S"), ("c", "", "", "S")], ARTICLE
    )
    pages = summaries.page_bodies(spark.createDataFrame([], "url string, html string"))
    resolved = spark.createDataFrame(
        [("a", 1, "**Sum** a"), ("b", 1, "# "), ("c", 1, "no body, no call")],
        "url string, attempt int, response_text string",
    )
    got = {r["url"]: r for r in summaries.summarize_articles(articles, pages, resolved).collect()}
    assert (got["a"]["summary"], got["a"]["summary_source"]) == ("Sum a", "model")
    assert (got["b"]["summary"], got["b"]["summary_source"]) == ("A description of b.", "fallback")
    assert (got["c"]["summary"], got["c"]["summary_source"]) == (config.EMPTY_SUMMARY, "fallback")
    plain = summaries.summarize_articles(articles, pages)
    assert {r["summary_source"] for r in plain.collect()} == {"fallback"}
    assert set(plain.columns) == set(got["a"].asDict())


CACHE = "url string, summary string, summary_source string, body_source string, version long"


def test_cache(spark):
    articles = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "T")], "url string, title string")
    stored = spark.createDataFrame(
        [("a", "old", "model", "x", 1), ("a", "new", "model", "x", 2), ("gone", "g", "model", "x", 1),
         ("T", "by title", "fallback", "x", 1)],
        CACHE,
    )
    assert [r["url"] for r in cache.pending(articles, stored).collect()] == ["b"]
    fresh = spark.createDataFrame([("a", "same version", "fallback", "y", 2), ("b", "b1", "model", "y", 1)], CACHE)
    merged = cache.merge(stored, fresh)
    assert {r["url"]: r["summary"] for r in merged.collect()} == {
        "a": "same version", "b": "b1", "gone": "g", "T": "by title",
    }
    shown = cache.with_cached_summary(articles, merged)
    assert {r["title"]: r["summary"] for r in shown.collect()} == {
        "A": "same version", "B": "b1", "T": "by title",
    }
    rows = cache.as_cache_rows(shown, F.lit(3).cast("long"))
    assert rows.columns == list(cache.CACHE_COLUMNS)
