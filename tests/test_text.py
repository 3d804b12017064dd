from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.functions.dates import parse_when
from newsloom.functions.text import WS_CHARS, clean_html, escape_html, squeeze, strip
from newsloom.operators.normalize import (
    classification_text,
    description_of,
    normalize_entries,
    title_of,
    url_of,
    with_empty_enrichment,
)

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)
ENTRY = (
    "feed_ord int, entry_ord long, source string, title string, summary string, description string, "
    "link string, links array<struct<href:string,rel:string>>, published string, updated string"
)


def test_clean_html_order_of_steps(column):
    cases = {
        "a<br>b": "ab",
        "&lt;b&gt;bold&lt;/b&gt;": "<b>bold</b>",
        "x &amp;lt; y": "x < y",
        "it&#8217;s &#x27;q&#x27; &quot;z&quot;": "its &#x27;q&#x27; &quot;z&quot;",
        "a&nbsp;&nbsp;b\n\n\tc  d ": "a b c d",
        "": "",
        "<p>only tags</p>": "only tags",
        "1 < 2 and 3 > 2": "1  2".replace("  ", " "),
        "no tag < here": "no tag < here",
        "<> <a\nb> x > y < z <": "<> x > y < z <",
        "<" * 200000: "<" * 200000,
    }
    assert column(clean_html, list(cases)) == list(cases.values())


def test_strip_and_squeeze_follow_python_whitespace(column):
    for ch in WS_CHARS:
        assert ch.isspace()
    texts = [f"{ch}a{ch}{ch}b{ch}" for ch in WS_CHARS] + ["​a​", " a  b "]
    assert column(strip, texts) == [t.strip() for t in texts]
    assert column(squeeze, texts) == [" ".join(t.split()) for t in texts]


def test_title_default_only_when_absent(column):
    assert column(title_of, [None, "", " <i>x</i> "]) == ["Untitled", "", "x"]


def test_description_is_cleaned_before_the_cut(spark):
    rows = [("", "<p>" + "ab " * 200), (None, None), ("s", "d"), ("<b>" * 200 + "end", None)]
    df = spark.createDataFrame(rows, "s string, d string").coalesce(1)
    got = [r[0] for r in df.select(description_of(F.col("s"), F.col("d"))).collect()]
    assert got == [("ab " * 200).strip()[:300], "", "s", "end"]


def test_url_falls_back_to_first_link(spark):
    rows = [("u", None), ("", [("h", "alternate"), ("g", "x")]), (None, []), (None, None), (None, [(None, "x")])]
    df = spark.createDataFrame(rows, "link string, links array<struct<href:string,rel:string>>").coalesce(1)
    got = [r[0] for r in df.select(url_of(F.col("link"), F.col("links"))).collect()]
    assert got == ["u", "h", "", "", ""]


def test_dates(column):
    cases = {
        "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00",
        "5 Jan 2024 10:00:00 +0530": "2024-01-05 04:30:00",
        "Fri, 5 Jan 2024 10:00 EST": "2024-01-05 15:00:00",
        "2024-01-05T10:00:00.75Z": "2024-01-05 10:00:00",
        "2024-01-05T10:00:00+05:30": "2024-01-05 04:30:00",
        "2024-01-05": "2024-01-05 00:00:00",
        "12:30": None,
        "yesterday": None,
        "": None,
    }
    text = column(lambda c: parse_when(c).cast("string"), list(cases))
    assert text == list(cases.values())


def test_date_forms(column):
    cases = {
        "Sunday, 06-Nov-94 08:49:37 GMT": "1994-11-06 08:49:37",
        "Sun Nov  6 08:49:37 1994": "1994-11-06 08:49:37",
        "6 November 2024 08:49 EST": "2024-11-06 13:49:00",
        "Wed, 6 Sept. 23 8:49:00 +05:30": "2023-09-06 03:19:00",
        "06 Nov 2024": "2024-11-06 00:00:00",
        "06 Nov 2024 08:49:37": "2024-11-06 08:49:37",
        "31 Feb 2024 08:00 GMT": None,
        "06 Foo 2024": None,
        "06 Nov 2024 08:49 XYZ": None,
        "Nov 2024": None,
    }
    assert column(lambda c: parse_when(c).cast("string"), list(cases)) == list(cases.values())


def test_bad_date_falls_to_updated_then_to_the_run(spark):
    base = (1, 1, "s", "t", None, None, "u", None)
    rows = [base + ("bad", "2024-01-02"), base + ("bad", None), base + (None, None)]
    got = normalize_entries(spark.createDataFrame(rows, ENTRY).coalesce(1), AS_OF)
    texts = [r[0] for r in got.select(F.col("published").cast("string")).collect()]
    assert texts == ["2024-01-02 00:00:00", "2024-03-01 00:00:00", "2024-03-01 00:00:00"]


def test_empty_input_keeps_schema(spark):
    got = with_empty_enrichment(normalize_entries(spark.createDataFrame([], ENTRY), AS_OF))
    assert got.count() == 0
    assert dict(got.dtypes)["confidence"] == "double"
    assert dict(got.dtypes)["published"] == "timestamp"


def test_classification_text(spark):
    rows = [("t", "d" * 300), ("t", None), (None, "d"), (" t", " ")]
    df = spark.createDataFrame(rows, "t string, d string").coalesce(1)
    got = [r[0] for r in df.select(classification_text(F.col("t"), F.col("d"))).collect()]
    assert got == ["t. " + "d" * 200, "t.", None, "t."]


def test_escape_html_ampersand_first(column):
    assert column(escape_html, ["<a href=\"x\">&lt;'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;lt;&#x27;"]
