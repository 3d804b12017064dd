from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newsloom.operators.normalize import normalize_entries
from newsloom.session import shared_folder
from newsloom.sources import feeds, sinks

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)
RSS = """<?xml version="1.0"?><rss xmlns:m="urn:m" version="2.0"><channel><title>Feed</title>
<item><title>One &amp;amp; only</title><link>http://x/1</link><m:thumb url="q"/>
<description><![CDATA[<p>First <b>text</b></p>]]></description><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item>
<item><link>http://x/2</link><description/></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title type="html">Two</title><link rel="self" href="http://y/self"/><link rel="alternate" href="http://y/1"/>
<updated>2024-01-06T00:00:00Z</updated><summary type="html">&lt;i&gt;Sum&lt;/i&gt;</summary></entry>
<entry><title>Three</title><link rel="enclosure" href="http://y/e"/><published>2024-01-07T00:00:00Z</published>
<content type="html">Body</content></entry></feed>"""


def land(root, text, feed_ord, source):
    folder = root / f"feed_ord={feed_ord}" / f"source={source}"
    folder.mkdir(parents=True)
    (folder / "f.xml").write_text(text)


def test_rss_and_atom_files(spark, tmp_path):
    land(tmp_path / "rss", RSS, 0, "A")
    land(tmp_path / "atom", ATOM, 1, "B")
    raw = feeds.read_feeds(spark, str(tmp_path / "rss"), str(tmp_path / "atom"))
    rows = normalize_entries(raw, AS_OF).orderBy("feed_ord", "entry_ord").select(
        "source", "title", "description", "url", F.col("published").cast("string")
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("A", "One & only", "First text", "http://x/1", "2024-01-05 10:00:00"),
        ("A", "Untitled", "", "http://x/2", "2024-03-01 00:00:00"),
        ("B", "Two", "Sum", "http://y/1", "2024-01-06 00:00:00"),
        ("B", "Three", "Body", "http://y/e", "2024-01-07 00:00:00"),
    ]
    registry = feeds.feed_registry(spark, {"B": "u"}, {"A": "v"})
    enabled = feeds.from_enabled_feeds(raw, registry)
    assert {(r["source"], r["feed_ord"]) for r in enabled.collect()} == {("B", 0)}


def test_rss_items_with_other_elements(spark, tmp_path):
    item = "<item><title>t</title>{}</item>"
    items = [
        "<guid>http://z/1</guid><dc:date>2024-01-08T00:00:00Z</dc:date><content:encoded>Long</content:encoded>",
        '<link>http://z/2</link><guid isPermaLink="true">http://z/no</guid><description>Short</description>'
        "<content:encoded>Long</content:encoded>",
        '<guid isPermaLink="false">tag:3</guid><description/><pubDate>09 Jan 2024</pubDate>',
    ]
    text = '<rss xmlns:dc="urn:d" xmlns:content="urn:c"><channel>{}</channel></rss>'
    land(tmp_path, text.format("".join(map(item.format, items))), 0, "A")
    rows = normalize_entries(feeds.read_rss(spark, str(tmp_path)), AS_OF).orderBy("entry_ord")
    got = rows.select("url", "description", F.col("published").cast("string")).collect()
    assert [tuple(r) for r in got] == [
        ("http://z/1", "Long", "2024-01-08 00:00:00"),
        ("http://z/2", "Short", "2024-03-01 00:00:00"),
        ("", "", "2024-01-09 00:00:00"),
    ]


def test_registry_defaults(spark):
    rows = feeds.feed_registry(spark).orderBy("feed_ord").collect()
    assert [r["enabled"] for r in rows] == [True] * 3 + [False] * 3


def test_sinks(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "train").otherwise("validation").alias("split"))
    sinks.write_training_pairs(rows, str(tmp_path / "pairs"))
    back = sinks.read_partitioned(spark, str(tmp_path / "pairs"), "split")
    assert back.exceptAll(rows).isEmpty() and back.count() == 100
    path = sinks.write_cache_version(rows, str(tmp_path / "cache"), 2)
    assert spark.read.parquet(path).count() == 100
    prompts = spark.createDataFrame([("u", "i", "p\nq")], "url string, instruction string, prompt string")
    sinks.write_prompts(prompts, str(tmp_path / "prompts"))
    assert spark.read.json(str(tmp_path / "prompts")).first()["prompt"] == "p\nq"


def session(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_follows_the_session():
    named = session("spark://host:7077", **{"spark.checkpoint.dir": "s3a://bucket/dir/"})
    assert shared_folder(named, "x").startswith("s3a://bucket/dir/x-")
    with pytest.raises(RuntimeError):
        shared_folder(session("yarn"), "x")
    local = session("local[4]", **{"spark.sql.warehouse.dir": "file:/home/me/warehouse"})
    assert shared_folder(local, "x").startswith("file:/home/me/warehouse/_work/x-")
