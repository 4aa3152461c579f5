from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import small
from conftest import at
from feedlake.sources import feed_xml, logs
from feedlake.sources.tables import TableStore, save_bucketed

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom">
  <title type="text">Rails &amp; roads</title>
  <link href="https://trains.example" rel="alternate"/>
  <link href="https://trains.example/feed" rel="self"/>
  <id>urn:uuid:rails</id>
  <entry>
    <title type="html">Night trains</title>
    <link href="https://trains.example/1" rel="alternate"/><link href="https://trains.example/1b"/>
    <id>https://trains.example/1#8</id>
    <summary>Sleepers are back</summary>
    <content type="html"><![CDATA[<p>Nine new lines</p>]]></content>
    <author><name>Mira Holm</name></author><author><name>Ivo</name></author>
    <published>2026-07-01T10:00:00Z</published><updated>2026-07-02T10:00:00Z</updated>
  </entry>
  <entry><link href="https://trains.example/2"/><id>https://trains.example/2</id></entry>
  <entry><id></id><link href="https://trains.example/3#4"/><updated>2026-07-03T12:00:00+02:00</updated></entry>
</feed>"""
RSS = """<?xml version="1.0"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"
     xmlns:atom="http://www.w3.org/2005/Atom">
<channel><title>Channel</title><atom:link href="https://r.example/self" rel="self"/><link>https://r.example/home</link>
<item><title>One</title><guid isPermaLink="false">tag:1#a</guid><link>https://r.example/1</link>
<description>short &lt;b&gt;</description><content:encoded><![CDATA[long]]></content:encoded>
<dc:creator>Ann</dc:creator><pubDate>Wed, 01 Jul 2026 10:00:00 +0000</pubDate></item>
<item><title>Two</title><pubDate>01 Jul 2026 10:00:00 GMT</pubDate></item>
</channel></rss>"""


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(1, ATOM), (2, RSS), (3, ATOM[:-9]), (4, "<html><body/></html>"), (5, "no xml"), (6, None)]
    return spark.createDataFrame(rows, "feed_id long, body string")


def test_metadata(bodies):
    rows = {r.feed_id: tuple(r)[1:] for r in feed_xml.read_feeds(bodies).collect()}
    assert rows[1] == ("Rails & roads", "https://trains.example/", True)
    assert rows[2] == ("Channel", "https://r.example/home", True)
    assert [rows[i][2] for i in (3, 4, 5, 6)] == [False] * 4


def test_entries(bodies):
    now = at("2030-01-01T00:00:00")
    rows = feed_xml.read_entries(bodies, F.lit(now)).orderBy("feed_id", "pos").collect()
    assert [(r.feed_id, r.pos) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    first, sparse, linked, one, two = rows
    assert tuple(first)[2:] == (
        "https://trains.example/1", "Night trains", "https://trains.example/1", "Sleepers are back",
        "<p>Nine new lines</p>", "Mira Holm", at("2026-07-01T10:00:00"),
    )
    assert tuple(sparse)[2:] == ("https://trains.example/2", "(no title)", "https://trains.example/2", "", "", "", now)
    assert (linked.external_id, linked.published_at) == ("https://trains.example/3", at("2026-07-03T10:00:00"))
    assert (one.external_id, one.summary, one.content, one.author) == ("tag:1#a", "short <b>", "long", "Ann")
    assert one.published_at == two.published_at == at("2026-07-01T10:00:00")
    assert (two.external_id, two.url) == ("fallback:Two:2026-07-01T10:00:00+00:00", "")


RDF = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
     xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="https://d.example/rss"><title>Old</title><link>https://d.example/home</link>
<items><rdf:Seq><rdf:li resource="https://d.example/1"/></rdf:Seq></items></channel>
<item rdf:about="https://d.example/1"><title>One</title><link>https://d.example/1</link>
<description>short</description><dc:creator>Ann</dc:creator><dc:date>2026-07-01T12:00:00+02:00</dc:date></item>
<item rdf:about="https://d.example/2"><title>Two</title><link>https://d.example/2</link><dc:date>2026-07-02</dc:date></item>
</rdf:RDF>"""
DATED = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>
<item><title>a</title><guid>1</guid><dc:date>2026-07-01T10:00:00Z</dc:date></item>
<item><title>b</title><guid>2</guid><pubDate>no date</pubDate><dc:date>2026-07-01T10:00:00Z</dc:date></item>
</channel></rss>"""
XHTML = """<feed xmlns="http://www.w3.org/2005/Atom"><title>x</title><entry><id>1</id><title>plain</title>
<summary type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">just <b>this</b></div></summary>
<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>one <i>two</i></p></div></content></entry></feed>"""


def test_rdf_dublin_core_dates_and_xhtml(spark):
    bodies = spark.createDataFrame([(1, RDF), (2, DATED), (3, XHTML)], "feed_id long, body string")
    feeds = {r.feed_id: tuple(r)[1:] for r in feed_xml.read_feeds(bodies).collect()}
    assert feeds[1] == ("Old", "https://d.example/home", True)
    rows = feed_xml.read_entries(bodies, F.lit(at("2030-01-01T00:00:00"))).orderBy("feed_id", "pos").collect()
    assert [(r.feed_id, r.external_id) for r in rows] == [
        (1, "https://d.example/1"), (1, "https://d.example/2"), (2, "1"), (2, "2"), (3, "1")
    ]
    assert tuple(rows[0])[3:] == ("One", "https://d.example/1", "short", "", "Ann", at("2026-07-01T10:00:00"))
    assert rows[1].published_at == at("2026-07-02T00:00:00")
    assert rows[2].published_at == rows[3].published_at == at("2026-07-01T10:00:00")
    assert "<b>this</b>" in rows[4].summary and "just" in rows[4].summary
    assert "<p>one <i>two</i></p>" in rows[4].content.replace("\n", "")


def test_logs(spark, tmp_path):
    lines = ['{"route":"/a","method":"GET","duration_ms":12,"extra":1}', '{"level":"WARN"}']
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    rows = logs.read_logs(spark, str(tmp_path)).collect()
    assert sorted((r.route or "", r.duration_ms or 0) for r in rows) == [("", 0), ("/a", 12)]


def test_store_batches_can_be_repeated(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.read("feed_items").count() == 0 and store.snapshot("feeds").count() == 0
    store.append("feed_items", small.items(spark, (2, 1, "b", "00:00:00"), (1, 1, "a", "00:00:00")), 0)
    for _ in range(2):
        store.append("feed_items", small.items(spark, (3, 1, "c", "00:00:00")), 1)
    assert sorted(r.id for r in store.read("feed_items").collect()) == [1, 2, 3]
    assert sorted(r.id for r in store.read("feed_items", before_batch=1).collect()) == [1, 2]
    store.write_snapshot("feeds", small.feeds(spark, (1, {})), 0)
    store.write_snapshot("feeds", small.feeds(spark, (1, {"title": "later"})), 10)
    assert store.snapshot("feeds").first().title == "later"
    assert store.snapshot("feeds", before_batch=10).first().title is None


def test_bucketed_tables_join_without_a_shuffle(spark):
    save_bucketed(
        small.items(spark, *[(i, 1, "t", "00:00:00") for i in range(20)]),
        small.details(spark, *[(i, "s", "c", "2024-01-01T00:00:00") for i in range(20)]),
        buckets=4,
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items, details = spark.table("feed_items"), spark.table("feed_item_details")
        joined = items.join(details, items.id == details.feed_item_id)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("feed_items", "feed_item_details"):
            spark.sql(f"drop table {name}")


def test_shared_folder_is_the_named_one(spark):
    from feedlake.session import new_folder, settled, shared_folder

    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and new_folder(spark, "x").startswith(named)
    df = spark.range(5)
    assert settled(df, "numbers").count() == 5
    assert named in settled(df, "numbers").inputFiles()[0]


PREFIXED = """<?xml version="1.0"?>
<!-- a comment -->
<at:feed xmlns:at='http://www.w3.org/2005/Atom' xmlns:x="urn:x"><at:title>Boats</at:title><at:link href="https://b.example"/>
<at:entry><at:id>7</at:id><at:title>Tide &lt;at:b&gt;</at:title><x:id>no</x:id>
<at:content type="html"><![CDATA[<at:p>kept</at:p>]]></at:content><at:author><at:name>Odd</at:name></at:author>
<at:published>2026-07-01T10:00:00Z</at:published></at:entry></at:feed>"""
PREFIXED_RDF = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://purl.org/rss/1.0/">
<s:channel><s:title>Old</s:title><s:link>https://o.example/</s:link></s:channel>
<s:item><s:title>One</s:title><s:link>https://o.example/1</s:link></s:item></r:RDF>"""
JSON = """﻿ {"version": "https://jsonfeed.org/version/1.1", "title": "Kites", "home_page_url": "https://k.example",
"feed_url": "https://k.example/f.json", "items": [
{"id": "https://k.example/1#2", "url": "https://k.example/1", "title": "Up", "summary": "s", "content_html": "<p>h</p>",
 "content_text": "h", "authors": [{"name": "Kai"}, {"name": "Li"}], "date_published": "2026-07-01T12:00:00+02:00"},
{"id": 12, "external_url": "https://k.example/2", "content_text": " plain ", "author": {"name": "Old"},
 "date_modified": "2026-07-02T00:00:00Z", "tags": ["x"]}, {}]}"""


def test_prefixed_names_and_json_feeds(spark):
    other = '{"version": "https://example.org/1", "title": "x", "items": []}'
    bodies = spark.createDataFrame(
        [(1, PREFIXED), (2, PREFIXED_RDF), (3, JSON), (4, JSON[:-5]), (5, other), (6, "{}"), (7, "{"), (8, "[1]"), (9, ""),
         (10, JSON.replace("version/1.1", "version/1"))],
        "feed_id long, body string",
    )
    feeds = {r.feed_id: tuple(r)[1:] for r in feed_xml.read_feeds(bodies).collect()}
    assert feeds[1] == ("Boats", "https://b.example/", True)
    assert feeds[2] == ("Old", "https://o.example/", True)
    assert feeds[3] == feeds[10] == ("Kites", "https://k.example/", True)
    assert [feeds[i][2] for i in range(4, 10)] == [False] * 6
    now = at("2030-01-01T00:00:00")
    rows = feed_xml.read_entries(bodies.filter("feed_id < 10"), F.lit(now)).orderBy("feed_id", "pos").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "7", "Tide <at:b>", "", "", "<at:p>kept</at:p>", "Odd", at("2026-07-01T10:00:00")),
        (2, 0, "https://o.example/1", "One", "https://o.example/1", "", "", "", now),
        (3, 0, "https://k.example/1", "Up", "https://k.example/1", "s", "<p>h</p>", "Kai", at("2026-07-01T10:00:00")),
        (3, 1, "12", "(no title)", "https://k.example/2", "", " plain ", "Old", at("2026-07-02T00:00:00")),
        (3, 2, "fallback::", "(no title)", "", "", "", "", now),
    ]
