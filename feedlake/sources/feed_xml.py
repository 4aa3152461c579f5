"""RSS 2.0, RSS 1.0 (RDF), Atom and JSON Feed bodies to entries, through Spark's own readers.

Each body is read by the reader of its dialect alone; Atom and RSS 1.0 names may
carry a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.links import with_root_path
from feedlake.functions.text import external_id
from feedlake.functions.times import feed_date, published_date, rfc3339

_TEXT = "STRUCT<_VALUE: STRING>"
_ATOM_LINK = "ARRAY<STRUCT<_href: STRING>>"
#: Atom texts: xhtml comes as markup inside a div.
_RICH = "STRUCT<_VALUE: STRING, div: STRING, `xhtml:div`: STRING>"
_ITEMS = f"""ARRAY<STRUCT<
            `_rdf:about`: STRING, guid: {_TEXT}, title: {_TEXT}, link: ARRAY<{_TEXT}>, description: {_TEXT},
            `content:encoded`: {_TEXT}, author: ARRAY<{_TEXT}>, `dc:creator`: ARRAY<{_TEXT}>,
            pubDate: STRING, `dc:date`: ARRAY<{_TEXT}>>>"""
#: All dialects in one schema: Atom puts entries at the root, RSS 2.0 in a
#: channel, RSS 1.0 at the root beside the channel.
BODY = f"""
    title {_TEXT}, link {_ATOM_LINK},
    entry ARRAY<STRUCT<
        id: {_TEXT}, title: {_RICH}, link: {_ATOM_LINK}, summary: {_RICH}, content: {_RICH},
        author: ARRAY<STRUCT<name: STRING>>, published: STRING, updated: STRING>>,
    channel STRUCT<
        title: {_TEXT}, link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING>>,
        item: {_ITEMS}>,
    item {_ITEMS},
    _unreadable STRING
"""
#: JSON Feed, versions 1 and 1.1: the first has one author, the second a list.
_AUTHOR = "STRUCT<name: STRING>"
JSON_BODY = f"""
    version STRING, title STRING, home_page_url STRING, feed_url STRING,
    items ARRAY<STRUCT<
        id: STRING, url: STRING, external_url: STRING, title: STRING, summary: STRING,
        content_html: STRING, content_text: STRING, date_published: STRING, date_modified: STRING,
        author: {_AUTHOR}, authors: ARRAY<{_AUTHOR}>>>,
    _unreadable STRING
"""
# How the version of a JSON Feed starts, and the namespaces of the
# dialects whose own names may carry a prefix.
JSON_FEED_VERSION = "https://jsonfeed.org/version/1"
ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"
RSS1_NAMESPACE = "http://purl.org/rss/1.0/"
#: What may stand before the root element.
_HEAD = r"(?s)^(?:<\?.*?\?>|<!--.*?-->|<![^>\[]*>|\s+)*"
#: The prefix a root element binds to its dialect; Atom's root must carry it itself.
_PREFIX = (
    _HEAD + rf"""<([\w.-]+):feed\s[^>]*?xmlns:\1\s*=\s*["']{ATOM_NAMESPACE}["']""",
    _HEAD + rf"""<[\w.-]+:RDF\s[^>]*?xmlns:([\w.-]+)\s*=\s*["']{RSS1_NAMESPACE}["']""",
)
NO_TITLE = "(no title)"
_BLANKS = " \t\r\n\ufeff"


def parsed(body: Column) -> Column:
    """``xml`` or ``json``, whichever the body is written in; the other one is null."""
    text = F.ltrim(body, F.lit(_BLANKS))
    is_json = text.startswith("{")
    options = {"columnNameOfCorruptRecord": "_unreadable", "mode": "PERMISSIVE"}
    return F.struct(
        F.from_xml(F.when(~is_json, without_prefix(text)), BODY, options).alias("xml"),
        F.from_json(F.when(is_json, text), JSON_BODY, options).alias("json"),
    )


def without_prefix(xml: Column) -> Column:
    """A body whose own names carry a prefix, with plain names.

    The prefix counts only if the root element binds it to the dialect's namespace
    (for Atom also carries it), so an Atom link inside RSS stays what it is.
    CDATA sections and comments are left alone.
    """
    prefix = F.concat(*[F.regexp_extract(xml, pattern, 1) for pattern in _PREFIX])
    names = F.concat(F.lit(r"(?s)(<!\[CDATA\[.*?\]\]>|<!--.*?-->)|(</?)\Q"), prefix, F.lit(r"\E:"))
    plain = F.when(prefix != "", F.regexp_replace(xml, names, F.lit("$1$2"))).otherwise(xml)
    # One look at the root spares most bodies the rest.
    return F.when(xml.rlike(_HEAD + r"<[\w.-]+:"), plain).otherwise(xml)


def is_readable(feed: Column) -> Column:
    """A well-formed body that is a feed of one of the dialects."""
    xml, json = feed["xml"], feed["json"]
    some = F.coalesce(
        xml["title"]["_VALUE"], xml["channel"]["title"]["_VALUE"], F.get(xml["entry"]["id"]["_VALUE"], F.lit(0))
    )
    shape = some.isNotNull() | xml["entry"].isNotNull() | xml["channel"].isNotNull()
    is_xml = xml.isNotNull() & xml["_unreadable"].isNull() & shape
    is_json = json.isNotNull() & json["_unreadable"].isNull() & json["version"].startswith(JSON_FEED_VERSION)
    return F.coalesce(is_xml, F.lit(False)) | F.coalesce(is_json, F.lit(False))


def read_feeds(bodies: DataFrame) -> DataFrame:
    """Feed title and site of every body, and whether it could be read.

    Input ``bodies(feed_id, body)`` plus any columns to carry along.
    """
    carried = [c for c in bodies.columns if c != "body"]
    feed = F.col("feed")
    xml, json = feed["xml"], feed["json"]
    site = F.coalesce(
        F.get(xml["link"]["_href"], F.lit(0)),
        F.get(_filled(xml["channel"]["link"]["_VALUE"]), F.lit(0)),
        json["home_page_url"],
        json["feed_url"],
    )
    title = F.coalesce(xml["title"]["_VALUE"], xml["channel"]["title"]["_VALUE"], json["title"])
    return bodies.select(*carried, parsed(F.col("body")).alias("feed")).select(
        *carried,
        title.alias("title"),
        with_root_path(site).alias("site_url"),
        F.coalesce(is_readable(feed), F.lit(False)).alias("parsed_ok"),
    )


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _entries(feed: Column) -> Column:
    """Entries of all dialects in one shape."""

    def rich(text: Column) -> Column:
        return F.coalesce(text["div"], text["xhtml:div"], text["_VALUE"])

    def atom(e: Column) -> Column:
        return F.struct(
            e["id"]["_VALUE"].alias("guid"),
            F.get(e["link"]["_href"], F.lit(0)).alias("link"),
            rich(e["title"]).alias("title"),
            rich(e["summary"]).alias("summary"),
            rich(e["content"]).alias("content"),
            F.get(e["author"]["name"], F.lit(0)).alias("author"),
            e["published"].alias("published"),
            e["updated"].alias("updated"),
        )

    def rss(i: Column) -> Column:
        return F.struct(
            F.coalesce(i["guid"]["_VALUE"], i["_rdf:about"]).alias("guid"),
            F.get(i["link"]["_VALUE"], F.lit(0)).alias("link"),
            i["title"]["_VALUE"].alias("title"),
            i["description"]["_VALUE"].alias("summary"),
            i["content:encoded"]["_VALUE"].alias("content"),
            F.coalesce(
                F.get(i["author"]["_VALUE"], F.lit(0)), F.get(i["dc:creator"]["_VALUE"], F.lit(0))
            ).alias("author"),
            i["pubDate"].alias("published"),
            F.get(i["dc:date"]["_VALUE"], F.lit(0)).alias("updated"),
        )

    def json(i: Column) -> Column:
        return F.struct(
            i["id"].alias("guid"),
            F.coalesce(i["url"], i["external_url"]).alias("link"),
            i["title"].alias("title"),
            i["summary"].alias("summary"),
            F.coalesce(i["content_html"], i["content_text"]).alias("content"),
            F.coalesce(F.get(i["authors"]["name"], F.lit(0)), i["author"]["name"]).alias("author"),
            i["date_published"].alias("published"),
            i["date_modified"].alias("updated"),
        )

    xml = feed["xml"]
    inside, beside = xml["channel"]["item"], xml["item"]
    items = F.coalesce(F.concat(inside, beside), inside, beside)
    return F.coalesce(F.transform(xml["entry"], atom), F.transform(items, rss), F.transform(feed["json"]["items"], json))


def read_entries(bodies: DataFrame, now: Column) -> DataFrame:
    """Normalised entries of every readable body, with their position in it.

    Missing texts become '' and a missing date becomes ``now``, so every entry
    has a detail.
    """
    carried = [c for c in bodies.columns if c != "body"]
    raw = (
        bodies.select(*carried, parsed(F.col("body")).alias("feed"))
        # The outer form and no filter before it: either would have every body parsed again.
        .select(*carried, F.posexplode_outer(F.when(is_readable(F.col("feed")), _entries(F.col("feed")))).alias("pos", "e"))
        .filter(F.col("pos").isNotNull())
    )
    dated = raw.select(
        *carried,
        "pos",
        "e",
        published_date(feed_date(F.col("e.published")), feed_date(F.col("e.updated"))).alias("given"),
    )
    return normalize_entries(
        dated.select(*carried, "pos", "e.guid", "e.link", "e.title", "e.summary", "e.content", "e.author", "given"),
        now,
    )


def normalize_entries(raw: DataFrame, now: Column) -> DataFrame:
    """Entry rules on ``raw(guid, link, title, summary, content, author, given)``."""
    own = {"guid", "link", "title", "summary", "content", "author", "given"}
    carried = [c for c in raw.columns if c not in own]
    empty = F.lit("")
    identifier = external_id(F.col("guid"), F.col("link"), F.col("title"), rfc3339(F.col("given"), "+00:00"))
    return raw.select(
        *carried,
        identifier.alias("external_id"),
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        F.coalesce("link", empty).alias("url"),
        F.coalesce("summary", empty).alias("summary"),
        F.coalesce("content", empty).alias("content"),
        F.coalesce("author", empty).alias("author"),
        F.coalesce("given", now).alias("published_at"),
    )


__all__ = ["BODY", "JSON_BODY", "is_readable", "normalize_entries", "parsed", "read_entries", "read_feeds", "without_prefix"]
