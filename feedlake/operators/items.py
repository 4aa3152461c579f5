"""Item reads: lookups, newest-first lists, the timeline, replay after a cursor."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import matching
from feedlake.functions.times import effective_date, moment
from feedlake.operators.skew import spread_small
from feedlake.schemas import DETAIL_COLUMNS, ITEM_COLUMNS
from feedlake.session import settled
from feedlake.sources.search_index import DETAIL, FEED, ITEM, SearchIndex
from feedlake.sources.timeline_blocks import TimelineBlocks

# List and replay lengths.
TIMELINE_LIMIT = 500
REPLAY_LIMIT = 500
CATCH_UP_LIMIT = 4096


def newest_inserted() -> list[Column]:
    return [F.desc("inserted_at"), F.desc("id")]


def newest_effective() -> list[Column]:
    return [F.desc("effective_at"), F.desc("id")]


def all_items(items: DataFrame) -> DataFrame:
    return items.select(*ITEM_COLUMNS).orderBy(*newest_inserted())


def item_by_id(items: DataFrame, item_id: int | Column) -> DataFrame:
    """One item; no row means it does not exist."""
    return items.filter(F.col("id") == item_id).select(*ITEM_COLUMNS)


def detail_by_item(details: DataFrame, item_id: int | Column) -> DataFrame:
    return details.filter(F.col("feed_item_id") == item_id).select(
        "id", "feed_item_id", *DETAIL_COLUMNS
    )


def items_by_feed(items: DataFrame, feed_id: int | Column) -> DataFrame:
    """Items of one feed, newest first; an unknown feed is just empty."""
    return items.filter(F.col("feed_id") == feed_id).select(*ITEM_COLUMNS).orderBy(*newest_inserted())


def recent_items(items: DataFrame, now: Column | dt.datetime | None = None) -> DataFrame:
    """Items of the last 24 hours, bound included."""
    return (
        items.filter(F.col("inserted_at") >= moment(now) - F.expr("INTERVAL 24 HOURS"))
        .select(*ITEM_COLUMNS)
        .orderBy(*newest_inserted())
    )


def latest_items(items: DataFrame, limit: int) -> DataFrame:
    return items.select(*ITEM_COLUMNS).orderBy(*newest_inserted()).limit(limit)


def with_detail(items: DataFrame, details: DataFrame) -> DataFrame:
    """Items with their detail columns, null where an item has none."""
    side = details.select(F.col("feed_item_id").alias("id"), *DETAIL_COLUMNS)
    return items.select(*ITEM_COLUMNS).join(side, "id", "left")


def all_items_with_detail(items: DataFrame, details: DataFrame) -> DataFrame:
    dated = with_detail(items, details).withColumn("effective_at", _effective())
    return dated.orderBy(*newest_effective()).drop("effective_at")


def item_with_detail(items: DataFrame, details: DataFrame, item_id: int | Column) -> DataFrame:
    return with_detail(item_by_id(items, item_id), detail_by_item(details, item_id))


def timeline(
    items: DataFrame,
    details: DataFrame,
    feeds: DataFrame,
    limit: int | None = None,
    feed_id: int | None = None,
    query: str | None = None,
    index: SearchIndex | None = None,
    blocks: TimelineBlocks | None = None,
) -> DataFrame:
    """Newest items with details, optionally of one feed and matching a search.

    With an ``index`` a search reads its postings; without one, for a list that
    is not indexed, it reads the texts themselves.  With ``blocks`` a limited
    list reads only blocks of ids whose newest date is good enough.

    Ranking needs only ids, dates and match flags; the wide text columns are
    fetched afterwards by the ids of the winners, so article bodies beyond them
    are never shuffled.  Items without a feed are left out.
    """
    if limit is not None and limit <= 0:
        limit, blocks = 0, None
    if feed_id is not None:
        items = items.filter(F.col("feed_id") == feed_id)
    search = matching.clean_query(query)
    hits = settled(index.hits_of(search), "search-hits") if search and index is not None else None

    def rank(rows: DataFrame, bodies: DataFrame) -> DataFrame:
        if hits is not None:
            return _indexed(rows, bodies, feeds, search, hits)
        return _matching(rows, bodies, feeds, search) if search else _dated(rows, bodies, feeds)

    if blocks is not None and limit is not None:
        items, details = blocks.newest(items, details, rank, limit)
    winners = rank(items, details)
    bodies = details.select(F.col("feed_item_id").alias("id"), *DETAIL_COLUMNS)
    if limit is not None:
        # ids and dates alone; whether they are broadcast is left to the optimizer.
        # With equal columns in both joins they are ranked once.
        winners = winners.orderBy(*newest_effective()).limit(limit)
        bodies = bodies.join(winners, "id").drop("effective_at")
    won = items.select(*ITEM_COLUMNS).join(winners, "id").join(bodies, "id", "left")
    return won.orderBy(*newest_effective()).select(*ITEM_COLUMNS, *DETAIL_COLUMNS)


def _effective() -> Column:
    return effective_date(F.col("published_at"), F.col("inserted_at"))


def _known(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Ids and insertion times of items that have a feed."""
    return (
        items.select("id", "feed_id", "inserted_at")
        .join(feeds.select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
        .select("id", "inserted_at")
    )


def _published(details: DataFrame) -> DataFrame:
    return details.select(F.col("feed_item_id").alias("id"), "published_at")


def _dated(items: DataFrame, details: DataFrame, feeds: DataFrame) -> DataFrame:
    """Ids and ordering dates, no text columns."""
    return (
        _known(items, feeds)
        .join(_published(details), "id", "left")
        .select("id", _effective().alias("effective_at"))
    )


def _indexed(items: DataFrame, details: DataFrame, feeds: DataFrame, query: str, found: DataFrame) -> DataFrame:
    """Ids and ordering dates of the items among an index's hits: ids alone are joined."""

    def flagged(rows: DataFrame, kind: str, key: str, flag: str) -> DataFrame:
        hit = found.filter(F.col("kind") == kind).select(F.col("id").alias(key), F.lit(True).alias(flag))
        return rows.join(hit, key, "left")

    known = flagged(items.select("id", "feed_id", "inserted_at"), ITEM, "id", "item_match")
    sources = flagged(feeds.select(F.col("id").alias("feed_id")), FEED, "feed_id", "feed_match")
    published = flagged(_published(details), DETAIL, "id", "detail_match").withColumn("detailed", F.lit(True))
    # a missing detail counts as an empty document: exclusions hold for it
    missing = F.col("detailed").isNull() & F.lit(matching.matches_nothing(query))
    hit = F.col("item_match") | F.col("detail_match") | F.col("feed_match") | missing
    return known.join(sources, "feed_id").join(published, "id", "left").filter(hit).select("id", _effective().alias("effective_at"))


def _matching(items: DataFrame, details: DataFrame, feeds: DataFrame, query: str) -> DataFrame:
    """Ids and ordering dates of the items that match a search.

    The search is evaluated separately on item, detail and feed documents,
    each beside its own scan, and only three flags travel through the joins.
    """
    item_doc = matching.item_document(F.col("title"), F.col("url"))
    detail_doc = matching.detail_document(F.col("summary"), F.col("content"), F.col("author"))
    texts = spread_small(items.select("id", "feed_id", "inserted_at", "title", "url"), "id")
    bodies = spread_small(details.select("feed_item_id", *DETAIL_COLUMNS), "feed_item_id")
    item_side = texts.select("id", "feed_id", "inserted_at", matching.matches(item_doc, query).alias("item_match"))
    detail_side = bodies.select(
        F.col("feed_item_id").alias("id"), "published_at", matching.matches(detail_doc, query).alias("detail_match")
    )
    feed_side = feeds.select(F.col("id").alias("feed_id"), matching.matches(item_doc, query).alias("feed_match"))
    # A missing detail counts as an empty document: exclusions hold for it.
    empty_match = matching.matches(matching.document([F.lit("")]), query)
    hit = F.col("item_match") | F.coalesce(F.col("detail_match"), empty_match) | F.col("feed_match")
    return (
        item_side.join(feed_side, "feed_id")
        .join(detail_side, "id", "left")
        .filter(hit)
        .select("id", _effective().alias("effective_at"))
    )


def items_after(items: DataFrame, cursor: int | Column, limit: int = REPLAY_LIMIT) -> DataFrame:
    """The newest ``limit`` items with a larger id, oldest first.

    ``skipped_older`` tells whether older ones had to be left out; one extra
    row is probed for it.  The windows see ``limit + 1`` rows at most.
    """
    probe = (
        items.filter(F.col("id") > cursor)
        .select(*ITEM_COLUMNS)
        .orderBy(F.desc("id"))
        .limit(limit + 1 if limit > 0 else 0)
    )
    return (
        probe.withColumn("position", F.row_number().over(Window.orderBy(F.desc("id"))))
        .withColumn("skipped_older", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
        .filter(F.col("position") <= limit)
        .drop("position")
        .orderBy("id")
    )


def high_watermark(items: DataFrame) -> DataFrame:
    """Largest item id, 0 for an empty table."""
    return items.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("high_watermark"))


def upsert_newest(
    current: DataFrame, incoming: DataFrame, limit: int = TIMELINE_LIMIT, order: str | None = None
) -> DataFrame:
    """Merge item lists by id, the incoming version winning, newest ``limit`` kept.

    Of several incoming versions of one id the last by ``order`` wins, a column of
    ``incoming``; without it, and among equals, the greatest by content, so that
    reruns agree.  ``published_at`` may be absent from either list.  Versions of one
    id are reduced before they are shuffled, so redelivered copies cost little.
    """
    columns = [*ITEM_COLUMNS, *DETAIL_COLUMNS]

    def shaped(rows: DataFrame, version: int, place: Column) -> DataFrame:
        present = [F.col(c) if c in rows.columns else _missing(c, current, incoming) for c in columns]
        return rows.select(*present, F.struct(F.lit(version).alias("list"), place.alias("place")).alias("version"))

    last = F.col(order) if order else F.lit(0)
    unplaced = F.lit(None).cast(incoming.schema[order].dataType if order else "int")
    both = shaped(current, 0, unplaced).unionByName(shaped(incoming, 1, last))
    body = F.struct(*columns[1:])
    best = F.max(F.struct("version", body.alias("row"))).alias("best")
    merged = both.groupBy("id").agg(best).select("id", "best.row.*")
    top = merged.withColumn("effective_at", _effective()).orderBy(*newest_effective()).limit(limit)
    return top.drop("effective_at")


def _missing(name: str, *frames: DataFrame) -> Column:
    for frame in frames:
        if name in frame.columns:
            return F.lit(None).cast(frame.schema[name].dataType).alias(name)
    kind = "timestamp" if name == "published_at" else "string"
    return F.lit(None).cast(kind).alias(name)
