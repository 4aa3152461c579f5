"""Missed items per consumer: cursors, replay, markers, lag, event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.times import rfc3339
from feedlake.operators.items import CATCH_UP_LIMIT, REPLAY_LIMIT, items_after
from feedlake.operators.keys import block_of, totals_before
from feedlake.schemas import ITEM_COLUMNS

MARKER = "replayed DOUBLE, limited BOOLEAN, last_event_id DOUBLE"

#: Ids counted by one task.
ID_BLOCK = 1 << 20


def cursor_number(text: Column) -> Column:
    """A cursor given as text; anything but a whole number is ignored."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def request_cursors(consumers: DataFrame) -> DataFrame:
    """``cursor`` of each request: the header if it is valid, else the query parameter."""
    return consumers.withColumn(
        "cursor", F.coalesce(cursor_number(F.col("header_id")), F.col("query_id"))
    )


def resume_cursors(consumers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``resume_cursor``: newest id a consumer already shows, else its stored cursor."""
    shown = snapshots.groupBy("consumer_id").agg(F.max("id").alias("shown"))
    return (
        consumers.join(shown, "consumer_id", "left")
        .withColumn("resume_cursor", F.coalesce("shown", cursor_number(F.col("stored_cursor"))))
        .drop("shown")
    )


def newest_ids(items: DataFrame, limit: int) -> Column:
    """The ``limit`` newest ids, largest first, as a scalar array."""
    top = items.select("id").orderBy(F.desc("id")).limit(limit)
    return top.agg(F.sort_array(F.collect_list("id"), asc=False)).scalar()


def replay_windows(consumers: DataFrame, items: DataFrame, limit: int = REPLAY_LIMIT) -> DataFrame:
    """Ids to replay per consumer, as ``missed`` (oldest first) and ``limited``.

    Whatever a consumer's cursor is, its newest ``limit`` missed items are
    among the newest ``limit`` of all items.  So one bounded array of ids
    serves every consumer and nothing is joined.  No cursor, no replay.
    """
    probe = newest_ids(items, limit + 1)
    newer = F.filter(F.col("probe"), lambda i: i > F.col("cursor"))
    ahead = F.when(F.col("cursor").isNotNull(), F.slice(newer, 1, limit)).otherwise(
        F.array().cast("array<bigint>")
    )
    limited = F.col("cursor").isNotNull() & (F.size(newer) > limit)
    return consumers.withColumn("probe", probe).select(
        *consumers.columns, F.reverse(ahead).alias("missed"), limited.alias("limited")
    )


def replay_markers(windows: DataFrame) -> DataFrame:
    """What ends a replay: how many, whether older ones were skipped, last id."""
    last = F.coalesce(F.get("missed", F.size("missed") - 1), F.col("cursor"))
    return windows.select(
        "consumer_id",
        F.size("missed").cast("long").alias("replayed"),
        "limited",
        last.alias("last_event_id"),
    )


def marker_data(markers: DataFrame) -> DataFrame:
    payload = F.struct("replayed", "limited", "last_event_id")
    return markers.withColumn("data", F.to_json(payload, {"ignoreNullFields": "false"}))


def read_marker(data: Column) -> Column:
    """Typed marker from its text; missing or mistyped fields get defaults."""
    parsed = F.from_json(data, MARKER)
    return F.struct(
        F.coalesce(parsed["replayed"].cast("long"), F.lit(0).cast("long")).alias("replayed"),
        F.coalesce(parsed["limited"], F.lit(False)).alias("limited"),
        parsed["last_event_id"].cast("long").alias("last_event_id"),
    )


def event_frames(items: DataFrame) -> DataFrame:
    """Items as events: id, kind and JSON payload, metadata only."""
    fields = [
        rfc3339(F.col("inserted_at"), "Z").alias("inserted_at") if c == "inserted_at" else F.col(c)
        for c in ITEM_COLUMNS
    ]
    return items.select("id", F.lit("feed_item").alias("event"), F.to_json(F.struct(*fields)).alias("data"))


def items_from_frames(frames: DataFrame) -> DataFrame:
    """Inverse of :func:`event_frames`."""
    payload = "id BIGINT, feed_id BIGINT, external_id STRING, title STRING, url STRING, inserted_at STRING"
    return (
        frames.filter("event = 'feed_item'")
        .select(F.from_json("data", payload).alias("i"))
        .select("i.*")
        .withColumn("inserted_at", F.to_timestamp("inserted_at"))
    )


def replay_session(
    stored: DataFrame, live: DataFrame, cursor: int | Column, limit: int = REPLAY_LIMIT
) -> DataFrame:
    """One consumer's stream: replayed items, the marker, then live items.

    ``phase`` orders the three parts, ``id`` the events within one.
    """
    missed = items_after(stored, cursor, limit)
    start = cursor if isinstance(cursor, Column) else F.lit(cursor).cast("long")
    marker = marker_data(
        missed.agg(
            F.count(F.lit(1)).alias("replayed"),
            F.coalesce(F.bool_or("skipped_older"), F.lit(False)).alias("limited"),
            F.coalesce(F.max("id"), start).alias("last_event_id"),
        )
    )
    parts = [
        event_frames(missed).select(F.lit(0).alias("phase"), "id", "event", "data"),
        marker.select(
            F.lit(1).alias("phase"), F.lit(None).cast("long").alias("id"), F.lit("replay_done").alias("event"), "data"
        ),
        event_frames(live).select(F.lit(2).alias("phase"), "id", "event", "data"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def consumer_lag(
    consumers: DataFrame, items: DataFrame, buffer: int = CATCH_UP_LIMIT, block: int = ID_BLOCK
) -> DataFrame:
    """Per consumer: items after its cursor, and how many exceed the buffer.

    Counting pairs would grow with consumers times items.  Instead ids are cut
    into blocks: whole blocks above a cursor come from the per-block counts,
    and only the cursor's own block is ranked, at most ``block`` ids per task.
    """

    cursors = consumers.filter("cursor is not null").select("cursor").distinct()
    lowest = cursors.agg(F.min("cursor")).scalar()
    ids = items.select("id").filter(F.col("id") > lowest)
    marked = (
        ids.select(F.col("id").alias("at"), F.lit(1).alias("is_item"))
        .unionByName(cursors.select(F.col("cursor").alias("at"), F.lit(0).alias("is_item")))
        .withColumn("block", block_of(F.col("at"), block))
    )
    # Ranges are inclusive of ties: an item with the cursor's own id counts on
    # both sides of it and is taken off again.
    above = Window.partitionBy("block").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("block", "at")
    inside = marked.select(
        "block",
        "at",
        "is_item",
        (F.sum("is_item").over(above) - F.sum("is_item").over(same)).alias("newer"),
    )
    sizes = marked.groupBy("block").agg(F.sum("is_item").alias("n"))
    totals = totals_before(sizes, "block", "n", block, descending=True)
    behind = (
        inside.filter("is_item = 0")
        .join(totals, "block")
        .select(F.col("at").alias("cursor"), (F.col("newer") + F.col("before")).alias("behind"))
    )
    dropped = F.greatest(F.col("behind") - buffer, F.lit(0).cast("long"))
    return consumers.join(behind, "cursor").select("consumer_id", "cursor", "behind", dropped.alias("dropped"))
