"""Fixed table schemas.  Timestamps are UTC instants."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, TEXT, FLAG, TIME = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType()


def _table(required: dict[str, T.DataType], optional: dict[str, T.DataType], order: str) -> T.StructType:
    kinds = required | optional
    return T.StructType([T.StructField(c, kinds[c], c in optional) for c in order.split()])


FEEDS = _table(
    {"id": LONG, "url": TEXT, "poll_interval_seconds": LONG, "is_enabled": FLAG, "failure_count": LONG},
    {"title": TEXT, "site_url": TEXT, "etag": TEXT, "last_modified": TEXT}
    | {"last_checked_at": TIME, "last_success_at": TIME, "last_inserted_at": TIME},
    "id url title site_url etag last_modified poll_interval_seconds is_enabled "
    "last_checked_at last_success_at last_inserted_at failure_count",
)

ITEMS = _table(
    {"id": LONG, "feed_id": LONG, "external_id": TEXT, "title": TEXT, "url": TEXT, "inserted_at": TIME},
    {},
    "id feed_id external_id title url inserted_at",
)

DETAILS = _table(
    {"id": LONG, "feed_item_id": LONG, "summary": TEXT, "content": TEXT, "author": TEXT, "published_at": TIME},
    {},
    "id feed_item_id summary content author published_at",
)

QUEUE = _table(
    {"feed_id": LONG, "due_at": TIME, "attempts": LONG, "updated_at": TIME},
    {"leased_at": TIME, "lease_expires_at": TIME, "lease_token": TEXT},
    "feed_id due_at leased_at lease_expires_at lease_token attempts updated_at",
)

#: One parsed entry of one fetch.  ``seq`` is the arrival order, unique per entry.
ENTRIES = _table(
    {"feed_id": LONG, "seq": LONG, "external_id": TEXT, "title": TEXT, "url": TEXT},
    {"summary": TEXT, "content": TEXT, "author": TEXT, "published_at": TIME},
    "feed_id seq external_id title url summary content author published_at",
)

#: One finished poll.  ``outcome`` is fetched, not_modified or failed.
OUTCOMES = _table(
    {"feed_id": LONG, "seq": LONG, "lease_token": TEXT, "checked_at": TIME, "outcome": TEXT},
    {"title": TEXT, "site_url": TEXT, "etag": TEXT, "last_modified": TEXT},
    "feed_id seq lease_token checked_at outcome title site_url etag last_modified",
)

#: One line of a service log.
LOGS = _table(
    {},
    {"timestamp": TEXT, "level": TEXT, "method": TEXT, "route": TEXT, "outcome": TEXT, "duration_ms": LONG},
    "timestamp level method route outcome duration_ms",
)

ITEM_COLUMNS = ITEMS.fieldNames()
DETAIL_COLUMNS = ["summary", "content", "author", "published_at"]
FEED_COLUMNS = FEEDS.fieldNames()
QUEUE_COLUMNS = QUEUE.fieldNames()

DEFAULT_POLL_INTERVAL_SECONDS = 300
