"""Small hand-made tables."""

from __future__ import annotations

from conftest import at
from feedlake import schemas

DAY = "2024-01-01T"


def feeds(spark, *rows):
    """Rows ``(id, changes)`` over a plain feed."""
    base = {
        "title": None, "site_url": None, "etag": None, "last_modified": None, "poll_interval_seconds": 300,
        "is_enabled": True, "last_checked_at": None, "last_success_at": None, "last_inserted_at": None,
        "failure_count": 0,
    }
    data = []
    for number, changes in rows:
        row = {"id": number, "url": f"https://f.example/{number}"} | base | changes
        data.append(tuple(row[c] for c in schemas.FEED_COLUMNS))
    return spark.createDataFrame(data, schemas.FEEDS)


def items(spark, *rows):
    """Rows ``(id, feed_id, title, time)``."""
    data = [(i, f, f"e{i}", t, f"https://f.example/i{i}", at(DAY + s) if len(s) < 12 else at(s)) for i, f, t, s in rows]
    return spark.createDataFrame(data, schemas.ITEMS)


def details(spark, *rows):
    """Rows ``(item id, summary, content, published)``."""
    return spark.createDataFrame([(i, i, s, c, "", at(p)) for i, s, c, p in rows], schemas.DETAILS)


def queue(spark, *rows):
    """Rows ``(feed_id, due, expires, token, attempts)``."""
    data = [(f, at(d), at(e) if e else None, at(e) if e else None, t, a, at(d)) for f, d, e, t, a in rows]
    return spark.createDataFrame(data, schemas.QUEUE)


def entries(spark, *rows):
    """Rows ``(feed_id, seq, external_id, changes)``."""
    data = []
    for f, seq, e, changes in rows:
        row = {
            "feed_id": f, "seq": seq, "external_id": e, "title": f"t{seq}", "url": "u", "summary": "s",
            "content": "c", "author": "a", "published_at": at("2024-01-01T00:00:00"),
        } | changes
        data.append(tuple(row[c] for c in schemas.ENTRIES.fieldNames()))
    return spark.createDataFrame(data, schemas.ENTRIES)


def outcomes(spark, *rows):
    """Rows ``(feed_id, seq, token, checked, outcome, changes)``."""
    data = []
    for f, seq, token, checked, outcome, changes in rows:
        row = {
            "feed_id": f, "seq": seq, "lease_token": token, "checked_at": at(checked), "outcome": outcome,
            "title": None, "site_url": None, "etag": None, "last_modified": None,
        } | changes
        data.append(tuple(row[c] for c in schemas.OUTCOMES.fieldNames()))
    return spark.createDataFrame(data, schemas.OUTCOMES)


def dicts(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
