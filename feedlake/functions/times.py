"""Time expressions.  They accept TIMESTAMP and TIMESTAMP_NTZ columns alike."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: Column | dt.datetime | None) -> Column:
    """An explicit point in time as a Column; None means the query's start."""
    if value is None:
        return F.current_timestamp()
    return value if isinstance(value, Column) else F.lit(value)


def effective_date(published_at: Column, inserted_at: Column) -> Column:
    """Ordering date: the published date, never later than the insertion."""
    return F.least(F.coalesce(published_at, inserted_at), inserted_at)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("long"), ts)


def fraction(ts: Column) -> Column:
    """Fractional second as RFC 3339 writers print it: none, 3 or 6 digits."""
    sub = F.pmod(micros(ts), F.lit(1_000_000))
    return (
        F.when(sub == 0, "")
        .when(sub % 1000 == 0, F.concat(F.lit("."), F.lpad((sub / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(sub.cast("string"), 6, "0")))
    )


def rfc3339(ts: Column, zone: str) -> Column:
    """``2024-01-01T00:00:07.179575`` followed by ``zone`` (Z or +00:00)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction(ts), F.lit(zone))


def published_date(published: Column, updated: Column) -> Column:
    return F.coalesce(published, updated)


def feed_date(text: Column) -> Column:
    """RSS (RFC 822, with or without weekday) and Atom (RFC 3339) dates."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9},\\s*", "")
    named = F.regexp_replace(bare, "\\b(UT|UTC|Z)$", "GMT")
    numeric = "[+-][0-9]{4}$"
    rfc822 = F.coalesce(
        F.when(named.rlike(numeric), F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss z")),
    )
    iso = F.rlike(text, F.lit("^\\s*[0-9]{4}-"))
    return F.when(iso, F.try_to_timestamp(F.trim(text))).otherwise(rfc822)


def age_label(ts: Column, now: Column) -> Column:
    """just now / 5m ago / 3h ago / 12d ago / date."""
    seconds = F.floor((micros(now) - micros(ts)) / F.lit(1_000_000))
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def date_label(text: Column) -> Column:
    """Never for a missing date, Unknown for an unreadable one, else the date."""
    parsed = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm")
    return F.when(text.isNull() | (text == ""), F.lit("Never")).otherwise(
        F.coalesce(parsed, F.lit("Unknown"))
    )


def interval_label(seconds: Column) -> Column:
    """45s, 5m, 1m 30s, 1h, 1h 1m; seconds are not shown once there are hours."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds % 3600 / 60)
    rest = seconds % 60

    def unit(value: Column, suffix: str) -> Column:
        return F.concat(value.cast("string"), F.lit(suffix))

    def joined(left: Column, right: Column) -> Column:
        return F.concat(left, F.lit(" "), right)

    return (
        F.when(seconds < 60, unit(seconds, "s"))
        .when((hours > 0) & (minutes > 0), joined(unit(hours, "h"), unit(minutes, "m")))
        .when(hours > 0, unit(hours, "h"))
        .when(rest == 0, unit(minutes, "m"))
        .otherwise(joined(unit(minutes, "m"), unit(rest, "s")))
    )
