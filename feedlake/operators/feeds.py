"""Feed lists, reports and changes to the feed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import times
from feedlake.functions.links import full_host, source_id, with_root_path
from feedlake.functions.text import feed_name, trimmed
from feedlake.operators.keys import assign_ids, max_id
from feedlake.schemas import DEFAULT_POLL_INTERVAL_SECONDS, FEED_COLUMNS, FEEDS

# Feeds every new store starts with.
DEFAULT_FEED_URLS = [
    "https://www.nrk.no/nyheter/siste.rss",
    "https://rss.kode24.no/",
    "https://www.adressa.no/rss",
    "https://www.tek.no/api/rss/rss2/medium/collections",
    "https://blog.rust-lang.org/feed.xml",
    "https://blog.rust-lang.org/inside-rust/feed.xml",
    "https://this-week-in-rust.org/rss.xml",
    "https://planet.rust-lang.org/rss20.xml",
    "https://hnrss.org/frontpage",
    "https://github.blog/feed/",
    "https://feeds.zencastr.com/f/oSn1i316.rss",
    "https://letscast.fm/podcasts/rust-in-production-82281512/feed",
    "https://feeds.simplecast.com/7y1CbAbN",
    "https://e24.no/rss2/",
    "https://www.jeffgeerling.com/blog.xml",
    "https://services.dn.no/api/feed/rss/",
    "https://www.tv2.no/rss/nyheter",
    "https://softskills.audio/feed.xml",
]


def feeds_list(feeds: DataFrame) -> DataFrame:
    return feeds.select(*FEED_COLUMNS).orderBy("id")


def feeds_newest(feeds: DataFrame) -> DataFrame:
    return feeds.select(*FEED_COLUMNS).orderBy(F.desc("id"))


def feed_by_id(feeds: DataFrame, feed_id: int) -> DataFrame:
    """One feed; no row means it does not exist."""
    return feeds.filter(F.col("id") == feed_id).select(*FEED_COLUMNS)


def _name() -> Column:
    return feed_name(F.col("title"), F.col("site_url"), F.col("url"))


def feeds_by_name(feeds: DataFrame) -> DataFrame:
    """Ids and display names in dictionary order rather than byte order."""
    return feeds.select("id", _name().alias("name")).orderBy(F.collate("name", "UNICODE"), "id")


def fetchable_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter("is_enabled").select("id")


def source_report(feeds: DataFrame) -> DataFrame:
    """What a source list shows: name, host, interval, dates, failures."""

    def label(column: str) -> Column:
        return times.date_label(F.col(column).cast("string")).alias(column)

    return feeds.select(
        "id",
        _name().alias("name"),
        full_host(with_root_path(F.col("url"))).alias("host"),
        times.interval_label(F.col("poll_interval_seconds")).alias("poll_interval"),
        label("last_checked_at"),
        label("last_success_at"),
        label("last_inserted_at"),
        "is_enabled",
        "failure_count",
    )


def link_source_id(links: DataFrame, url: str = "url") -> DataFrame:
    return links.withColumn("source_id", source_id(F.col(url)))


def upsert_feeds(requests: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds after adding urls; a known url leaves its row as it is.

    ``requests`` has ``url`` and a unique long ``seq``; ids follow the first
    request of each url.  Blank urls are ignored, others trimmed.
    """
    wanted = (
        requests.select(trimmed(F.col("url")).alias("url"), "seq")
        .filter(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.min("seq").alias("seq"))
    )
    fresh = wanted.join(feeds.select("url"), "url", "left_anti")
    numbered = assign_ids(fresh, "seq", max_id(feeds))
    defaults = {
        "poll_interval_seconds": F.lit(DEFAULT_POLL_INTERVAL_SECONDS).cast("long"),
        "is_enabled": F.lit(True),
        "failure_count": F.lit(0).cast("long"),
    }

    def column(name: str) -> Column:
        if name in ("id", "url"):
            return F.col(name)
        kind = feeds.schema[name].dataType if name in feeds.columns else FEEDS[name].dataType
        return defaults.get(name, F.lit(None)).cast(kind).alias(name)

    added = numbered.select(*[column(name) for name in FEED_COLUMNS])
    return feeds.select(*FEED_COLUMNS).unionByName(added)


def seed_default_feeds(feeds: DataFrame) -> DataFrame:
    """Add the starter feeds that are not there yet; safe to repeat."""
    seeds = feeds.sparkSession.createDataFrame(list(enumerate(DEFAULT_FEED_URLS)), "seq long, url string")
    return upsert_feeds(seeds, feeds)


def set_enabled(feeds: DataFrame, flags: DataFrame) -> DataFrame:
    """Apply ``flags(id, is_enabled)`` to the feed table."""
    change = flags.select("id", F.col("is_enabled").alias("wanted"))
    switched = F.coalesce("wanted", "is_enabled").alias("is_enabled")
    columns = [switched if c == "is_enabled" else F.col(c) for c in FEED_COLUMNS]
    return feeds.join(change, "id", "left").select(*columns)


def wake_enabled(queue: DataFrame, flags: DataFrame, now: Column) -> DataFrame:
    """Queue after the same change: a feed that was enabled is due at once."""
    woken = flags.filter("is_enabled").select(F.col("id").alias("feed_id"), F.lit(True).alias("woken"))
    joined = queue.join(woken, "feed_id", "left")

    def column(name: str) -> Column:
        if name == "due_at":
            return F.when(F.col("woken"), F.least("due_at", now)).otherwise(F.col("due_at")).alias(name)
        if name == "updated_at":
            return F.when(F.col("woken"), now).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[column(name) for name in queue.columns])
