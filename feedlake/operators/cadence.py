"""Publishing cadence of every feed in one pass, and the poll plan it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import scores
from feedlake.functions.times import add_seconds, micros

_GAP_MICROS = scores.MIN_CADENCE_GAP_SECONDS * 1_000_000


def gaps(stamps: DataFrame) -> DataFrame:
    """Seconds between neighbouring timestamps of a feed, long gaps only.

    Input columns ``feed_id`` and ``ts``.  Timestamps inside one aligned
    minute are closer than the shortest gap that counts, so a minute matters
    only through its first and last timestamp.  That reduction runs on the map
    side and leaves at most one row per feed and minute, whatever share of all
    rows a single feed holds; the window below sorts only what is left.
    """
    at = micros(F.col("ts"))
    minutes = (
        stamps.select("feed_id", at.alias("at"))
        .filter(F.col("at").isNotNull())
        .groupBy("feed_id", (F.col("at") - F.pmod("at", F.lit(_GAP_MICROS).cast("long"))).alias("minute"))
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    )
    previous = F.lag("last_at").over(Window.partitionBy("feed_id").orderBy("minute"))
    gap = F.col("first_at") - previous
    return (
        minutes.select("feed_id", gap.alias("gap"))
        .filter(F.col("gap") >= _GAP_MICROS)
        .select("feed_id", (F.col("gap") / F.lit(1e6)).alias("gap_seconds"))
    )


def low_median(stamps: DataFrame, median: str, samples: str) -> DataFrame:
    """Median gap per feed: mean of the ranks n/2 and n/2 + 1, n/2 rounded down.

    For an odd number of samples that leans to the lower neighbour of the
    middle one; a single sample stands for itself.
    """
    per_feed = Window.partitionBy("feed_id")
    ranked = gaps(stamps).select(
        "feed_id",
        "gap_seconds",
        F.row_number().over(per_feed.orderBy("gap_seconds")).alias("rank"),
        F.count(F.lit(1)).over(per_feed).alias("n"),
    )
    half = F.floor(F.col("n") / 2)
    middle = F.when((F.col("rank") == half) | (F.col("rank") == half + 1), F.col("gap_seconds"))
    return ranked.groupBy("feed_id").agg(F.avg(middle).alias(median), F.max("n").alias(samples))


def cadence(items: DataFrame, details: DataFrame, feeds: DataFrame) -> DataFrame:
    """Cadence of every feed from publishing gaps, else from insertion gaps."""
    inserted = items.select("feed_id", F.col("inserted_at").alias("ts"))
    published = items.select("id", "feed_id").join(
        details.select(F.col("feed_item_id").alias("id"), F.col("published_at").alias("ts")), "id"
    )
    stats = (
        feeds.select(F.col("id").alias("feed_id"))
        .join(low_median(inserted, "median_inserted", "inserted_samples"), "feed_id", "left")
        .join(low_median(published, "median_published", "published_samples"), "feed_id", "left")
    )
    return with_choice(stats)


def with_choice(medians: DataFrame) -> DataFrame:
    """Medians and sample counts of both kinds, and the cadence they give."""
    chosen = scores.cadence_choice(
        F.col("median_published"), F.col("published_samples"), F.col("median_inserted"), F.col("inserted_samples")
    )
    return medians.fillna(0, ["inserted_samples", "published_samples"]).withColumn("cadence_seconds", chosen)


def poll_intervals(cadences: DataFrame) -> DataFrame:
    return cadences.select(
        "feed_id", scores.resolved_interval(F.col("cadence_seconds")).alias("poll_interval_seconds")
    )


def poll_backoff(feeds: DataFrame) -> DataFrame:
    return feeds.select(
        F.col("id").alias("feed_id"),
        scores.backoff_interval(F.col("poll_interval_seconds")).alias("poll_interval_seconds"),
    )


def queue_backfill(feeds: DataFrame, now: Column) -> DataFrame:
    """First queue row of every feed: due now, or one interval after its last success."""
    later = add_seconds(F.col("last_success_at"), F.col("poll_interval_seconds"))
    return feeds.select(F.col("id").alias("feed_id"), F.coalesce(later, now).alias("due_at"))
