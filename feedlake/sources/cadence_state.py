"""Cadence of feeds that is kept up to date batch by batch.

Gaps between a feed's timestamps are counted per day.  A batch leaves two tables:

* ``marks``: first and last timestamp of every feed, kind and minute it brought,
* ``days``: for every (feed, kind, day) it touched, the day as it is now: first and
  last timestamp, and the multiset of the gaps inside the day (gap, how often).

Days are mergeable: gaps between days follow from their edges, so the median of a
feed needs its day rows only, never its items.  A batch reads the marks of the days
it touches, all others stay as they are.  Both tables lie in folders by batch and
bucket of the feed, so other feeds' buckets are not read.  A day has at most 1,440
minutes; nothing larger is ever sorted together, whatever share of all rows one
feed has, until the few distinct gaps of a feed are ranked.

``days`` are written last: a batch that failed before is not there, and one that is
repeated replaces its own folders.  Batches come in ascending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions import scores
from feedlake.functions.times import micros
from feedlake.operators.cadence import with_choice
from feedlake.sources.tables import complete_batches

MINUTE = scores.MIN_CADENCE_GAP_SECONDS * 1_000_000
DAY = 86_400 * 1_000_000
BUCKETS = 64
INSERTED, PUBLISHED = "inserted", "published"

DAY_KEY = ["feed_id", "kind", "day"]
MARKS = "feed_id long, kind string, day long, minute long, first_at long, last_at long"
DAYS = "feed_id long, kind string, day long, first_at long, last_at long, gaps array<struct<gap: long, n: long>>"
PLACE = "batch long, bucket int"


def bucket_of(feed_id: Column) -> Column:
    return F.pmod(F.xxhash64(feed_id), F.lit(BUCKETS)).cast("int")


def _floor(at: Column, unit: int) -> Column:
    return at - F.pmod(at, F.lit(unit).cast("long"))


def marks_of(items: DataFrame, details: DataFrame) -> DataFrame:
    """Minutes of items and of their details, combined on the map side.  Items
    without a feed and rows without a date have none."""
    inserted = items.select("feed_id", F.lit(INSERTED).alias("kind"), micros(F.col("inserted_at")).alias("at"))
    dates = details.select(F.col("feed_item_id").alias("id"), micros(F.col("published_at")).alias("at"))
    published = items.select("id", "feed_id").join(dates, "id").select("feed_id", F.lit(PUBLISHED).alias("kind"), "at")
    stamps = inserted.unionByName(published).filter(F.col("feed_id").isNotNull() & F.col("at").isNotNull())
    minute = _floor(F.col("at"), MINUTE).alias("minute")
    marks = stamps.groupBy("feed_id", "kind", minute).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return marks.withColumn("day", _floor(F.col("minute"), DAY))


def days_of(marks: DataFrame) -> DataFrame:
    """Day rows from all marks of these days."""
    minutes = marks.groupBy(*DAY_KEY, "minute").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    before = F.lag("last_at").over(Window.partitionBy(*DAY_KEY).orderBy("minute"))
    gap = F.col("first_at") - before
    gaps = minutes.withColumn("gap", F.when(gap >= MINUTE, gap)).groupBy(*DAY_KEY, "gap").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    # rows without a gap count only for the edges of their day
    one = F.when(F.col("gap").isNotNull(), F.struct("gap", "n"))
    return gaps.groupBy(*DAY_KEY).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.collect_list(one).alias("gaps")
    )


def medians_of(days: DataFrame) -> DataFrame:
    """(feed_id, kind, median, samples): mean of the gaps of the ranks n/2 and n/2 + 1,
    n/2 rounded down, in seconds; a single gap stands for itself."""
    before = F.lag("last_at").over(Window.partitionBy("feed_id", "kind").orderBy("day"))
    between = days.select("feed_id", "kind", (F.col("first_at") - before).alias("gap"), F.lit(1).cast("long").alias("n"))
    inside = days.select("feed_id", "kind", F.explode("gaps").alias("g")).select("feed_id", "kind", "g.gap", "g.n")
    gaps = between.filter(F.col("gap") >= MINUTE).unionByName(inside)
    gaps = gaps.groupBy("feed_id", "kind", "gap").agg(F.sum("n").alias("n"))
    of_feed = Window.partitionBy("feed_id", "kind")
    ranked = gaps.select(
        "feed_id", "kind", "gap", "n", F.sum("n").over(of_feed.orderBy("gap")).alias("upto"), F.sum("n").over(of_feed).alias("samples")
    )

    def holds(rank: Column) -> Column:
        return ((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).cast("int")

    half = F.floor(F.col("samples") / 2)
    hits = holds(half) + holds(half + 1)
    middle = F.sum(F.col("gap") / F.lit(1e6) * hits) / F.sum(hits)
    return ranked.groupBy("feed_id", "kind").agg(middle.alias("median"), F.max("samples").alias("samples"))


class CadenceState:
    """Marks and days of all batches below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def batches(self, before_batch: int | None = None) -> list[int]:
        found = complete_batches(self.spark, f"{self.root}/days", "batch")
        return sorted(b for b in found if before_batch is None or b < before_batch)

    def _read(self, table: str, columns: str, buckets: list[int], before_batch: int | None) -> DataFrame:
        batches = self.batches(before_batch)
        schema = f"{columns}, {PLACE}"
        if not batches:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.root}/{table}/batch={b}" for b in batches]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders)
        return rows if len(buckets) == BUCKETS else rows.filter(F.col("bucket").isin(buckets))

    @staticmethod
    def _buckets(rows: DataFrame) -> list[int]:
        """At most ``BUCKETS`` numbers."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col("feed_id"))).distinct().collect())

    def days(self, buckets: list[int], before_batch: int | None = None) -> DataFrame:
        """Day rows of whole buckets, each as the last batch left it."""
        rows = self._read("days", DAYS, buckets, before_batch)
        body = F.struct("first_at", "last_at", "gaps")
        return rows.groupBy(*DAY_KEY).agg(F.max_by(body, "batch").alias("r")).select(*DAY_KEY, "r.*")

    def _touched(self, marks: DataFrame, before_batch: int | None) -> DataFrame:
        """The days that new marks touch, with what earlier batches know of them."""
        old = self._read("marks", MARKS, self._buckets(marks), before_batch)
        known = old.join(marks.select(*DAY_KEY).distinct(), DAY_KEY, "left_semi")
        return days_of(known.select(*marks.columns).unionByName(marks))

    def add(self, items: DataFrame, details: DataFrame, batch: int = 0) -> None:
        """Merge the items and details that a batch has stored.

        Batches come in order; the last one may be repeated.
        """
        if any(b > batch for b in self.batches()):
            raise ValueError(f"batch {batch} comes after later ones")
        columns = ["feed_id", "kind", "day", "minute", "first_at", "last_at"]
        path = f"{self.root}/marks/batch={batch}"
        marks = marks_of(items, details).select(*columns, bucket_of(F.col("feed_id")).alias("bucket"))
        marks.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        new = self.spark.read.schema(f"{MARKS}, bucket int").parquet(path).select(*columns)
        days = self._touched(new, batch).withColumn("bucket", bucket_of(F.col("feed_id")))
        days.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/days/batch={batch}")

    def cadence(
        self, feeds: DataFrame, items: DataFrame | None = None, details: DataFrame | None = None, before_batch: int | None = None
    ) -> DataFrame:
        """Cadence of ``feeds`` (id), as :func:`feedlake.operators.cadence.cadence` has it
        over all items.  ``items`` and ``details`` are a batch not yet added; it counts
        as if it were."""
        wanted = feeds.select(F.col("id").alias("feed_id"))
        keys = wanted.distinct()
        days = self.days(self._buckets(keys), before_batch).join(keys, "feed_id", "left_semi")
        if items is not None and details is not None:
            marks = marks_of(items.join(keys, "feed_id", "left_semi"), details)
            fresh = self._touched(marks, before_batch)
            days = days.join(fresh.select(*DAY_KEY), DAY_KEY, "left_anti").unionByName(fresh.select(*days.columns))
        medians = medians_of(days)

        def of(kind: str) -> DataFrame:
            return medians.filter(F.col("kind") == kind).select(
                "feed_id", F.col("median").alias(f"median_{kind}"), F.col("samples").alias(f"{kind}_samples")
            )

        return with_choice(wanted.join(of(INSERTED), "feed_id", "left").join(of(PUBLISHED), "feed_id", "left"))


__all__ = ["CadenceState"]
