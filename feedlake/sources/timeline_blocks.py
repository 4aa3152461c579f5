"""Newest ordering date per block of item ids: where a newest-first list has to look.

Every batch leaves one row per block of ids it brought: (block, newest).  A block's
newest date bounds the dates of all its items, so blocks are taken in that order,
and once ``limit`` items are known whose dates the remaining blocks do not reach,
these need not be read.  The list is exact for any distribution of dates; dates that
rise with the ids, as usual for feeds, only make it short.

The bound must not be too low: after a detail's date has changed, ``add`` the item
and its detail again as another batch.  Deleted items leave it too high, which costs
reading and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.times import effective_date
from feedlake.session import settled
from feedlake.sources.tables import complete_batches

#: Ids of a block.  Fixed for a store.
BLOCK_IDS = 4096
#: By how much the blocks looked at grow while too few items are found in them.
GROWTH = 4


def block_of(item_id: Column, block_ids: int) -> Column:
    return F.floor(item_id / F.lit(block_ids)).cast("long")


class TimelineBlocks:
    """Block rows of all batches below one folder."""

    def __init__(self, spark: SparkSession, root: str, block_ids: int = BLOCK_IDS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.block_ids = block_ids

    def add(self, items: DataFrame, details: DataFrame, batch: int = 0) -> None:
        """Note a batch's items; repeating a batch replaces its rows."""
        dates = items.select("id", "inserted_at").join(details.select(F.col("feed_item_id").alias("id"), "published_at"), "id", "left")
        newest = F.max(effective_date(F.col("published_at"), F.col("inserted_at")).cast("timestamp"))
        rows = dates.groupBy(block_of(F.col("id"), self.block_ids).alias("block")).agg(newest.alias("newest"))
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def blocks(self) -> DataFrame:
        """(block, newest) over all complete batches."""
        schema = "block long, newest timestamp"
        folders = [f"{self.root}/batch={b}" for b in complete_batches(self.spark, self.root, "batch")]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).groupBy("block").agg(F.max("newest").alias("newest"))

    def only(self, rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
        """Rows whose id lies in one of the blocks.  The outer bounds are stated as
        well, so that files and row groups beyond them are skipped."""
        low, high = blocks.agg(F.min("block"), F.max("block")).first()
        if low is None:
            return rows.limit(0)
        between = (F.col(key) >= low * self.block_ids) & (F.col(key) < (high + 1) * self.block_ids)
        at = block_of(F.col(key), self.block_ids)
        return rows.filter(between).withColumn("_block", at).join(blocks.select(F.col("block").alias("_block")), "_block", "left_semi").drop("_block")

    def newest(
        self, items: DataFrame, details: DataFrame, rank: Callable[[DataFrame, DataFrame], DataFrame], limit: int
    ) -> tuple[DataFrame, DataFrame]:
        """The items and details among which are the newest ``limit`` that ``rank``,
        rows (id, effective_at) of the items it keeps, lets through.

        Blocks are looked at from the newest on, some more of them each time, until
        they hold ``limit`` kept items; the last of these dates is the bar.  Blocks
        that do not reach it are out.  The rounds grow with the logarithm of the
        number of blocks, also where a filter leaves few items or none.
        """
        every = settled(self.blocks(), "timeline-blocks")
        total = every.count()
        take = 1 + -(-limit // self.block_ids)
        while take < total:
            top = every.orderBy(F.desc("newest"), F.desc("block")).limit(take)
            found = rank(self.only(items, "id", top), self.only(details, "feed_item_id", top))
            best = found.orderBy(F.desc("effective_at"), F.desc("id")).limit(limit)
            n, bar = best.agg(F.count(F.lit(1)), F.min(F.col("effective_at").cast("timestamp"))).first()
            if n >= limit:
                # equal dates are decided by id, so a block that only reaches the bar stays
                reach = every.filter(F.col("newest") >= F.lit(bar)) if bar is not None else every
                return self.only(items, "id", reach), self.only(details, "feed_item_id", reach)
            take *= GROWTH
        return items, details


__all__ = ["TimelineBlocks"]
