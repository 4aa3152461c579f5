"""Streams that keep a small table up to date: timeline and poll state.

Each micro-batch merges into the previous snapshot with the batch operators
and writes the next one into its own folder, so a repeated batch starts from
the same snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators.items import TIMELINE_LIMIT, upsert_newest
from feedlake.operators.polling import poll_state
from feedlake.sources.tables import complete_batches, exists


class Snapshots:
    """One folder per micro-batch below ``root``; a batch reads the one before."""

    def __init__(self, spark: SparkSession, root: str, empty: DataFrame):
        self.spark = spark
        self.root = root.rstrip("/")
        self.empty = empty

    def path(self, batch_id: int) -> str:
        return f"{self.root}/batch={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """State a batch starts from.  Batch ids of a stream have no gaps, so a
        missing snapshot is an error: starting anew would lose the state."""
        if batch_id == 0:
            return self.empty
        if not exists(self.spark, f"{self.path(batch_id - 1)}/_SUCCESS"):
            raise FileNotFoundError(f"no complete snapshot {self.path(batch_id - 1)}; batch {batch_id} builds on it")
        return self.spark.read.schema(self.empty.schema).parquet(self.path(batch_id - 1))

    def latest(self) -> DataFrame:
        batches = complete_batches(self.spark, self.root, "batch")
        return self.before(max(batches) + 1) if batches else self.empty


def _merge_stream(
    source: DataFrame,
    snapshots: Snapshots,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    available_now: bool,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        state = merge(snapshots.before(batch_id), batch)
        state.select(*snapshots.empty.columns).write.mode("overwrite").parquet(snapshots.path(batch_id))

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def timeline_stream(
    items: DataFrame,
    snapshots: Snapshots,
    checkpoint: str,
    limit: int = TIMELINE_LIMIT,
    available_now: bool = False,
    order: str | None = None,
) -> StreamingQuery:
    """Newest items, fed by an at-least-once stream: redelivery changes nothing.
    Inside a micro-batch the last version by ``order`` wins."""

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert_newest(current, batch, limit, order)

    return _merge_stream(items, snapshots, merge, checkpoint, available_now)


def poll_state_stream(
    outcomes: DataFrame, snapshots: Snapshots, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Poll state per feed; outcomes of later micro-batches are later outcomes."""
    return _merge_stream(outcomes, snapshots, lambda state, batch: poll_state(batch, state), checkpoint, available_now)


__all__ = ["Snapshots", "poll_state_stream", "timeline_stream"]
