"""Streaming ingest: entries or raw bodies into the table store.

Deduplication knows the whole history of the store, so it has no horizon; it
reads only the key buckets whose filters may hold a key of the batch.
A micro-batch writes only its own ``batch_id`` folders and reads the store as
it was before, so running it twice gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators import ingest
from feedlake.schemas import ENTRIES
from feedlake.session import settled
from feedlake.sources.feed_xml import read_entries
from feedlake.sources.tables import TableStore

#: Batches between two compactions of the key runs.
COMPACT_EVERY = 32


def with_seq(entries: DataFrame) -> DataFrame:
    """Arrival order inside a micro-batch: body, then position in it.

    ``body_seq`` is the unique long of the body, ``pos`` the entry's place.  The
    longest body of the batch sets how far apart bodies are, so no two entries
    share a number however many a body holds.
    """
    width = entries.agg(F.coalesce(F.max("pos"), F.lit(0)).cast("long") + 1).head()[0]
    return entries.withColumn("seq", F.col("body_seq") * F.lit(width).cast("long") + F.col("pos")).drop("body_seq", "pos")


def store_batch(entries: DataFrame, batch_id: int, store: TableStore) -> None:
    """Store what is new in ``entries`` (with ``seq``) as batch ``batch_id``.

    The numbered keys are written out first: item and detail rows then come
    from the same numbers, and a lost executor does not repeat the search.  The
    keys' own run is written last: a batch that failed before is repeated whole.
    """
    spark = store.spark
    keys = store.keys()
    # Read three times below; parsing bodies once is enough.
    entries = entries.persist()
    try:
        numbers = settled(ingest.number_new(entries, keys, batch_id), f"numbers-{batch_id}")
        started = spark.range(1).select(F.current_timestamp()).first()[0]
        store.append("feed_item_details", ingest.new_details(entries, numbers, started), batch_id)
        store.append("feed_items", ingest.new_items(entries, numbers, started), batch_id)
        keys.append(numbers, batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            # never the batch itself: it may be repeated
            keys.compacted(batch_id - 1)
    finally:
        entries.unpersist()


def ingest_entries(entries: DataFrame, store: TableStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stream of entries (``schemas.ENTRIES``) into the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch.select(*ENTRIES.fieldNames()), batch_id, store)

    return _start(entries, write, checkpoint, available_now)


def ingest_bodies(bodies: DataFrame, store: TableStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stream of raw bodies ``(feed_id, body_seq, body)`` into the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = read_entries(batch, F.current_timestamp()).persist()
        try:
            store_batch(with_seq(parsed).select(*ENTRIES.fieldNames()), batch_id, store)
        finally:
            parsed.unpersist()

    return _start(bodies, write, checkpoint, available_now)


def recent_duplicates_dropped(entries: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """Bounded-state alternative: copies further apart than ``horizon`` slip through."""
    return entries.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(ingest.KEY)


def _start(source: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


__all__ = ["ingest_bodies", "ingest_entries", "recent_duplicates_dropped", "store_batch", "with_seq"]
