"""Entries into items and details, each (feed, external id) once and for all."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.times import moment
from feedlake.operators.keys import assign_ids, max_id
from feedlake.sources.key_store import KEY, KeyStore


def accepted_keys(entries: DataFrame, store: DataFrame | KeyStore, before_batch: int | None = None) -> DataFrame:
    """(feed, external id, seq) of the entries that are new; the first one wins.

    Only keys take part: copies are reduced on the map side before the
    shuffle, then keys that the store holds fall out.  The store is asked for
    its whole history, so a copy is recognised however late it comes: a key
    store through its filters, so that the work follows the batch, a plain item
    table by joining all its keys.
    """
    first = entries.groupBy(*KEY).agg(F.min("seq").alias("seq"))
    if isinstance(store, KeyStore):
        return store.unknown(first, before_batch)
    return first.join(store.select(*KEY), KEY, "left_anti")


def number_new(entries: DataFrame, store: DataFrame | KeyStore, before_batch: int | None = None) -> DataFrame:
    """``(feed_id, external_id, seq, id)`` of new entries, ids continuing those of the store."""
    start = store.max_id(before_batch) if isinstance(store, KeyStore) else max_id(store)
    return assign_ids(accepted_keys(entries, store, before_batch), "seq", start)


def _numbered(entries: DataFrame, numbers: DataFrame) -> DataFrame:
    return entries.join(numbers.select("seq", "id"), "seq")


def new_items(
    entries: DataFrame, numbers: DataFrame, inserted_at: Column | dt.datetime | None = None
) -> DataFrame:
    """Item rows of the numbered entries; one batch shares one insertion time."""
    at = F.col("inserted_at") if inserted_at is None and "inserted_at" in entries.columns else moment(inserted_at)
    return _numbered(entries, numbers).select(
        "id", "feed_id", "external_id", "title", "url", at.alias("inserted_at")
    )


def new_details(
    entries: DataFrame, numbers: DataFrame, completed_at: Column | dt.datetime | None = None
) -> DataFrame:
    """Detail rows of the numbered entries that have any detail at all.

    The detail of an item takes the item's id as its own.
    """
    given = F.coalesce("summary", "content", "author", F.col("published_at").cast("string"))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("summary", "content", "author")]
    return (
        _numbered(entries.filter(given.isNotNull()), numbers)
        .select(
            "id",
            F.col("id").alias("feed_item_id"),
            *texts,
            F.coalesce("published_at", moment(completed_at)).alias("published_at"),
        )
    )


def insert_items(
    entries: DataFrame, store: DataFrame | KeyStore, inserted_at: Column | dt.datetime | None = None
) -> DataFrame:
    return new_items(entries, number_new(entries, store), inserted_at)


def insert_details(
    entries: DataFrame, store: DataFrame | KeyStore, completed_at: Column | dt.datetime | None = None
) -> DataFrame:
    return new_details(entries, number_new(entries, store), completed_at)


def ingest_summary(items: DataFrame) -> DataFrame:
    """Rows added per feed by one batch."""
    return items.groupBy("feed_id").agg(F.count(F.lit(1)).alias("inserted_items"))
