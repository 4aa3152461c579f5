"""Updates and deletes as whole-table transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_rows(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace ``columns`` where ``updates`` has the key; the rest stays.

    ``updates`` holds at most one row per key.
    """
    new = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    chosen = [
        F.when(F.col("_hit"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in table.columns
    ]
    return joined.select(*chosen)


def unknown_keys(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Requested keys that the table does not have; each is an error to report."""
    return requests.select(key).distinct().join(table.select(key), key, "left_anti")


def update_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    return update_rows(items, updates, "id", ["title", "url"])


def update_details(details: DataFrame, updates: DataFrame) -> DataFrame:
    return update_rows(details, updates, "feed_item_id", ["summary", "content", "author", "published_at"])


def delete_items(items: DataFrame, details: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items without ``ids(id)``, and details without those of the deleted items."""
    gone = ids.select("id")
    return (
        items.join(gone, "id", "left_anti"),
        details.join(gone.withColumnRenamed("id", "feed_item_id"), "feed_item_id", "left_anti"),
    )


def delete_details(details: DataFrame, item_ids: DataFrame) -> DataFrame:
    gone = item_ids.select(F.col("id").alias("feed_item_id"))
    return details.join(gone, "feed_item_id", "left_anti")


def delete_feeds(
    feeds: DataFrame, items: DataFrame, details: DataFrame, queue: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """All four tables after deleting feeds ``ids(id)`` and all that hangs on them.

    Only ids of the deleted items travel to the details, never their text.
    """
    gone = ids.select(F.col("id").alias("feed_id")).distinct()
    gone_items = items.select("id", "feed_id").join(gone, "feed_id", "left_semi").select("id")
    return {
        "feeds": feeds.join(gone.withColumnRenamed("feed_id", "id"), "id", "left_anti"),
        "feed_items": items.join(gone, "feed_id", "left_anti"),
        "feed_item_details": delete_details(details, gone_items),
        "feed_update_queue": queue.join(gone, "feed_id", "left_anti"),
    }
