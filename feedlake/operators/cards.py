"""Item cards as a reader shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.links import host
from feedlake.functions.text import feed_label, preview_text, truncate
from feedlake.functions.times import age_label, effective_date
from feedlake.operators.skew import spread_small


def item_cards(rows: DataFrame, now: Column) -> DataFrame:
    """Host, age and preview of items with details."""
    date = effective_date(F.col("published_at"), F.col("inserted_at"))
    return spread_small(rows, "id").select(
        "id",
        "title",
        host(F.col("url")).alias("host"),
        age_label(date, now).alias("age"),
        truncate(preview_text(F.col("summary"), F.col("content"))).alias("preview"),
    )


def with_feed_labels(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Timeline rows, newest first, with the short label of their feed."""
    labels = feeds.select(
        F.col("id").alias("feed_id"), feed_label(F.col("title"), F.col("url")).alias("feed_label")
    )
    date = effective_date(F.col("published_at"), F.col("inserted_at"))
    return rows.join(labels, "feed_id", "left").orderBy(date.desc(), F.desc("id"))
