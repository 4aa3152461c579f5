"""Sliding word counts over a stream of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators.titles import words_sliding


def words_stream(
    items: DataFrame,
    out: str,
    checkpoint: str,
    length: str = "24 hours",
    slide: str = "1 hour",
    lateness: str = "1 hour",
    available_now: bool = False,
) -> StreamingQuery:
    """Word counts of each closed window, appended once as Parquet.

    A window closes when the watermark, the newest insertion time less
    ``lateness``, has passed its end.
    """
    counts = words_sliding(items.withWatermark("inserted_at", lateness), length, slide)
    writer = counts.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(out)
