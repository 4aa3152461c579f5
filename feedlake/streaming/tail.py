"""Live tail: every stored item becomes one event.

The stream's checkpoint takes the place of a cursor: an item is delivered
however late its file appears, also when its id is below ones already seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators.replay import event_frames


def live_tail(items: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write event frames of a streaming item table as Parquet, each once."""
    writer = event_frames(items).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(out)
