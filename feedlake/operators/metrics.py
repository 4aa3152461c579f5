"""Reports over service logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 90, 99)


def log_metrics(logs: DataFrame, labels: list[str]) -> DataFrame:
    """Count, sum and exact percentiles of ``duration_ms`` per label set.

    Durations are whole milliseconds, so they are counted per value first, on
    the map side; the running totals below see one row per distinct duration
    of a label set, not one per request.
    """
    counts = logs.groupBy(*labels, "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*labels)
    running = counts.select(
        *labels,
        "duration_ms",
        "n",
        F.sum("n").over(group.orderBy("duration_ms")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    percentiles = [
        F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("duration_ms"))).alias(f"p{p}_ms")
        for p in PERCENTILES
    ]
    return running.groupBy(*labels).agg(
        F.max("total").alias("requests"),
        F.sum(F.col("duration_ms") * F.col("n")).alias("total_ms"),
        *percentiles,
    )
