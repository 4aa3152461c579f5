"""Even work: joins with hot keys, and inputs too small to be split by the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that share one hot key.
SPREAD = 32


def spread_join(
    rows: DataFrame, per_key: DataFrame, key: str, by: str, how: str = "inner", spread: int = SPREAD
) -> DataFrame:
    """Join many rows to a table with one row per key.

    Rows of a key are spread over ``spread`` tasks by the hash of ``by``, and
    the one-row side is copied that often.  Runtime skew handling would not do
    where an aggregation by the same key follows, as it keeps the partitioning.
    """
    salted = rows.withColumn("_salt", F.pmod(F.hash(by), F.lit(spread)))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


#: Estimated size up to which a table is read or dealt out whole without a thought.
SMALL_BYTES = 256 << 20


def is_small(table: DataFrame) -> bool:
    """Is the optimizer's size estimate of a table small?"""
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= SMALL_BYTES


def spread_small(rows: DataFrame, key: str) -> DataFrame:
    """Deal a small input out to all cores by a unique key.

    A file of one row group is read by one task however many cores there are.
    Where the row work is costly (tokenising texts) moving a small input first
    pays off.  Anything larger is left as scanned: its many splits keep all
    cores busy, and its texts are not shuffled.
    """
    if rows.isStreaming or not is_small(rows):
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)
