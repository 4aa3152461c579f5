"""Helpers the operators share: tables, settled frames, tokens, components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import new_folder, settled

__all__ = ["arrow_rows", "ascii_lower", "checked", "components", "discard", "forget_shuffles", "hand_back", "new_folder", "partitions_for", "settled", "settled_at", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one Arrow batch of whole texts; a batch of the longest known texts
#: (about 150 KB) then stays below 100 MB.
TEXT_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bound the Arrow batches that carry texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text):
    """A-Z lower-cased, every other character as it is; null stays null."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hand_back() -> None:
    """In a Python worker at the end of a task: return memory that is free but
    still held, so that workers kept for the next stage start small."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library keeps its own books


def partitions_for(spark: SparkSession, total: int, each: int) -> int:
    """As many partitions as ``total`` units need at ``each`` units per
    partition, and never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def checked(df: DataFrame, most: int) -> DataFrame:
    """``df`` (settled), with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder this job wrote below the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of frames that nothing refers to any more,
    neither here nor in the JVM."""
    gc.collect()
    spark._jvm.System.gc()


def settled_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A settled frame and its folder, for one that is discarded later."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (src, dst): rows (node, component),
    the component being its smallest node; nodes without an edge do not occur.

    Alternating stars: large-star links every larger neighbour of a node to the
    node's smallest neighbour, small-star every smaller one.  Both are a min per
    node (combined before the shuffle) and a join back, so a node that a third
    of all edges share is never gathered in one place; AQE splits its join.
    The edges of each round are written to the shared folder, and the ones
    before them deleted.  ``rounds`` only guards against an endless loop; the
    number needed grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    pairs = (
        edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    now, path = settled_at(pairs, name)
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        large, large_path = settled_at(large, name)
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        small = small.select("a", F.col("m").alias("b")).unionAll(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        after, after_path = settled_at(small.distinct(), name)
        stars = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        same = stars and after.groupBy("a").count().filter("count > 1").isEmpty()
        discard(spark, path)
        discard(spark, large_path)
        now, path = after, after_path
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
