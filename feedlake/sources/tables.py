"""The four tables as Parquet folders, written so that a batch can be repeated.

Each ingest batch owns one ``batch_id`` folder per table and overwrites it
whole.  Running a batch again after a failure therefore leaves the same rows,
without a transactional table format.  Feeds and queue are snapshots, one
folder per batch; the latest complete one is current.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from feedlake import schemas

if TYPE_CHECKING:
    from feedlake.sources.cadence_state import CadenceState
    from feedlake.sources.key_store import KeyStore

APPENDED = {"feed_items": schemas.ITEMS, "feed_item_details": schemas.DETAILS}
SNAPSHOTS = {"feeds": schemas.FEEDS, "feed_update_queue": schemas.QUEUE}
BATCH = "batch_id"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _found(spark: SparkSession, pattern: str) -> list:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath() for f in found or []]


def folder_names(spark: SparkSession, pattern: str, label: str = "run") -> list[str]:
    """What follows ``label=`` in the folders of the files that a pattern names."""
    parents = {p.getParent().getName() for p in _found(spark, pattern)}
    return sorted(n.removeprefix(f"{label}=") for n in parents if n.startswith(f"{label}="))


def complete_batches(spark: SparkSession, folder: str, label: str) -> list[int]:
    """Numbers of the ``label=N`` folders whose write has finished."""
    return [int(n) for n in folder_names(spark, f"{folder}/{label}=*/_SUCCESS", label)]


class TableStore:
    """Reads and writes the tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _schema(self, table: str) -> StructType:
        return (APPENDED | SNAPSHOTS)[table]

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self._schema(table))

    def _batch_path(self, table: str, batch_id: int) -> str:
        return f"{self.path(table)}/{BATCH}={batch_id}"

    def read(self, table: str, before_batch: int | None = None) -> DataFrame:
        """An appended table, optionally only as it was before a batch."""
        columns = self._schema(table)
        if not exists(self.spark, self.path(table)):
            return self.empty(table)
        batched = StructType([*columns.fields]).add(BATCH, LongType())
        rows = self.spark.read.schema(batched).parquet(self.path(table))
        if before_batch is not None:
            rows = rows.filter(F.col(BATCH) < before_batch)
        return rows.select(*columns.fieldNames())

    def append(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Write a batch; repeating it replaces its own rows only.

        Rows are ordered by id inside each file, so that file and row group
        statistics let newest-first and cursor reads skip most data.
        """
        ordered = rows.select(*self._schema(table).fieldNames()).sortWithinPartitions("id")
        ordered.write.mode("overwrite").parquet(self._batch_path(table, batch_id))

    def keys(self, before_batch: int | None = None) -> KeyStore:
        """The keys of all items.  A store written before it had them gets them
        from its item table, batch by batch, once; not from a batch under way,
        which ``before_batch`` names."""
        from feedlake.sources.key_store import KeyStore

        keys = KeyStore(self.spark, self.path("item_keys"))
        if not keys.runs():
            for batch in self._item_batches(before_batch):
                keys.append(self._batch("feed_items", batch), batch)
        return keys

    def _item_batches(self, before_batch: int | None) -> list[int]:
        found = complete_batches(self.spark, self.path("feed_items"), BATCH)
        return sorted(b for b in found if before_batch is None or b < before_batch)

    def _batch(self, table: str, batch_id: int) -> DataFrame:
        if not exists(self.spark, self._batch_path(table, batch_id)):
            return self.empty(table)
        return self.spark.read.schema(self._schema(table)).parquet(self._batch_path(table, batch_id))

    def cadence_state(self, before_batch: int | None = None) -> CadenceState:
        """Cadence of all feeds, after it has read the batches it does not know yet.
        Batches without their keys are not finished and wait."""
        from feedlake.sources.cadence_state import CadenceState

        state = CadenceState(self.spark, self.path("cadence"))
        finished = max((r.last for r in self.keys(before_batch).runs(before_batch)), default=-1)
        known = max(state.batches(), default=-1)
        for batch in self._item_batches(before_batch):
            if known < batch <= finished:
                state.add(self._batch("feed_items", batch), self._batch("feed_item_details", batch), batch)
        return state

    def snapshot(self, table: str, before_batch: int | None = None) -> DataFrame:
        """The newest complete snapshot of a table, older than a batch if given."""
        found = [b for b in complete_batches(self.spark, self.path(table), BATCH) if before_batch is None or b < before_batch]
        columns = self._schema(table)
        if not found:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(self._batch_path(table, max(found)))

    def write_snapshot(self, table: str, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self._schema(table).fieldNames()).write.mode("overwrite").parquet(
            self._batch_path(table, batch_id)
        )

    def stream(self, table: str, max_files: int | None = None) -> DataFrame:
        """New rows of an appended table as they arrive.

        ``max_files`` bounds a micro-batch; unlike a bounded catch-up it only
        spreads the backlog over several batches and skips nothing.
        """
        batched = StructType([*self._schema(table).fields]).add(BATCH, LongType())
        reader = self.spark.readStream.schema(batched)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(self.path(table)).drop(BATCH)


def save_bucketed(items: DataFrame, details: DataFrame, buckets: int, database: str = "default") -> None:
    """Catalog tables bucketed by item id, which then join without a shuffle."""
    for rows, name, key in ((items, "feed_items", "id"), (details, "feed_item_details", "feed_item_id")):
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")


__all__ = ["TableStore", "complete_batches", "delete", "exists", "folder_names", "save_bucketed"]
