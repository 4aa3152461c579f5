"""Which item keys are stored already, answered without reading the history.

Beside the item table, every batch (a run) leaves two small tables: its keys, in
folders by bucket of the key's hash, and a blocked Bloom filter of each bucket.
A filter is a table as well: one row per block of 512 bits, and a key sets, and
later looks at, eight bits of one block only.  So a probe is an equality join on
(run, bucket, block), the filters of other buckets are never read, and keys are
read only from the buckets of the runs whose filter says that they may hold one;
these are then compared exactly.

The number of buckets and blocks of a run follows its size, so filters stay at
about twelve bits a key and a false alarm at less than one in a hundred.
``compacted`` folds runs into one.  A run's folder name says what is needed to ask
it, and its filters are written last: a batch that failed before is not there, and
one that is repeated replaces its own run.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import settled
from feedlake.sources.tables import delete, folder_names

KEY = ["feed_id", "external_id"]
#: Keys of a bucket, and of a block of 512 bits.
BUCKET_KEYS = 1 << 18
BLOCK_KEYS = 42
MOST_BUCKETS = 1 << 14
WORDS = 8
#: Up to this many probes (five longs each) are sent to the filters; more of them
#: are joined by shuffling, when the work follows the batch anyway.
PROBE_ROWS = 200_000


@dataclass(frozen=True)
class Run:
    """What a run's folder name says of it."""

    first: int
    last: int
    buckets: int
    blocks: int
    max_id: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}-{self.buckets}-{self.blocks}-{self.max_id}"


def place_hash() -> Column:
    return F.xxhash64(*KEY)


def bit_hash() -> Column:
    """Independent of the place, so that keys of one block differ in their bits."""
    return F.xxhash64("external_id", "feed_id", F.lit(1))


def bit(hashed: Column, word: int) -> Column:
    """The one bit of 64 that a key sets in a word of its block."""
    at = F.shiftrightunsigned(hashed, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bucket_of(hashed: Column, buckets: Column) -> Column:
    return F.pmod(hashed, buckets).cast("int")


def block_of(hashed: Column, buckets: Column, blocks: Column) -> Column:
    return F.pmod(F.floor(hashed / buckets), blocks).cast("int")


class KeyStore:
    """Keys of all batches below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- runs ------------------------------------------------------------------

    def _path(self, table: str, run: Run) -> str:
        return f"{self.root}/{table}/run={run.name}"

    def runs(self, before_batch: int | None = None) -> list[Run]:
        """Complete runs in order; a run that a wider one covers no longer counts.
        One folder each; compaction bounds their number."""
        names = folder_names(self.spark, f"{self.root}/filters/run=*/_SUCCESS")
        found = [Run(*map(int, n.split("-"))) for n in names]
        found = [r for r in found if before_batch is None or r.last < before_batch]
        return sorted((r for r in found if not any(r != o and o.first <= r.first and r.last <= o.last for o in found)), key=lambda r: r.first)

    def max_id(self, before_batch: int | None = None) -> int:
        """Largest item id of the runs, 0 without any."""
        return max((r.max_id for r in self.runs(before_batch)), default=0)

    def append(self, keys: DataFrame, batch: int, first: int | None = None) -> Run:
        """Write ``keys`` (feed_id, external_id, id) as the run of a batch."""
        first = batch if first is None else first
        keys = keys.select(*KEY, "id")
        n, top = keys.agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(0))).first()
        buckets = min(MOST_BUCKETS, 1 << max(0, (n // BUCKET_KEYS)).bit_length())
        run = Run(first, batch, buckets, max(1, -(-n // (buckets * BLOCK_KEYS))), top)
        self._drop(r for r in self._written() if (r.first, r.last) == (run.first, run.last))
        h, b = place_hash(), F.lit(buckets)
        placed = keys.withColumn("bucket", bucket_of(h, b)).withColumn("block", block_of(h, b, F.lit(run.blocks)))
        dealt = placed.repartition("bucket") if buckets > 1 else placed.coalesce(1)
        dealt.sortWithinPartitions("bucket", "block").write.partitionBy("bucket").parquet(self._path("keys", run))
        words = [F.bit_or(bit(bit_hash(), w)).alias(f"w{w}") for w in range(WORDS)]
        filters = placed.groupBy("bucket", "block").agg(*words)
        filters = filters.repartition("bucket") if buckets > 1 else filters.coalesce(1)
        filters.write.partitionBy("bucket").parquet(self._path("filters", run))
        return run

    def _written(self) -> list[Run]:
        """All runs, those of failed batches included."""
        return [Run(*map(int, n.split("-"))) for n in folder_names(self.spark, f"{self.root}/keys/run=*/*")]

    def _drop(self, runs: Iterable[Run]) -> None:
        for run in set(runs):
            # without its filters a run no longer counts
            delete(self.spark, self._path("filters", run))
            delete(self.spark, self._path("keys", run))

    def compacted(self, until_batch: int) -> Run | None:
        """Fold the runs up to a batch into one and delete the folded ones.

        The folded run counts once its filters are complete; a failure before
        that leaves the old ones in force.
        """
        old = [r for r in self.runs() if r.last <= until_batch]
        if len(old) < 2:
            return old[0] if old else None
        schema = "feed_id long, external_id string, id long"
        keys = None
        for r in old:
            rows = self.spark.read.schema(schema).parquet(self._path("keys", r))
            keys = rows if keys is None else keys.unionByName(rows)
        run = self.append(keys, old[-1].last, old[0].first)
        self._drop(old)
        return run

    # --- lookups -----------------------------------------------------------------

    def _read(self, table: str, pairs: list[tuple[str, int]], schema: str) -> DataFrame | None:
        """Rows of the given (run, bucket) folders, other folders not even listed."""
        there = {(run, int(b)) for run in {r for r, _ in pairs} for b in folder_names(self.spark, f"{self.root}/{table}/run={run}/bucket=*/*", "bucket")}
        paths = [f"{self.root}/{table}/run={run}/bucket={bucket}" for run, bucket in pairs if (run, bucket) in there]
        if not paths:
            return None
        reader = self.spark.read.schema(f"{schema}, run string, bucket int").option("basePath", f"{self.root}/{table}")
        return reader.parquet(*paths)

    @staticmethod
    def _folders(rows: DataFrame) -> tuple[list[tuple[str, int]], bool]:
        """The (run, bucket) folders that rows ask for, and whether they are few."""
        found = rows.groupBy("run", "bucket").count().collect()
        return [(r["run"], r["bucket"]) for r in found], sum(r["count"] for r in found) <= PROBE_ROWS

    def suspects(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame | None:
        """(run, bucket, feed_id, external_id) of keys that a run may hold."""
        runs = self.runs(before_batch)
        if not runs:
            return None
        known = F.array(*[F.struct(F.lit(r.name).alias("run"), F.lit(r.buckets).alias("buckets"), F.lit(r.blocks).alias("blocks")) for r in runs])
        probes = keys.select(*KEY, place_hash().alias("h"), bit_hash().alias("g"), F.explode(known).alias("r"))
        probes = probes.select(
            *KEY, "g", "r.run", bucket_of(F.col("h"), F.col("r.buckets")).alias("bucket"), block_of(F.col("h"), F.col("r.buckets"), F.col("r.blocks")).alias("block")
        )
        # at most the buckets of all runs, and at most the batch's keys
        touched, few = self._folders(probes)
        words = ", ".join(f"w{w} long" for w in range(WORDS))
        filters = self._read("filters", touched, f"block int, {words}")
        if filters is None:
            return None
        hit = F.lit(True)
        for w in range(WORDS):
            hit = hit & (F.col(f"w{w}").bitwiseAND(bit(F.col("g"), w)) != 0)
        met = filters.join(F.broadcast(probes) if few else probes, ["run", "bucket", "block"]).filter(hit)
        return settled(met.select("run", "bucket", *KEY), "key-suspects")

    def known(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame | None:
        """The keys among ``keys`` that are stored, exactly; None if there are none."""
        doubtful = self.suspects(keys, before_batch)
        if doubtful is None:
            return None
        pairs, few = self._folders(doubtful)
        stored = self._read("keys", pairs, "feed_id long, external_id string, id long") if pairs else None
        if stored is None:
            return None
        met = stored.select("run", "bucket", *KEY).join(F.broadcast(doubtful) if few else doubtful, ["run", "bucket", *KEY])
        return met.select(*KEY).distinct()

    def unknown(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame:
        """The rows of ``keys`` (one row per key) whose key no run holds.

        A key with a null part equals no stored one.
        """
        keys = settled(keys, "batch-keys")
        found = self.known(keys, before_batch)
        return keys if found is None else keys.join(found, KEY, "left_anti")


__all__ = ["KeyStore", "Run"]
