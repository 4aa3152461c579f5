"""Centroid clustering with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less that to its
own.  While centroids move, the gap shrinks by no more than its own centroid's
drift plus the largest drift of another, so a vector that enters its cluster's
heap with the key gap + D, D being the drift the cluster has accumulated until
then, need not be looked at until D has reached the key.

A cluster's heap is kept as sorted runs: every round writes the vectors it has
scanned, ordered by cluster and key, as one Parquet run.  Popping the expired
ones is a range filter on (cluster, key), for which statistics of row groups and
pages skip all that is not due.  A run is written once and never changed, so a
lost executor costs its own tasks only.  Nothing is shuffled by cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import settled
from feedlake.llm.integers import Sums, SUMS, finite, fits_long, floors, like, matrix, summed, whole

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMS = 64
#: Bounds are rounded to the safe side by this share, far more than doubles lose.
SAFETY = 1e-9

@dataclass
class Clustering:
    """Rows (vec_id, cluster, distance) and the final centroids; ``scanned`` has
    the number of vectors that each round looked at in full."""

    rows: DataFrame
    centroids: list[list[int]]
    scanned: list[int] = field(default_factory=list)

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[cluster])).encode()).hexdigest()


def squared_distances(values: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared Euclidean distances, a column per centroid."""
    table, values = like(centroids, values)
    own = (values * values).sum(axis=1)[:, None]
    return own - 2 * values.dot(table.T) + (table * table).sum(axis=1)[None, :]


def _scan(centroids: list[list[int]], drift: list[float], dims: int):
    """Nearest centroid and heap key of every row, by all distances."""

    @F.pandas_udf("cluster int, key double")
    def scan(x: pd.Series) -> pd.DataFrame:
        exact = squared_distances(matrix(x, dims), centroids)
        # the first of the smallest: ties go to the smaller number
        nearest = exact.argmin(axis=1).astype(np.int32)
        far = np.sqrt(exact.astype(np.float64))
        at = np.arange(len(nearest))
        upper = far[at, nearest]
        far[at, nearest] = np.inf
        lower = far.min(axis=1)
        gap = np.full(len(nearest), np.inf)
        # with one centroid nothing can ever come nearer
        some = ~np.isinf(lower)
        gap[some] = (lower - upper)[some] - SAFETY * (lower + upper)[some]
        return pd.DataFrame({"cluster": nearest, "key": gap + np.array(drift)[nearest]})

    # else the optimizer may call it once for each field
    return scan.asNondeterministic()


def _own_distance(centroids: list[list[int]], dims: int):
    @F.pandas_udf("long")
    def measure(x: pd.Series, cluster: pd.Series) -> pd.Series:
        table, values = like(centroids, matrix(x, dims))
        away = values - table[cluster.to_numpy()]
        return pd.Series(fits_long((away * away).sum(axis=1)), dtype="Int64")

    return measure


def _moved(dims: int):
    """Sums that the clusters of the moved rows gain and lose."""

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for batch in batches:
            values = matrix(batch["x"], dims)
            for sign, column in ((1, "cluster"), (-1, "old")):
                own = batch[column].to_numpy()
                for c in np.unique(own[own >= 0]):
                    rows = values[own == c]
                    sums.add((int(c),), sign * len(rows), sign * rows.sum(axis=0))
        yield from sums.rows(["cluster"])

    return moved


def _due(before: list[float] | None, now: list[float]) -> Column:
    """Keys that the drift reaches now and had not reached before."""
    each = []
    for c, limit in enumerate(now):
        later = "" if before is None else f" and key > double('{before[c]!r}')"
        each.append(f"cluster = {c} and key <= double('{limit!r}'){later}")
    return F.expr(" or ".join(each))


def _waiting(now: list[float]) -> Column:
    return F.expr(" or ".join(f"cluster = {c} and key > double('{limit!r}')" for c, limit in enumerate(now)))


def _drifts(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """How much each cluster's gaps may have shrunk."""
    moved = [float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 * (1 + SAFETY) for x, y in zip(old, new, strict=True)]
    return [m + max([x for j, x in enumerate(moved) if j != i], default=0.0) for i, m in enumerate(moved)]


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dims: int = DIMS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clustering:
    """Lloyd's rounds over floor(scale * x), exact at every step.

    Vectors with another number of components than ``dims`` or with a null or
    non-finite one take no part.  The first centroids are the vectors with the
    smallest sha256 of ``1:<id>``, ties by the vector itself; rows without an id
    come after all others there and are clustered like them.  Repeated rows count
    each time.  Of fewer than ``clusters`` vectors each starts a centroid; an empty
    table has no rows and no centroids.  An empty centroid stays where it is.  A
    distance that no long can hold is null.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kept = raw.filter(finite(F.col("v"), dims)).select("id", whole(F.col("v"), scale).alias("x"))
    first = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    start = kept.orderBy(first.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    centroids = [[int(v) for v in row["x"]] for row in start]
    if not centroids:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [])

    plain = kept.withColumn("old", F.lit(-1))
    sums = {c: (0, [0] * dims) for c in range(len(centroids))}
    drift = [0.0] * len(centroids)
    reached: list[list[float]] = []
    runs: list[DataFrame] = []
    scanned = []
    for turn in range(rounds + 1):
        if turn:
            moved = [floors(total, n) if n else old for (n, total), old in zip(sums.values(), centroids, strict=True)]
            drift = [d + e for d, e in zip(drift, _drifts(centroids, moved), strict=True)]
            centroids = moved
            # a run is asked for what has come due since it was written or last asked
            popped = [
                run.filter(_due(None if written == turn - 1 else reached[-1], drift)) for written, run in enumerate(runs)
            ]
            plain = reduce(DataFrame.unionAll, popped).select("id", "x", F.col("cluster").alias("old"))
        reached.append(drift)
        run = plain.withColumn("r", _scan(centroids, drift, dims)("x")).select("id", "x", "old", "r.cluster", "r.key")
        run = run.sortWithinPartitions("cluster", "key")
        run = settled(run, f"heap-run-{turn}")
        runs.append(run)
        scanned.append(run.count())
        changed = run.filter("cluster <> old").select("x", "old", "cluster").mapInPandas(_moved(dims), f"cluster int, {SUMS}")
        for (c,), (n, total) in summed(changed, ["cluster"], dims).items():
            was, before = sums[c]
            sums[c] = (was + n, [a + b for a, b in zip(before, total, strict=True)])

    last = [run if written == rounds else run.filter(_waiting(drift)) for written, run in enumerate(runs)]
    rows = reduce(DataFrame.unionAll, last)
    distance = _own_distance(centroids, dims)("x", "cluster")
    rows = settled(rows.select(F.col("id").alias("vec_id"), "cluster", distance.alias("distance")), "clustered")
    return Clustering(rows, centroids, scanned)


def cluster_report(found: Clustering) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    rows = found.rows
    if not found.centroids:
        empty = F.lit(None).cast("long")
        return rows.select("*", empty.alias("cluster_inertia"), empty.alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    # one row per centroid
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = [int(sums.get(c) or 0) for c in range(len(found.centroids))]

    def listed(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("cluster")]

    own = F.array(*[F.lit(v).cast("long") for v in fits_long(inertia)])[F.col("cluster")]
    return rows.select(
        "*",
        own.alias("cluster_inertia"),
        F.lit(fits_long([sum(inertia)])[0]).cast("long").alias("inertia"),
        listed([found.digest(c) for c in range(len(found.centroids))]).alias("centroid_sha256"),
    )
