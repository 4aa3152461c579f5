"""Approximate nearest neighbours by counting collisions on projections.

Each block of vectors keeps, for every random projection, its projected values
in sorted order.  A query's window on each of them starts narrow and doubles
(virtual rehashing: no new index is built).  A vector that lies in the windows
of enough projections is verified by its true distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import settled

PROJECTIONS = 48
#: Share of the projections whose windows must hold a vector before it is verified.
COLLISIONS = 0.6
#: A query stops widening when it has verified this share of a block, and at
#: least this many vectors for each neighbour asked for.
VERIFIED_SHARE = 0.2
VERIFIED_EACH = 30
#: Vectors of a block, and queries of a chunk; one task holds one of each.
BLOCK_ROWS = 4096
CHUNK_ROWS = 2048
SEED = 20240611


def usable(vector: Column) -> Column:
    """Neither null, nor empty, nor zero, nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def candidates(index: np.ndarray, queries: np.ndarray, k: int):
    """For each query the positions in ``index`` that the method verifies."""
    rng = np.random.default_rng(SEED)
    lines = rng.standard_normal((index.shape[1], PROJECTIONS))
    at = np.stack([(index * lines[:, j]).sum(axis=1) for j in range(PROJECTIONS)])
    asked = np.stack([(queries * lines[:, j]).sum(axis=1) for j in range(PROJECTIONS)])
    order = at.argsort(axis=1)
    ranked = np.take_along_axis(at, order, axis=1)
    n = index.shape[0]
    enough = min(n, max(int(np.ceil(VERIFIED_SHARE * n)), VERIFIED_EACH * k))
    threshold = int(np.ceil(COLLISIONS * PROJECTIONS))
    spread = np.maximum(at.std(axis=1), 1e-12)
    for q in range(len(queries)):
        half = 0.25
        while True:
            hits = np.zeros(n, dtype=np.int16)
            full = True
            for j in range(PROJECTIONS):
                low = np.searchsorted(ranked[j], asked[j, q] - half * spread[j], "left")
                high = np.searchsorted(ranked[j], asked[j, q] + half * spread[j], "right")
                hits[order[j, low:high]] += 1
                full = full and low == 0 and high == n
            found = np.flatnonzero(hits >= threshold)
            if len(found) >= enough or full:
                yield q, found
                break
            half *= 2 if not len(found) else 1.25


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows of ``vectors`` found for each row of ``queries``:
    (query_id, rank, vec_id, score), score being the Euclidean distance in double
    precision, nearest first, ties to the smaller id.

    Both are split into blocks of bounded size; every block of vectors meets every
    chunk of queries, each pair in its own task, and the best of each pair are
    merged.  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null id, take no part; vectors of another length
    than the query's are no candidates.  A query is no neighbour of its own id;
    repeated ids count once, with any one of their vectors that is smallest in
    array order.
    """

    def ready(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
        return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    index = settled(ready(vectors), "neighbours-index")
    asked = settled(ready(queries), "neighbours-queries")
    blocks = max(1, -(-index.count() // BLOCK_ROWS))
    chunks = max(1, -(-asked.count() // CHUNK_ROWS))

    def spread(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = spread(index, "block", blocks, "chunk", chunks)
    right = spread(asked, "chunk", chunks, "block", blocks)

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(wanted):
            rows = rows.sort_values("id")
            ids = rows["id"].to_numpy()
            own = np.stack(rows["v"].to_numpy()).astype(np.float64)
            query_ids = wanted["id"].to_numpy()
            points = np.stack(wanted["v"].to_numpy()).astype(np.float64)
            for q, found in candidates(own, points, k):
                found = found[ids[found] != query_ids[q]]
                distance = np.sqrt(((own[found] - points[q]) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], distance))[:k]
                out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[found][best], "score": distance[best]}))
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(out or [empty])

    keys = ["dim", "block", "chunk"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
