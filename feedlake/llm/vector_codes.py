"""Vector code compression: product codebooks searched by equal averages.

Entries of a codebook are sorted by the sum of their components.  For a part
whose components add up to s, the search starts at the entries whose sums are
next to s and goes outwards.  By Cauchy and Schwarz an entry with sum t is at
least (s - t)^2 / d away in squared distance, d being the number of components,
so it stops as soon as that strictly exceeds the best distance: no entry further
out can be as near, not even as a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import checked, settled
from feedlake.llm.integers import Sums, SUMS, finite, fits_long, floors, like, matrix, summed, whole

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
DIMS = 64
#: A table of up to so many labels is broadcast to the rows; a longer one is joined.
LABEL_ROWS = 500_000

#: codebooks[part][entry] is a list of integers.
Codebooks = list[list[list[int]]]


@dataclass
class Coded:
    """Rows (vec_id, label, code, error) and the codebooks that decode them."""

    rows: DataFrame
    codebooks: Codebooks

    def digest(self) -> str:
        numbers = [str(x) for book in self.codebooks for entry in book for x in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def equal_average_search(values: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (ties: the lower one), its exact squared
    distance, and how many distances were computed in all."""
    book, values = like(entries, values)
    n, d = values.shape
    exact = object if book.dtype == object else np.float64
    order = book.sum(axis=1).argsort(kind="stable")
    sums = book.sum(axis=1)[order]
    own = values.sum(axis=1)
    right = np.searchsorted(sums, own, "left")
    left = right - 1
    best = np.full(n, np.inf, dtype=exact)
    chosen = np.full(n, len(book), dtype=np.int64)
    active = np.arange(n)
    computed = 0
    while len(active):
        low, high, s = left[active], right[active], own[active]
        below = np.where(low >= 0, s - sums[np.maximum(low, 0)], np.inf)
        above = np.where(high < len(book), sums[np.minimum(high, len(book) - 1)] - s, np.inf)
        gap = np.where(below <= above, below, above)
        # entries left, and one of them may still be as near as the best
        finite_gap = gap != np.inf
        reach = np.zeros(len(active), dtype=bool)
        reach[finite_gap] = gap[finite_gap] * gap[finite_gap] <= best[active][finite_gap] * d
        down = (below <= above)[reach]
        active, low, high = active[reach], low[reach], high[reach]
        at = np.where(down, low, high)
        away = values[active] - book[order[at]]
        distance = (away * away).sum(axis=1)
        computed += len(active)
        index, now = order[at], best[active]
        better = (distance < now) | ((distance == now) & (index < chosen[active]))
        better = better.astype(bool)
        best[active[better]] = distance[better]
        chosen[active[better]] = index[better]
        left[active] -= down
        right[active] += ~down
    return chosen, best, computed


def _assigned(values: np.ndarray, books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every part its values, the chosen entries and their distances."""
    width = values.shape[1] // len(books)
    for p, book in enumerate(books):
        own = values[:, p * width : (p + 1) * width]
        chosen, distance, _ = equal_average_search(own, book)
        yield own, chosen, distance


def coded(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dims: int = DIMS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
) -> Coded:
    """Codebooks learned from all vectors, and every vector's code by them.

    Vectors that are null, hold a null or non-finite component or have another
    number of components than ``dims`` (a multiple of ``parts``) are left out.
    The codebooks start from the smallest ids, ties by the vector itself, rows
    without an id last; of fewer than ``entries`` vectors each is an entry.
    Repeated rows count each time; an entry that no part uses stays.  An empty
    table has empty codebooks.  An error that no long can hold is null.
    """
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("v"))
    kept = raw.filter(finite(F.col("v"), dims)).select("id", "label", whole(F.col("v"), scale).alias("x"))
    kept = settled(kept, "code-vectors")
    start = [[int(v) for v in r["x"]] for r in kept.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()]
    width = dims // parts
    books: Codebooks = [[row[p * width : (p + 1) * width] for row in start] for p in range(parts)]
    out_schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if not start:
        return Coded(spark.createDataFrame([], out_schema), books)

    for _ in range(rounds):
        books = _improved(kept.select("x"), books, dims)

    @F.pandas_udf("code string, error long")
    def encode(x: pd.Series) -> pd.DataFrame:
        digits = np.array([f"{i:02x}" for i in range(256)], dtype=object)
        code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), dtype=object)
        for _, chosen, distance in _assigned(matrix(x, dims), books):
            code = code + digits[chosen]
            error = error + np.array([int(v) for v in distance], dtype=object)
        return pd.DataFrame({"code": code, "error": pd.array(fits_long(error), dtype="Int64")})

    rows = kept.withColumn("r", encode.asNondeterministic()("x")).select(F.col("id").alias("vec_id"), "label", "r.code", "r.error")
    return Coded(settled(rows, "codes"), books)


def _improved(vectors: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """One round: every part to its nearest entry, entries to their parts' floors."""
    width = dims // len(books)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for batch in batches:
            if not len(batch):
                continue
            for p, (own, chosen, _) in enumerate(_assigned(matrix(batch["x"], dims), books)):
                for e in np.unique(chosen):
                    rows = own[chosen == e]
                    sums.add((p, int(e)), len(rows), rows.sum(axis=0))
        yield from sums.rows(["part", "entry"])

    sums = summed(vectors.mapInPandas(total, f"part int, entry int, {SUMS}"), ["part", "entry"], width)

    def entry(p: int, e: int) -> list[int]:
        n, total = sums.get((p, e), (0, []))
        return floors(total, n) if n else books[p][e]

    return [[entry(p, e) for e in range(len(book))] for p, book in enumerate(books)]


def decoded(code: str, books: Codebooks, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for, each component in the middle of its step."""
    chosen = [int(code[2 * p : 2 * p + 2], 16) for p in range(len(books))]
    return [(x + 0.5) / scale for p, e in enumerate(chosen) for x in books[p][e]]


def code_report(found: Coded) -> DataFrame:
    """Rows (vec_id, label, code, error, label_error, codebooks_sha256)."""
    totals = found.rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    totals = settled(totals, "label-errors")
    joined = found.rows.join(checked(totals, LABEL_ROWS), F.col("label").eqNullSafe(F.col("_label")))
    return joined.drop("_label").withColumn("codebooks_sha256", F.lit(found.digest()))
