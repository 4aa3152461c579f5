"""Vectors as exact integers, and sums of them, for the quantising operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this magnitude, sums of squared differences over 64 components stay
#: below 2^53, so doubles hold them exactly; beyond it Python's integers are used.
EXACT_BELOW = 1 << 22

SUMS = "n long, sums array<decimal(38,0)>"


def finite(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite; false for a null vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & ~bad, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component.  ``scale`` is a power of two, so the
    product is exact; a double holds every such floor."""
    parts = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    # Spark's floor gives a long, which the largest floats would not fit
    return F.transform(parts, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """The rows of an array column: doubles where these are exact, else Python integers."""
    if not len(column):
        return np.zeros((0, dims))
    rows = np.stack(column.to_numpy()).astype(np.float64)
    return rows if np.abs(rows).max() <= EXACT_BELOW else as_integers(rows)


def as_integers(rows: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(rows)


def like(rows: list[list[int]], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` (integers) and ``values`` as matrices of one exact kind."""
    table = np.array(rows, dtype=object)
    if values.dtype != object and all(abs(x) <= EXACT_BELOW for row in rows for x in row):
        return table.astype(np.float64), values
    return table, values if values.dtype == object else as_integers(values)


def fits_long(values) -> list[int | None]:
    """Integers as they are; null where a long can't hold one."""
    return [int(x) if -(1 << 63) <= x < 1 << 63 else None for x in values]


class Sums:
    """Counts and componentwise sums per key of one task."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, ...], list] = {}

    def add(self, key: tuple[int, ...], n: int, total: np.ndarray) -> None:
        now = self.of.setdefault(key, [0, as_integers(np.zeros(len(total)))])
        now[0] += n
        now[1] = now[1] + as_integers(total)

    def rows(self, names: list[str]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        if self.of:
            data = [(*key, n, [Decimal(x) for x in total]) for key, (n, total) in self.of.items()]
            yield pd.DataFrame(data, columns=[*names, "n", "sums"])


def summed(partial: DataFrame, names: list[str], dims: int) -> dict[tuple[int, ...], tuple[int, list[int]]]:
    """Sums over all tasks: one row per task and key goes in; a row per key and
    component reaches the driver, as many as the codebooks have, whatever the input."""
    parts = partial.selectExpr(*names, "n", "posexplode(sums) as (pos, value)")
    out: dict = {}
    for row in parts.groupBy(*names, "pos").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        if row["value"] is None:
            raise ArithmeticError("the sum of a component exceeds 38 digits")
        n, total = out.setdefault(tuple(row[x] for x in names), (row["n"], [0] * dims))
        total[row["pos"]] = int(row["value"])
    return out


def floors(total: list[int], n: int) -> list[int]:
    return [x // n for x in total]
