"""One row per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row_per_word(rows: DataFrame, words: Column, name: str, *keep: Column | str) -> DataFrame:
    """The kept columns once for every element of ``words``.

    A plain explode makes the optimizer add a test for empty arrays next to
    the scan, where it tokenises every text a second time; dropping the null
    row of an empty array afterwards costs nothing.
    """
    return rows.select(*keep, F.explode_outer(words).alias(name)).filter(F.col(name).isNotNull())
