"""Labelled rows for fitting, and the split that keeps a part of them aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose remainder is 0 are held out: their labels are never learned.
FOLDS = 5


def is_held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32(id as text) mod ``folds`` is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label 0/1) outside the held-out fold; an id labelled twice counts once, as 1 if any row says so."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(docs: DataFrame, known: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """(label, text) of at most ``bounds[label]`` training documents per label,
    those with the smallest hash of their id, one row of an id: its smallest text.
    The id lists are bounded by the bounds, so they are broadcast, and only the
    chosen documents are shuffled."""
    chosen = None
    for value, most in bounds.items():
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
