"""Quality scores by pairwise ranking (Bradley-Terry).

A document's worth is linear in features of its text.  From pairs of a preferred
and a rejected document the weights are learned by logistic loss on feature
differences.  The threshold is a quantile of the scores of all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import arrow_rows, settled
from feedlake.llm.labelled import FOLDS, is_held_out, labelled_sample, training_labels

#: Documents of each label that pairs are drawn from; the rest of the labels
#: still decides the threshold.
PAIR_DOCUMENTS = 2000
#: Opponents of every rejected document.
OPPONENTS = 8
RIDGE = 1e-3
#: Calibrated score of a document exactly at the threshold.
CUT = 0.3

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
LETTERS = bytes(range(97, 123))
PLAIN = UPPER + DIGITS + LETTERS + bytes([9, 10, 11, 12, 13, 32, 44, 46]) + bytes(range(128, 256))


def features(text: str) -> list[float]:
    """Shares of the text that mark shouting, symbol noise, menus and repetition."""
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    words = raw.split()
    count = max(len(words), 1)
    lines = raw.split(b"\n")
    upper = n - len(raw.translate(None, UPPER))
    symbols = len(raw.translate(None, PLAIN))
    repeated = sum(map(eq, words, words[1:]))
    return [
        math.sqrt(upper / n),
        math.sqrt(symbols / n),
        math.sqrt(raw.count(b"|") / count),
        math.sqrt(repeated / count),
        math.sqrt((n - len(raw.translate(None, DIGITS))) / n),
        1 - len(set(words)) / count,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(words)),
        math.log1p(n / count),
    ]


def fit_pairs(better: np.ndarray, worse: np.ndarray, opponents: int = OPPONENTS, steps: int = 60) -> np.ndarray:
    """Weights (first row) over features scaled by (second row): Newton steps on
    the logistic loss of score differences, with a ridge."""
    scale = np.concatenate([better, worse]).std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    n = np.arange(len(worse) * opponents)
    diff = (better[(n * 7919) % len(better)] - worse[n // opponents]) / scale
    weights = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip((diff * weights).sum(axis=1), -30, 30)))
        gradient = -(diff * p[:, None]).mean(axis=0) + RIDGE * weights
        spread = (p * (1 - p))[:, None, None] * diff[:, :, None] * diff[:, None, :]
        hessian = spread.mean(axis=0) + RIDGE * np.eye(len(weights))
        step = _solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([weights, scale])


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination for a handful of unknowns."""
    m = np.concatenate([a, b[:, None]], axis=1)
    for i in range(len(b)):
        top = i + int(np.abs(m[i:, i]).argmax())
        m[[i, top]] = m[[top, i]]
        m[i] /= m[i, i]
        for j in range(len(b)):
            if j != i:
                m[j] -= m[j, i] * m[i]
    return m[:, -1]


def _worth(weights: np.ndarray):
    @F.pandas_udf("double")
    def worth(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([features(x) for x in texts.tolist()]).reshape(len(texts), -1)
            yield pd.Series((rows / weights[1] * weights[0]).sum(axis=1))

    return worth


def _features_udf():
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in texts.tolist()])

    return of


def threshold_of(own: DataFrame) -> float:
    """The score quantile with the fewest wrong labels of ``own(raw, label)``: the
    cut below which rows are rejected, in the middle between two scores; the
    lowest when several are as good.

    Equal scores are added up, the sums sorted over all tasks, and every task
    leaves one row, so the cut is exact whatever the range of the scores is.
    """
    sums = own.groupBy("raw").agg(F.sum(1 - F.col("label")).alias("zeros"), F.sum("label").alias("ones"))
    ranges = settled(sums, "quality-scores").orderBy("raw").mapInPandas(_best_cut, CUTS).collect()
    ranges.sort(key=lambda r: r["first"])
    best = wrong = sum(r["zeros"] for r in ranges)
    cut = ranges[0]["first"] if ranges else 0.0
    for r, later in zip(ranges, [*ranges[1:], None], strict=True):
        if wrong + r["gain"] < best:
            best = wrong + r["gain"]
            after = r["after"] if r["after"] is not None else later["first"] if later else r["at"] + 1
            cut = (r["at"] + after) / 2
        wrong += r["ones"] - r["zeros"]
    return cut


CUTS = "first double, zeros long, ones long, gain long, at double, after double"


def _best_cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one task's ascending scores: the first, the labels, and the score after
    which a cut gains most, with the one that follows it here."""
    first = at = after = None
    zeros = ones = gain = 0
    for b in batches:
        if not len(b):
            continue
        raw = b["raw"].to_numpy()
        first = raw[0] if first is None else first
        if at is not None and after is None:
            after = raw[0]
        gains = ones - zeros + (b["ones"] - b["zeros"]).to_numpy().cumsum()
        i = int(gains.argmin())
        if at is None or gains[i] < gain:
            gain, at, after = int(gains[i]), raw[i], raw[i + 1] if i + 1 < len(raw) else None
        zeros, ones = zeros + int(b["zeros"].sum()), ones + int(b["ones"].sum())
    if first is not None:
        yield pd.DataFrame({"first": [first], "zeros": [zeros], "ones": [ones], "gain": [gain], "at": [at], "after": pd.array([after], dtype="Float64")})


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and threshold, or None without training rows of both labels.

    Weights come from pairs among at most ``PAIR_DOCUMENTS`` training documents of
    each label; the threshold from the scores of all training rows.
    """
    arrow_rows(docs.sparkSession)
    known = training_labels(labels, "quality")
    sample = labelled_sample(docs, known, {1: PAIR_DOCUMENTS, 0: PAIR_DOCUMENTS})
    rows = sample.select("label", _features_udf()("text").alias("f")).collect()
    sides = [np.array([r["f"] for r in rows if r["label"] == v]) for v in (1, 0)]
    if not len(sides[0]) or not len(sides[1]):
        return None
    weights = fit_pairs(*sides)
    raw = docs.select("doc_id", _worth(weights)(F.coalesce("text", F.lit(""))).alias("raw"))
    return weights, threshold_of(raw.join(known, "doc_id").select("raw", "label"))


def quality_of(model: tuple[np.ndarray, float] | None, text: Column, cut: float = CUT) -> Column:
    """Score 0 to 1: the logistic of the distance to the threshold, shifted so
    that the threshold has score ``cut``.  Without a model every score is 1."""
    if model is None:
        return F.lit(1.0)
    weights, threshold = model
    shift = math.log(cut / (1 - cut))
    return 1 / (1 + F.exp(-(_worth(weights)(F.coalesce(text, F.lit(""))) - threshold + shift)))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, held_out, score, predicted).

    ``predicted`` is 1 from score ``cut`` on.  Null texts are empty, and empty
    texts get the score of their (zero) features; null ids and repeated rows
    stay.  Without training rows of both labels nothing can be ranked: every
    score is 1.  Only the text is an input of a score.
    """
    model = fit_quality(docs, labels)
    scored = docs.select(
        "doc_id", is_held_out(F.col("doc_id"), FOLDS).alias("held_out"), quality_of(model, F.col("text"), cut).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
