"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary documents each have a model of their expressions (words).  A
word's discounted count backs off to the discounted count of its stem (its first
bytes) in the same class, and that to the number of different words with the
stem in both classes together.  A rare expression is so judged by its relatives,
and one that neither class has seen by shared counts, which say nothing for
either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import arrow_rows, hand_back
from feedlake.llm.labelled import FOLDS, is_held_out, labelled_sample, training_labels

#: Training documents of each class; half teach the models, half the weights of
#: the evidence.
TOXIC_DOCUMENTS = 2000
ORDINARY_DOCUMENTS = 4000
DISCOUNT = 0.75
STEM_BYTES = 4
RIDGE = 1e-4
#: Documents are toxic from this score on.
CUT = 0.5

#: Bytes that are no part of a word: ASCII other than letters and digits.
GAPS = bytes(range(0, 48)) + bytes(range(58, 97)) + bytes(range(123, 128))
SPACED = bytes.maketrans(GAPS, b" " * len(GAPS))


def expressions(text: str) -> list[bytes]:
    """Words as bytes: A-Z lower-cased, ASCII signs as gaps."""
    return text.encode("utf-8", "replace").lower().translate(SPACED).split()


class ClassModels:
    """log p(word | toxic) - log p(word | ordinary) from counts of both classes."""

    def __init__(self, toxic: dict[bytes, int], ordinary: dict[bytes, int]):
        kinds: dict[bytes, int] = {}
        for word in toxic.keys() | ordinary.keys():
            kinds[word[:STEM_BYTES]] = kinds.get(word[:STEM_BYTES], 0) + 1
        total = sum(kinds.values()) + 1
        sides = []
        for counts in (toxic, ordinary):
            n = max(1, sum(counts.values()))
            stems: dict[bytes, int] = {}
            for word, c in counts.items():
                stems[word[:STEM_BYTES]] = stems.get(word[:STEM_BYTES], 0) + c
            back = DISCOUNT * max(1, len(stems)) / n
            stem_p = {s: max(stems.get(s, 0) - DISCOUNT, 0) / n + back * k / total for s, k in kinds.items()}
            sides.append((counts, n, DISCOUNT * max(1, len(counts)) / n, stem_p))
        self.stems: dict[bytes, float] = {}
        self.words: dict[bytes, float] = {}
        (ct, nt, bt, pt), (co, no, bo, po) = sides
        for stem, k in kinds.items():
            # a new word with a known stem
            self.stems[stem] = math.log(bt * pt[stem]) - math.log(bo * po[stem])
        for word in toxic.keys() | ordinary.keys():
            stem = word[:STEM_BYTES]
            each = 1 / (kinds[stem] + 1)
            a = max(ct.get(word, 0) - DISCOUNT, 0) / nt + bt * pt[stem] * each
            b = max(co.get(word, 0) - DISCOUNT, 0) / no + bo * po[stem] * each
            self.words[word] = math.log(a) - math.log(b)

    def ratio(self, word: bytes) -> float:
        found = self.words.get(word)
        return self.stems.get(word[:STEM_BYTES], 0.0) if found is None else found

    def evidence(self, text: str) -> tuple[float, float]:
        """Length-normalised log-likelihood ratios: of the text's most toxic
        expression, and of the whole text.  (0, 0) without words."""
        words = expressions(text)
        if not words:
            return 0.0, 0.0
        known, ratio = self.words, self.ratio
        values = [known[w] if w in known else ratio(w) for w in words]
        return max(values), sum(values) / len(values)


def fit_evidence(x: np.ndarray, y: np.ndarray, toxic_share: float, steps: int = 80) -> np.ndarray:
    """Logistic weights (bias first), by Newton steps; the classes weigh as much
    as they have in all training rows."""
    from feedlake.llm.quality import _solve

    rows = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    share = np.where(y == 1, toxic_share / max(1, (y == 1).sum()), (1 - toxic_share) / max(1, (y == 0).sum()))
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((rows * weights).sum(axis=1), -30, 30)))
        gradient = (rows * ((p - y) * share)[:, None]).sum(axis=0) + RIDGE * weights
        spread = (p * (1 - p) * share)[:, None, None] * rows[:, :, None] * rows[:, None, :]
        step = _solve(spread.sum(axis=0) + RIDGE * np.eye(len(weights)), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _word_counts(sample: DataFrame) -> DataFrame:
    """(label, part, word, n): words of the sample, the parts being halves by text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[int, int, bytes], int] = {}
            for label, part, text in zip(batch["label"], batch["part"], batch["text"], strict=True):
                for w in expressions(text):
                    key = (label, part, w)
                    seen[key] = seen.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["label", "part", "word", "n"])

    rows = sample.mapInPandas(count, "label int, part int, word binary, n long")
    return rows.groupBy("label", "part", "word").agg(F.sum("n").alias("n"))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[ClassModels, np.ndarray] | None:
    """The class models and the weights of their evidence, or None without
    training rows of both classes in both halves of the sample.

    The models' counts come from a bounded sample of training documents
    (``TOXIC_DOCUMENTS``, ``ORDINARY_DOCUMENTS``).  The weights are fitted on one
    half of it with models of the other; the final models count both.
    """
    arrow_rows(docs.sparkSession)
    known = training_labels(labels, "toxic")
    sample = labelled_sample(docs, known, {1: TOXIC_DOCUMENTS, 0: ORDINARY_DOCUMENTS})
    # copies of a text fall in the same half
    sample = sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    counts: dict[tuple[int, int], dict[bytes, int]] = {(part, label): {} for part in (0, 1) for label in (0, 1)}
    for r in _word_counts(sample).toLocalIterator():
        counts[r["part"], r["label"]][bytes(r["word"])] = r["n"]
    if not all(counts.values()):
        return None
    half = ClassModels(counts[0, 1], counts[0, 0])

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([list(half.evidence(x)) for x in texts.tolist()])

    rows = sample.filter("part = 1").select("label", evidence("text").alias("e")).collect()
    share = known.agg(F.avg("label")).head()[0]
    weights = fit_evidence(np.array([r["e"] for r in rows]), np.array([r["label"] for r in rows]), share)
    for label in (0, 1):
        for word, n in counts[1, label].items():
            counts[0, label][word] = counts[0, label].get(word, 0) + n
    return ClassModels(counts[0, 1], counts[0, 0]), weights


def toxicity_of(model: tuple[ClassModels, np.ndarray] | None, text: Column) -> Column:
    """Score 0 to 1 of a text; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    models, weights = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                found = np.array([models.evidence(x) for x in texts.tolist()]).reshape(-1, 2)
                yield pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + (found * weights[1:]).sum(axis=1), -30, 30))))
        finally:
            hand_back()

    return score(F.coalesce(text, F.lit("")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, held_out, score, predicted).

    Every whole text is scored, map-side.  Null and empty texts have no evidence
    for either class; null ids and repeated rows stay.  Without training rows of
    both classes every score is 0.  Only the text is an input of a score.
    """
    score = toxicity_of(fit_toxicity(docs, labels), F.col("text"))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id"), FOLDS).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
