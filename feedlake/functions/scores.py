"""Numeric rules: scores, poll intervals, display scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the poll interval, and how sure a cadence must be.
MIN_POLL_INTERVAL_SECONDS = 60
MAX_POLL_INTERVAL_SECONDS = 6000
MIN_CADENCE_SAMPLES = 2
MIN_CADENCE_GAP_SECONDS = 60

# Share of the best score above which a topic gets a band.
SCORE_BANDS = ((0.7, "top"), (0.4, "high"), (0.2, "medium"))


def tf_idf(occurrences: Column, documents_with_word: Column, documents: Column) -> Column:
    """``ln(1 + tf) * ln(N / df)``; 0 when either count is 0."""
    score = F.log(1.0 + occurrences.cast("double")) * F.log(
        documents.cast("double") / documents_with_word.cast("double")
    )
    return F.when((documents_with_word > 0) & (documents > 0), score).otherwise(F.lit(0.0))


def clamp_interval(seconds: Column) -> Column:
    return F.least(
        F.greatest(seconds, F.lit(MIN_POLL_INTERVAL_SECONDS).cast("long")),
        F.lit(MAX_POLL_INTERVAL_SECONDS).cast("long"),
    )


def resolved_interval(cadence_seconds: Column) -> Column:
    """Poll interval for a cadence; unknown cadence polls at the slowest pace."""
    return clamp_interval(F.coalesce(cadence_seconds, F.lit(MAX_POLL_INTERVAL_SECONDS).cast("long")))


def backoff_interval(current: Column) -> Column:
    """Twice the current interval within bounds.

    The input is bounded before doubling, so no 64-bit value can overflow.
    """
    bound = F.lit(MAX_POLL_INTERVAL_SECONDS).cast("long")
    return clamp_interval(F.greatest(F.least(current, bound), -bound) * 2)


def repeated_backoff(start: Column, times: Column) -> Column:
    """``backoff_interval`` applied ``times`` times, in closed form.

    The first step lands within bounds; from there doubling can only hit the
    upper bound, which seven doublings of the lower bound already exceed.
    """
    later_steps = F.least(times, F.lit(9).cast("long")) - 1
    doubled = clamp_interval(backoff_interval(start) * F.pow(F.lit(2.0), later_steps).cast("long"))
    return F.when(times > 0, doubled).otherwise(start)


def cadence_choice(
    median_published: Column, published_samples: Column, median_inserted: Column, inserted_samples: Column
) -> Column:
    """Published cadence if it has enough samples, else the inserted one."""
    return F.coalesce(
        F.when(published_samples >= MIN_CADENCE_SAMPLES, F.round(median_published).cast("long")),
        F.when(inserted_samples >= MIN_CADENCE_SAMPLES, F.round(median_inserted).cast("long")),
    )


def rescale(value: Column, low: Column, high: Column, out_low: float, out_high: float) -> Column:
    """Linear map of [low, high] to the output range; midpoint if it is flat."""
    share = (value - low) / F.when(high != low, high - low)
    return F.coalesce(out_low + share * (out_high - out_low), F.lit((out_low + out_high) / 2))


def score_band(score: Column, best: Column) -> Column:
    band = F.when(best == 0, F.lit("none"))
    share = score / F.when(best != 0, best)
    for above, name in SCORE_BANDS:
        band = band.when(share > above, F.lit(name))
    return band.otherwise(F.lit("low"))


def bar_share(occurrences: Column, most: Column) -> Column:
    """Percent of the largest count, at least 2 so a bar stays visible."""
    percent = F.when(most > 0, occurrences / most * 100).otherwise(F.lit(0.0))
    return F.greatest(percent, F.lit(2.0))
