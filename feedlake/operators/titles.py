"""TF-IDF index of title words."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.scores import tf_idf
from feedlake.functions.text import DEFAULT_STOP_WORDS, is_topical, long_words
from feedlake.functions.times import moment
from feedlake.operators.skew import spread_small
from feedlake.operators.words import one_row_per_word

#: The nested index as it is written to JSON, with the legacy spelling.
LEGACY_ENTRY = """
    word STRING, total_occurences BIGINT, document_frequency BIGINT, tf_idf DOUBLE,
    items ARRAY<STRUCT<feed_src_id: BIGINT, occurences: BIGINT>>
"""


def title_tokens(items: DataFrame, stop_words: Iterable[str] = DEFAULT_STOP_WORDS) -> DataFrame:
    """One row per kept word of every title, repeats included."""
    titles = spread_small(items.select("id", "feed_id", "title"), "id")
    item = F.col("id").alias("item_id")
    words = one_row_per_word(titles, long_words(F.col("title")), "word", item, "feed_id")
    return words.filter(is_topical(F.col("word"), stop_words))


def in_last_day(items: DataFrame, now: Column | dt.datetime | None) -> DataFrame:
    return items.filter(F.col("inserted_at") >= moment(now) - F.expr("INTERVAL 24 HOURS"))


def word_counts(items: DataFrame, stop_words: Iterable[str] = DEFAULT_STOP_WORDS) -> DataFrame:
    """Occurrences and titles per (word, feed).

    A title is one row, so its distinct words are known before anything is
    shuffled.  All words are counted as occurrences, the distinct ones as
    titles, in one aggregation that combines on the map side, however frequent
    a word or a feed is; no distinct count ever shuffles item ids.
    """
    titles = spread_small(items.select("id", "feed_id", "title"), "id")
    words = titles.select("feed_id", long_words(F.col("title")).alias("words"))
    lists = words.select(
        "feed_id", F.posexplode(F.array("words", F.array_distinct("words"))).alias("distinct", "words")
    )
    single = one_row_per_word(lists, F.col("words"), "word", "feed_id", "distinct")
    return (
        single.filter(is_topical(F.col("word"), stop_words))
        .groupBy("word", "feed_id")
        .agg(F.sum(1 - F.col("distinct")).alias("occurrences"), F.sum("distinct").alias("documents"))
    )


def title_index(
    items: DataFrame,
    stop_words: Iterable[str] = DEFAULT_STOP_WORDS,
    nested: bool = False,
) -> DataFrame:
    """Score of every title word; ``nested`` adds the per-feed counts.

    The corpus size counts all titles, also those without a kept word.  Titles
    belong to one feed, so title counts per feed add up exactly.
    """
    corpus = items.agg(F.count(F.lit(1))).scalar()
    totals = [
        F.sum("occurrences").alias("total_occurrences"),
        F.sum("documents").alias("document_frequency"),
    ]
    if nested:
        # One entry per feed that uses the word, never one per title.
        entry = F.struct((-F.col("occurrences")).alias("rank"), F.col("feed_id"))
        totals.append(F.sort_array(F.collect_list(entry)).alias("entries"))
    index = word_counts(items, stop_words).groupBy("word").agg(*totals)
    score = tf_idf(F.col("total_occurrences"), F.col("document_frequency"), corpus)
    columns = ["word", "total_occurrences", "document_frequency", score.alias("tf_idf")]
    if nested:

        def source(entry: Column) -> Column:
            return F.struct(entry["feed_id"].alias("feed_src_id"), (-entry["rank"]).alias("occurrences"))

        columns.append(F.transform("entries", source).alias("items"))
    return index.select(*columns).orderBy(F.desc("tf_idf"), F.desc("total_occurrences"), "word")


def title_index_recent(
    items: DataFrame,
    now: Column | dt.datetime | None = None,
    stop_words: Iterable[str] = DEFAULT_STOP_WORDS,
    nested: bool = False,
) -> DataFrame:
    """The index over the last 24 hours: words and corpus size alike."""
    return title_index(in_last_day(items, now), stop_words, nested)


def index_json(index: DataFrame) -> DataFrame:
    """Nested entries as JSON text under the legacy field names."""
    entry = F.struct(
        "word",
        F.col("total_occurrences").alias("total_occurences"),
        "document_frequency",
        "tf_idf",
        F.transform(
            "items",
            lambda s: F.struct(s["feed_src_id"].alias("feed_src_id"), s["occurrences"].alias("occurences")),
        ).alias("items"),
    )
    return index.select("word", F.to_json(entry).alias("json"))


def index_from_json(lines: DataFrame) -> DataFrame:
    """Inverse of :func:`index_json`, back to the regular names."""
    return lines.select(F.from_json("json", LEGACY_ENTRY).alias("e")).select(
        "e.word",
        F.col("e.total_occurences").alias("total_occurrences"),
        "e.document_frequency",
        "e.tf_idf",
        F.transform(
            "e.items",
            lambda s: F.struct(s["feed_src_id"].alias("feed_src_id"), s["occurences"].alias("occurrences")),
        ).alias("items"),
    )


#: Windows that a block of steps holds at least, and the most steps of one window
#: that are counted side by side.
BLOCK_WINDOWS, MOST_STEPS = 16, 32
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _micros(items: DataFrame, interval: str) -> int:
    start = f"{EPOCH} + interval {interval}"
    query = items.sparkSession.sql(f"select ({start} - {EPOCH}) div interval '0.000001' second")
    return query.head()[0]


def words_sliding(
    items: DataFrame,
    length: str = "24 hours",
    slide: str = "1 hour",
    stop_words: Iterable[str] = DEFAULT_STOP_WORDS,
) -> DataFrame:
    """Word counts per sliding window, for batch and streaming items alike.

    Words are counted per ``slide`` step first; only those small counts are
    copied into the windows that contain the step.
    """
    titles = spread_small(items.select("id", "inserted_at", "title"), "id")
    if not items.isStreaming:
        each, whole = _micros(items, slide), _micros(items, length)
        if each > 0 and whole % each == 0 and 1 <= whole // each <= MOST_STEPS:
            return _windows_by_block(titles, each, whole // each, stop_words)
    words = one_row_per_word(titles, long_words(F.col("title")), "word", "inserted_at").filter(
        is_topical(F.col("word"), stop_words)
    )
    steps = words.groupBy(F.window("inserted_at", slide).alias("step"), "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        steps.groupBy(F.window(F.window_time("step"), length, slide).alias("span"), "word")
        .agg(F.sum("n").alias("occurrences"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "word",
            "occurrences",
        )
    )


def _windows_by_block(titles: DataFrame, each: int, per_window: int, stop_words: Iterable[str]) -> DataFrame:
    """Word counts of windows of ``per_window`` steps of ``each`` microseconds.

    A block is a run of window starts.  One aggregation, combined on the map side,
    holds a word's counts of all steps of a block side by side; the windows are
    sums of neighbours.  The first steps of a block also belong to windows that
    start in the block before, so their words count in both.
    """
    zoned = titles.schema["inserted_at"].dataType.typeName() == "timestamp"
    windows = max(BLOCK_WINDOWS, per_window)
    position = "unix_micros(inserted_at)" if zoned else f"(inserted_at - {EPOCH}) div interval '0.000001' second"
    step = F.expr(f"({position} - pmod({position}, {each}L)) div {each}L")
    number = F.col("step") - F.col("block") * windows
    block = ((F.col("step") - F.pmod("step", F.lit(windows))) / windows).cast("long")
    blocks = F.when(F.pmod("step", F.lit(windows)) < per_window - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    texts = titles.filter("inserted_at is not null").select(long_words(F.col("title")).alias("words"), step.alias("step"))
    texts = texts.select("words", "step", block.alias("own"), F.explode(blocks).alias("before"))
    texts = texts.select("words", "step", (F.col("own") - F.col("before")).alias("block")).select("words", "block", number.alias("number"))
    words = one_row_per_word(texts, F.col("words"), "word", "block", "number").filter(is_topical(F.col("word"), stop_words))
    counts = words.groupBy("block", "word").agg(
        *[F.count_if(F.col("number") == i).alias(f"n{i}") for i in range(windows + per_window - 1)]
    )
    spans = [
        F.struct((F.col("block") * windows + i).alias("start"), sum(F.col(f"n{j}") for j in range(i, i + per_window)).alias("n"))
        for i in range(windows)
    ]
    found = counts.select("word", F.explode(F.array(*spans)).alias("span")).filter("span.n > 0")

    def time(steps: str) -> Column:
        if zoned:
            return F.expr(f"timestamp_micros(({steps}) * {each}L)")
        return F.expr(f"{EPOCH} + ({steps}) * make_dt_interval(0, 0, 0, {each / 1e6:.6f})")

    return found.select(
        time("span.start").alias("window_start"),
        time(f"span.start + {per_window}").alias("window_end"),
        "word",
        F.col("span.n").alias("occurrences"),
    )
