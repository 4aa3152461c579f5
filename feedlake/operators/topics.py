"""Topic page: display scale of each word and its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.links import topic_link
from feedlake.functions.scores import bar_share, rescale, score_band
from feedlake.functions.text import feed_label

# Smallest and largest font size of a topic.
FONT_RANGE = (0.75, 3.0)


def topic_scaled(index: DataFrame) -> DataFrame:
    """Font size and score band of every indexed word."""
    bounds = index.agg(F.struct(F.min("tf_idf").alias("low"), F.max("tf_idf").alias("high")))
    with_bounds = index.select("word", "tf_idf", bounds.scalar().alias("b"))
    score = F.col("tf_idf")
    return with_bounds.select(
        "word",
        "tf_idf",
        rescale(score, F.col("b.low"), F.col("b.high"), *FONT_RANGE).alias("font_size"),
        score_band(score, F.col("b.high")).alias("band"),
    )


def topic_sources(counts: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per word and feed: display name, bar length and link to its news.

    ``counts`` holds one row per (word, feed), see ``titles.word_counts``.
    """
    names = feeds.select(F.col("id").alias("feed_id"), feed_label(F.col("title"), F.col("url")).alias("name"))
    most = F.max("occurrences").over(Window.partitionBy("word"))
    unknown = F.concat(F.lit("Source #"), F.col("feed_id").cast("string"))
    return (
        counts.select("word", "feed_id", "occurrences", most.alias("most"))
        .join(names, "feed_id", "left")
        .select(
            "word",
            "feed_id",
            F.coalesce("name", unknown).alias("source_name"),
            "occurrences",
            bar_share(F.col("occurrences"), F.col("most")).alias("bar_percent"),
            topic_link(F.col("word"), F.col("feed_id")).alias("link"),
        )
    )
