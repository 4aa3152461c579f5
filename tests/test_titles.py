from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import small
import pytest
from conftest import at
from feedlake.functions.text import DEFAULT_STOP_WORDS
from feedlake.operators import titles, topics
from pyspark.sql import functions as F


def index(spark, *texts, **kw):
    items = small.items(spark, *[(i, f, t, "00:00:00") for i, (f, t) in enumerate(texts)])
    return titles.title_index(items, **kw)


def test_scores(spark):
    rows = index(spark, (1, "Alpha Alpha"), (1, "Alpha"), (1, "Alpha Beta Beta")).collect()
    assert [r.word for r in rows] == ["beta", "alpha"]
    assert (rows[0].total_occurrences, rows[0].document_frequency) == (2, 1)
    assert rows[0].tf_idf > 0
    assert (rows[1].total_occurrences, rows[1].document_frequency, rows[1].tf_idf) == (4, 3, 0.0)


def test_stop_words(spark):
    words = {r.word for r in index(spark, (1, "The quick and brown fox på norsk og engelsk med det som er vanlig")).collect()}
    assert {"quick", "norsk"} <= words
    assert not words & {"the", "and", "på", "og", "med", "det", "som", "er"}


def test_own_stop_words(spark):
    words = {r.word for r in index(spark, (1, "the quick fox"), stop_words=["fox"]).collect()}
    assert words == {"the", "quick"}
    assert {r.word for r in index(spark, (1, "the x"), stop_words=[]).collect()} == {"the"}


def test_against_plain_python(spark):
    rng = random.Random(11)
    vocabulary = ["alpha", "Beta", "ÆRE", "the", "x", "blå", "gamma-delta", "é", "nøtt"]
    texts = [(rng.randint(1, 4), " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for _ in range(60)]
    total, df, per_feed = Counter(), Counter(), {}
    for feed, title in texts:
        kept = [w.lower() for w in re.split("[^a-zA-ZæøåÆØÅ]+", title)]
        kept = [w for w in kept if len(w) >= 2 and w not in DEFAULT_STOP_WORDS]
        total.update(kept)
        df.update(set(kept))
        per_feed.setdefault(feed, Counter()).update(kept)
    rows = index(spark, *texts, nested=True).collect()
    assert {r.word for r in rows} == set(total)
    order = [(-r.tf_idf, -r.total_occurrences, r.word) for r in rows]
    assert order == sorted(order)
    for r in rows:
        assert (r.total_occurrences, r.document_frequency) == (total[r.word], df[r.word])
        assert math.isclose(r.tf_idf, math.log(1 + total[r.word]) * math.log(len(texts) / df[r.word]), abs_tol=1e-12)
        sources = sorted(((-c[r.word], f) for f, c in per_feed.items() if c[r.word]))
        assert [(s.feed_src_id, s.occurrences) for s in r["items"]] == [(f, -n) for n, f in sources]


def test_recent(spark):
    items = small.items(
        spark,
        (1, 1, "stale technology", "2024-01-01T00:00:00"),
        (2, 1, "fresh technology", "2024-01-03T00:00:00"),
        (3, 1, "edge", "2024-01-02T12:00:00"),
    )
    rows = small.dicts(titles.title_index_recent(items, at("2024-01-03T12:00:00")), "word")
    assert set(rows) == {"fresh", "technology", "edge"}
    assert rows["technology"]["total_occurrences"] == 1
    assert math.isclose(rows["edge"]["tf_idf"], math.log(2) * math.log(2))


def test_json_names_and_round_trip(spark):
    nested = index(spark, (7, "alpha alpha"), (8, "beta"), nested=True)
    written = titles.index_json(nested)
    entry = json.loads(written.filter("word = 'alpha'").first().json)
    assert set(entry) == {"word", "total_occurences", "document_frequency", "tf_idf", "items"}
    assert entry["items"] == [{"feed_src_id": 7, "occurences": 2}]
    back = titles.index_from_json(written)
    assert sorted(map(str, back.collect())) == sorted(map(str, nested.collect()))


def test_topics(spark):
    items = small.items(spark, (1, 1, "alpha beta alpha", "00:00:00"), (2, 2, "alpha", "00:00:00"), (3, 3, "zeta", "00:00:00"))
    sizes = small.dicts(topics.topic_scaled(titles.title_index(items)), "word")
    assert max(r["font_size"] for r in sizes.values()) == 3.0
    assert min(r["font_size"] for r in sizes.values()) == 0.75
    feeds = small.feeds(spark, (1, {"title": "One"}), (2, {}))
    rows = {(r.word, r.feed_id): r for r in topics.topic_sources(titles.word_counts(items), feeds).collect()}
    assert rows["alpha", 1].source_name == "One" and rows["alpha", 1].bar_percent == 100.0
    assert rows["alpha", 2].source_name == "https://f.example/2" and rows["alpha", 2].bar_percent == 50.0
    assert rows["zeta", 3].source_name == "Source #3"
    assert rows["zeta", 3].link == "/news?q=zeta&source_id=3"


def test_hot_word_and_feed_combine_before_the_shuffle(spark):
    """A third of all rows in one feed: the shuffle carries one row per word and feed."""
    items = small.items(spark, *[(i, 1 if i % 3 == 0 else i, "hot topic", "00:00:00") for i in range(300)])
    plan = titles.word_counts(items)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange hashpartitioning(word")[1]
    assert "partial_sum" in before_shuffle
    counts = {(r.word, r.feed_id): r.occurrences for r in titles.word_counts(items).collect()}
    assert counts["hot", 1] == 101


def test_words_sliding(spark):
    items = small.items(spark, (1, 1, "alpha", "2024-01-01T00:30:00"), (2, 1, "alpha beta", "2024-01-01T02:30:00"))
    rows = titles.words_sliding(items, "3 hours", "1 hour").collect()
    got = {(r.window_start.hour, r.window_start.day, r.word): r.occurrences for r in rows}
    assert got[(0, 1, "alpha")] == 2
    assert got[(22, 31, "alpha")] == 1 and got[(2, 1, "alpha")] == 1
    assert {k for k in got if k[2] == "beta"} == {(0, 1, "beta"), (1, 1, "beta"), (2, 1, "beta")}


@pytest.mark.parametrize("length, slide, kind", [("24 hours", "6 hours", "timestamp_ntz"), ("3 hours", "1 hour", "timestamp"), ("90 seconds", "90 seconds", "timestamp_ntz")])
def test_words_sliding_across_blocks(spark, length, slide, kind):
    """One shuffle of texts' words, and the windows that Spark's own function deals out."""
    times = [None, *(f"{d} {h}:00:01.5" for d in ("1969-12-31", "1970-01-01", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-04") for h in ("00", "05", "06", "23"))]
    rows = [(i, t, f"river river stone{i % 3} x") for i, t in enumerate(times)] + [(99, "2024-03-01 01:00:00", None)]
    items = spark.createDataFrame(rows, "id long, inserted_at string, title string").withColumn("inserted_at", F.col("inserted_at").cast(kind))
    got = titles.words_sliding(items, length, slide)
    plain = items.filter("title is not null").select(F.explode(F.array(F.lit("river"), F.lit("river"))).alias("word"), "inserted_at")
    want = plain.groupBy(F.window("inserted_at", length, slide).alias("w")).count().select("w.start", "w.end", F.lit("river"), "count")
    assert sorted(map(tuple, got.filter("word = 'river'").collect())) == sorted(map(tuple, want.collect()))
    assert [f.dataType.typeName() for f in got.schema][:2] == [kind] * 2
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
