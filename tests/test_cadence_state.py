"""Cadence kept up by batches against cadence over all items."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import small
from conftest import at
from feedlake.operators import cadence, polling
from feedlake.sources.cadence_state import BUCKETS, CadenceState
from feedlake.sources.tables import TableStore

START = at("2024-03-01T00:00:00")


def made(spark, seed, n=400):
    """Items of six feeds over four days, many within a minute or at midnight, out of
    order, one feed holding half of them; most have a published date."""
    rng = random.Random(seed)
    rows, published = [], []
    for i in range(1, n + 1):
        moment = START + dt.timedelta(seconds=rng.choice([rng.randint(0, 345_600), 86_400 * rng.randint(0, 4), rng.randint(0, 300)]))
        rows.append((i, rng.choice([1, 1, 1, 2, 3, 4, 5, 6]), "t", moment.isoformat()))
        if rng.random() < 0.7:
            published.append((i, "", "", (moment - dt.timedelta(seconds=rng.randint(0, 200_000))).isoformat()))
    return small.items(spark, *rows), small.details(spark, *published)


def plain(df):
    def number(x):
        return round(x, 6) if isinstance(x, float) else x

    return {r.feed_id: {k: number(v) for k, v in r.asDict().items()} for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_of_time(spark, tmp_path, seed):
    items, details = made(spark, seed)
    feeds = small.feeds(spark, *[(i, {}) for i in range(1, 9)])
    want = plain(cadence.cadence(items, details, feeds))
    state = CadenceState(spark, str(tmp_path / "state"))
    assert all(r["cadence_seconds"] is None for r in plain(state.cadence(feeds)).values())
    for batch in (0, 1, 1):
        state.add(items.filter(F.col("id") % 3 == batch), details, batch)
    last = items.filter(F.col("id") % 3 == 2)
    assert plain(state.cadence(feeds, last, details)) == want
    state.add(last, details, 2)
    assert plain(state.cadence(feeds)) == want
    assert plain(state.cadence(feeds, before_batch=2)) == plain(cadence.cadence(items.filter("id % 3 < 2"), details, feeds))
    assert plain(state.cadence(feeds.filter("id = 3"))) == {3: want[3]}
    with pytest.raises(ValueError, match="later"):
        state.add(last, details, 1)


def test_an_empty_batch_and_rows_without_a_feed(spark, tmp_path):
    items, details = made(spark, 3, 60)
    state = CadenceState(spark, str(tmp_path / "state"))
    state.add(items.limit(0), details.limit(0), 0)
    loose = items.limit(1).withColumn("feed_id", F.lit(None).cast("long"))
    state.add(items.unionByName(loose), details, 1)
    feeds = small.feeds(spark, *[(i, {}) for i in range(1, 9)])
    assert plain(state.cadence(feeds)) == plain(cadence.cadence(items, details, feeds))
    assert state.cadence(feeds.limit(0)).count() == 0


def test_other_feeds_and_days_are_not_rewritten(spark, tmp_path):
    """A batch's day rows follow the batch, and one feed's buckets are all that is read."""
    items, details = made(spark, 4)
    state = CadenceState(spark, str(tmp_path / "state"))
    state.add(items, details, 0)
    state.add(small.items(spark, (1000, 2, "t", "2024-03-02T05:00:00")), details, 1)
    rows = spark.read.parquet(str(tmp_path / "state" / "days")).filter("batch = 1").collect()
    assert [(r.feed_id, r.kind) for r in rows] == [(2, "inserted")]
    plan = state.days([5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(state._buckets(items)) <= min(6, BUCKETS)


def test_a_batch_from_and_to_the_store(spark, tmp_path):
    """The same batch over plain tables and through a store, run twice there."""
    now = at("2024-03-09T00:00:00")
    when = now.isoformat()
    items, details = made(spark, 6, 200)
    feeds = small.feeds(spark, *[(i, {}) for i in range(1, 7)])
    queue = small.queue(spark, *[(i, when, "2024-03-10T00:00:00", f"t{i}", 1) for i in range(1, 7)])
    polls = small.outcomes(spark, (1, 1, "t1", when, "fetched", {}), (2, 2, "t2", when, "fetched", {}), (3, 3, "t3", when, "failed", {}), (4, 4, "no", when, "fetched", {}))
    new = small.entries(
        spark, (1, 10, "new", {}), (1, 11, "e%d" % items.filter("feed_id = 1").first().id, {}), (2, 12, "x", {"published_at": None}), (4, 13, "lost", {})
    ).withColumn("outcome_seq", F.when(F.col("feed_id") == 1, 1).when(F.col("feed_id") == 2, 2).otherwise(4).cast("long"))
    store = TableStore(spark, str(tmp_path / "store"))
    for batch in (0, 1):
        mine = items.filter(F.col("id") % 2 == batch)
        store.append("feed_item_details", details.join(mine.select(F.col("id").alias("feed_item_id")), "feed_item_id", "left_semi"), batch)
        store.append("feed_items", mine, batch)
        store.keys(batch).append(mine, batch)
    store.write_snapshot("feeds", feeds, 1)
    store.write_snapshot("feed_update_queue", queue, 1)
    want = polling.complete_batch(polls, new, feeds, items, details, queue, F.lit(now))
    for _ in range(2):
        done = polling.complete_stored_batch(polls, new, store, F.lit(now), 2)
        assert sorted(map(tuple, done.rejected.select("seq").collect())) == [(4,)]
        for name, rows in (("feeds", want.feeds), ("feed_update_queue", want.queue)):
            assert sorted(map(str, store.snapshot(name).collect())) == sorted(map(str, rows.collect()))
        for name, rows in (("feed_items", items.unionByName(want.items)), ("feed_item_details", details.unionByName(want.details))):
            assert sorted(map(str, store.read(name).collect())) == sorted(map(str, rows.select(*store.read(name).columns).collect()))
    # the next batch knows what this one stored
    feed_one = feeds.filter("id = 1")
    assert plain(store.cadence_state(3).cadence(feed_one)) == plain(cadence.cadence(store.read("feed_items"), store.read("feed_item_details"), feed_one))


def test_a_stored_batch_computes_its_rows_once(spark, tmp_path):
    """Four tables are written from the entries; a column that counts them says once."""
    now = at("2024-03-09T00:00:00")
    when = now.isoformat()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    store = TableStore(spark, str(tmp_path / "store"))
    store.write_snapshot("feeds", small.feeds(spark, (1, {})), 1)
    store.write_snapshot("feed_update_queue", small.queue(spark, (1, when, "2024-03-10T00:00:00", "t1", 1)), 1)
    new = small.entries(spark, *[(1, 10 + i, f"e{i}", {}) for i in range(5)]).withColumn("outcome_seq", F.lit(1).cast("long"))
    polls = small.outcomes(spark, (1, 1, "t1", when, "fetched", {}))
    polling.complete_stored_batch(polls, new.withColumn("title", counted.asNondeterministic()("title")), store, F.lit(now), 2)
    assert store.read("feed_items").count() == 5
    assert seen.value == 5
