"""Each stream, run until drained, against its batch operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import small
from conftest import at
from feedlake import schemas
from feedlake.operators import items as item_ops
from feedlake.operators import polling, titles
from feedlake.operators.replay import event_frames
from feedlake.sources.tables import TableStore
from feedlake.streaming.ingest import ingest_bodies, ingest_entries, recent_duplicates_dropped, store_batch
from feedlake.streaming.state import Snapshots, poll_state_stream, timeline_stream
from feedlake.streaming.tail import live_tail
from feedlake.streaming.words import words_stream
from test_polling import POLLS, STATE, histories, walk
from test_sources import ATOM, RSS


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "check", "store")}


def put(df, folder, n):
    df.coalesce(1).write.mode("append").parquet(f"{folder}")


def test_live_tail_resumes(spark, folders):
    first = small.items(spark, (5, 1, "a", "00:00:00"), (9, 1, "b", "00:00:00"))
    late = small.items(spark, (7, 1, "late commit", "00:00:00"))
    stream = spark.readStream.schema(schemas.ITEMS)
    for batch in (first, late):
        put(batch, folders["in"], 0)
        drain(live_tail(stream.parquet(folders["in"]), folders["out"], folders["check"], available_now=True))
    got = spark.read.parquet(folders["out"])
    assert sorted(r.id for r in got.collect()) == [5, 7, 9]
    assert sorted(got.collect()) == sorted(event_frames(first.unionByName(late)).collect())


def test_ingest_keeps_the_first_of_all_time(spark, folders):
    store = TableStore(spark, folders["store"])
    rng = random.Random(9)
    seen, want, seq = {}, {}, 0
    for _ in range(3):
        rows = []
        for _ in range(30):
            seq += 1
            key = (rng.choice([1, 1, 2]), f"k{rng.randint(0, 25)}")
            rows.append((key[0], seq, key[1], {}))
            seen.setdefault(key, f"t{seq}")
        put(small.entries(spark, *rows), folders["in"], 0)
        stream = spark.readStream.schema(schemas.ENTRIES).parquet(folders["in"])
        drain(ingest_entries(stream, store, folders["check"], available_now=True))
        want |= seen
    stored = store.read("feed_items").orderBy("id").collect()
    assert {(r.feed_id, r.external_id): r.title for r in stored} == want
    assert [r.id for r in stored] == list(range(1, len(want) + 1))
    assert store.read("feed_item_details").count() == len(want)


def test_a_repeated_batch_changes_nothing(spark, folders):
    store = TableStore(spark, folders["store"])
    batches = [small.entries(spark, (1, 1, "a", {}), (1, 2, "b", {})), small.entries(spark, (1, 3, "b", {}), (1, 4, "c", {}))]
    for n, rows in ((0, batches[0]), (1, batches[1]), (1, batches[1])):
        store_batch(rows, n, store)
    assert [(r.id, r.external_id) for r in store.read("feed_items").orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    # The stored rows are a stream of their own.
    drain(live_tail(store.stream("feed_items"), folders["out"], folders["check"], available_now=True))
    assert spark.read.parquet(folders["out"]).count() == 3


def test_bodies(spark, folders):
    store = TableStore(spark, folders["store"])
    bodies = spark.createDataFrame([(1, 1, ATOM), (2, 2, RSS), (1, 3, ATOM)], "feed_id long, body_seq long, body string")
    put(bodies, folders["in"], 0)
    stream = spark.readStream.schema(bodies.schema).parquet(folders["in"])
    drain(ingest_bodies(stream, store, folders["check"], available_now=True))
    rows = store.read("feed_items").orderBy("id").collect()
    assert [(r.id, r.feed_id, r.title) for r in rows] == [
        (1, 1, "Night trains"), (2, 1, "(no title)"), (3, 1, "(no title)"), (4, 2, "One"), (5, 2, "Two"),
    ]


def test_bounded_deduplication(spark, folders):
    rows = small.entries(spark, (1, 1, "a", {}), (1, 2, "a", {}), (2, 3, "a", {}))
    put(rows, folders["in"], 0)
    stream = spark.readStream.schema(schemas.ENTRIES).parquet(folders["in"])
    kept = recent_duplicates_dropped(stream, "published_at", "1 hour")
    drain(kept.writeStream.format("parquet").option("checkpointLocation", folders["check"])
          .trigger(availableNow=True).start(folders["out"]))
    assert sorted(r.feed_id for r in spark.read.parquet(folders["out"]).collect()) == [1, 2]


def test_timeline_stream(spark, folders):
    empty = item_ops.with_detail(small.items(spark), small.details(spark))
    snapshots = Snapshots(spark, folders["out"], empty)
    rng = random.Random(12)
    everything = []
    for n in range(3):
        rows = [(i, 1, f"t{i}", f"2024-01-{i % 27 + 1:02d}T00:00:00") for i in rng.sample(range(60), 25)]
        everything += rows
        put(small.items(spark, *rows, *rows[:3]), folders["in"], n)
        stream = spark.readStream.schema(schemas.ITEMS).parquet(folders["in"])
        drain(timeline_stream(stream, snapshots, folders["check"], limit=10, available_now=True))
    want = sorted({(r[3], r[0]) for r in everything}, reverse=True)[:10]
    got = snapshots.latest().collect()
    assert sorted(r.id for r in got) == sorted(i for _, i in want)


def test_poll_state_stream(spark, folders):
    empty = spark.createDataFrame([], STATE)
    snapshots = Snapshots(spark, folders["out"], empty)
    past = histories(5)
    rows = sorted((r[0], f, r) for f, h in past.items() for r in h)
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        put(spark.createDataFrame([(f, *r) for _, f, r in part], POLLS), folders["in"], 0)
        stream = spark.readStream.schema(spark.createDataFrame([], POLLS).schema).parquet(folders["in"])
        drain(poll_state_stream(stream, snapshots, folders["check"], available_now=True))
    got = small.dicts(snapshots.latest(), "feed_id")
    for f, history in past.items():
        start = {"feed_id": f, "poll_interval_seconds": 300, "failure_count": 0, "last_success_at": None, "last_checked_at": None}
        assert (got[f] if history else None) == (walk(start, history) if history else None)
    batch = polling.poll_state(spark.createDataFrame([(f, *r) for _, f, r in rows], POLLS), empty)
    assert sorted(map(str, batch.collect())) == sorted(map(str, snapshots.latest().collect()))


def test_words_stream(spark, folders):
    rows = [(i, 1, random.Random(i).choice(["alpha beta", "alpha", "gamma"]), f"2024-01-{1 + i // 8:02d}T{i % 8 * 3:02d}:10:00") for i in range(40)]
    items = small.items(spark, *rows)
    closing = small.items(spark, (99, 1, "closing", "2024-03-01T00:00:00"))
    stream = spark.readStream.schema(schemas.ITEMS)
    for part in (items, closing, small.items(spark, (100, 1, "closing", "2024-03-01T01:00:00"))):
        put(part, folders["in"], 0)
        drain(words_stream(stream.parquet(folders["in"]), folders["out"], folders["check"], available_now=True))
    got = spark.read.parquet(folders["out"]).filter("word <> 'closing'")
    want = titles.words_sliding(items, "24 hours", "1 hour").select(*got.columns)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    assert got.agg(F.max("window_end")).first()[0] > at("2024-01-05T00:00:00")


def test_missing_snapshot_is_an_error(spark, tmp_path):
    from feedlake.streaming.state import Snapshots

    snapshots = Snapshots(spark, str(tmp_path), spark.createDataFrame([], "id long"))
    assert snapshots.before(0).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshots.before(3)
