"""The key store against plain sets, and how little of it a batch reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import small
from feedlake.operators import ingest
from feedlake.sources import key_store
from feedlake.sources.key_store import KeyStore
from feedlake.sources.tables import TableStore
from feedlake.streaming.ingest import store_batch, with_seq

KEYS = "feed_id long, external_id string"


def written(spark):
    """Bytes that shuffles have written since the session began."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def many(spark, n, start=0):
    rows = spark.range(start, start + n).select((F.col("id") % 97).alias("feed_id"), F.concat(F.lit("e"), "id").alias("external_id"), "id")
    return rows


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(key_store, "BUCKET_KEYS", 64)


def test_unknown_keys_are_exact(spark, tmp_path, small_buckets):
    rng = random.Random(4)
    store, held = KeyStore(spark, str(tmp_path)), set()
    assert store.max_id() == 0
    for batch in range(6):
        rows = [(rng.randrange(5), f"k{rng.randrange(400)}") for _ in range(150)]
        rows += [(None, "x"), (1, None), (1, "")]
        rows = list(dict.fromkeys(rows))
        keys = spark.createDataFrame(rows, KEYS)
        got = {tuple(r) for r in store.unknown(keys).select("feed_id", "external_id").collect()}
        # a null part equals nothing
        assert got == {k for k in rows if k not in held or None in k}
        fresh = [k for k in rows if k not in held]
        store.append(spark.createDataFrame([(*k, batch * 1000 + i) for i, k in enumerate(fresh)], KEYS + ", id long"), batch)
        held.update(fresh)
        assert store.max_id() == batch * 1000 + len(fresh) - 1
        if batch == 3:
            store.compacted(2)
            assert [(r.first, r.last) for r in store.runs()] == [(0, 2), (3, 3)]
        if batch == 5:
            store.append(spark.createDataFrame([], KEYS + ", id long"), 6)
    assert [r.last for r in store.runs(before_batch=4)] == [2, 3]


def test_false_alarms_are_rare_and_others_never_missed(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path))
    store.append(many(spark, 20_000), 0)
    assert store.suspects(many(spark, 20_000).drop("id")).count() == 20_000
    strangers = store.suspects(many(spark, 20_000, start=50_000).drop("id")).count()
    assert strangers < 200


def test_work_follows_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_store, "BUCKET_KEYS", 2048)
    few, lots = KeyStore(spark, str(tmp_path / "few")), KeyStore(spark, str(tmp_path / "lots"))
    few.append(many(spark, 1000), 0)
    lots.append(many(spark, 200_000), 0)
    batch = small.entries(spark, *[(i % 97, i, f"e{i}", {}) for i in range(980, 1030)])

    def shuffled(store):
        before = written(spark)
        got = ingest.number_new(batch, store).collect()
        return written(spark) - before, {r.external_id for r in got}

    small_bytes, new = shuffled(few)
    assert new == {f"e{i}" for i in range(1000, 1030)}
    large_bytes, new = shuffled(lots)
    assert new == set()
    # 200 times the history; only hits, at most the batch itself, add to it
    assert large_bytes < 2 * small_bytes + 20_000
    # and only some of the buckets were read
    probes = {r.bucket for r in lots.suspects(batch.select("feed_id", "external_id")).select("bucket").distinct().collect()}
    assert len(probes) <= 50 < lots.runs()[0].buckets


def test_a_store_without_keys_gets_them(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store_batch(small.entries(spark, (1, 1, "a", {}), (1, 2, "b", {})), 0, store)
    from feedlake.sources.tables import delete

    delete(spark, store.path("item_keys"))
    store_batch(small.entries(spark, (1, 3, "b", {}), (1, 4, "c", {})), 1, store)
    assert [(r.id, r.external_id) for r in store.read("feed_items").orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_compaction_while_streaming(spark, tmp_path, monkeypatch):
    from feedlake.streaming import ingest as stream

    monkeypatch.setattr(stream, "COMPACT_EVERY", 2)
    store = TableStore(spark, str(tmp_path))
    for n in range(5):
        rows = small.entries(spark, *[(1, 10 * n + i, f"k{n + i}", {}) for i in range(3)])
        store_batch(rows, n, store)
        store_batch(rows, n, store)
    assert [r.external_id for r in store.read("feed_items").orderBy("id").collect()] == [f"k{i}" for i in range(7)]
    assert [(r.first, r.last) for r in store.keys().runs()] == [(0, 2), (3, 3), (4, 4)]


def test_entries_of_long_bodies_keep_their_own_numbers(spark):
    rows = spark.createDataFrame([(0, 0), (0, 3 << 20), (1, 0), (2, 5)], "body_seq long, pos int")
    got = [r.seq for r in with_seq(rows).collect()]
    assert got == sorted(set(got))
