from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

import small
from feedlake.operators import metrics, replay, search
from feedlake.sources.search_index import SearchIndex


def test_cursors(spark):
    rows = [(1, "5", 9, "2"), (2, "abc", 9, "2"), (3, None, None, "42"), (4, " 7", None, "x"), (5, "+6", 1, None)]
    c = spark.createDataFrame(rows, "consumer_id long, header_id string, query_id long, stored_cursor string")
    assert [r.cursor for r in replay.request_cursors(c).orderBy("consumer_id").collect()] == [5, 9, None, None, 6]
    shown = spark.createDataFrame([(1, 10), (1, 15)], "consumer_id long, id long")
    got = {r.consumer_id: r.resume_cursor for r in replay.resume_cursors(c, shown).collect()}
    assert got == {1: 15, 2: 2, 3: 42, 4: None, 5: None}


def test_markers_against_plain_python(spark):
    ids = random.Random(4).sample(range(1, 400), 90)
    items = small.items(spark, *[(i, 1, "t", "00:00:00") for i in ids])
    cursors = [None, 0, 100, 395, 399, 1000, sorted(ids)[-10], sorted(ids)[-11]]
    c = spark.createDataFrame(list(enumerate(cursors)), "consumer_id long, cursor long")
    windows = replay.replay_windows(c, items, 10)
    markers = small.dicts(replay.replay_markers(windows), "consumer_id")
    for n, cursor in enumerate(cursors):
        missed = sorted(i for i in ids if cursor is not None and i > cursor)
        kept = missed[-10:]
        row = markers[n]
        assert (row["replayed"], row["limited"]) == (len(kept), len(missed) > 10)
        assert row["last_event_id"] == (kept[-1] if kept else cursor)
        assert windows.filter(F.col("consumer_id") == n).first().missed == kept
    lag = small.dicts(replay.consumer_lag(c, items, buffer=20, block=64), "consumer_id")
    for n, cursor in enumerate(cursors):
        if cursor is None:
            assert n not in lag
        else:
            behind = sum(i > cursor for i in ids)
            assert (lag[n]["behind"], lag[n]["dropped"]) == (behind, max(behind - 20, 0))


def test_marker_text(spark):
    texts = ['{"replayed":500,"limited":true,"last_event_id":123}', "{}", '{"replayed":"x","limited":1}', "nonsense"]
    df = spark.createDataFrame([(t,) for t in texts], "data string")
    got = [tuple(r.m) for r in df.select(replay.read_marker(F.col("data")).alias("m")).collect()]
    assert got == [(500, True, 123), (0, False, None), (0, False, None), (0, False, None)]


def test_frames_round_trip(spark):
    items = small.items(spark, (3, 1, 'say "hø"', "2024-01-01T00:00:07.250000"))
    frame = replay.event_frames(items).first()
    assert (frame.id, frame.event) == (3, "feed_item")
    assert json.loads(frame.data)["inserted_at"] == "2024-01-01T00:00:07.250Z"
    assert replay.items_from_frames(replay.event_frames(items)).collect() == items.collect()


def test_session(spark):
    stored = small.items(spark, *[(i, 1, "t", "00:00:00") for i in range(1, 7)])
    live = small.items(spark, (7, 1, "t", "00:00:00"))
    rows = replay.replay_session(stored, live, 1, 2).orderBy("phase", "id").collect()
    assert [(r.phase, r.id, r.event) for r in rows] == [
        (0, 5, "feed_item"), (0, 6, "feed_item"), (1, None, "replay_done"), (2, 7, "feed_item"),
    ]
    assert json.loads(rows[2].data) == {"replayed": 2, "limited": True, "last_event_id": 6}
    rows = replay.replay_session(stored, live, 6).filter("phase = 1").collect()
    assert json.loads(rows[0].data) == {"replayed": 0, "limited": False, "last_event_id": 6}


def test_search_batch_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    titles = [" ".join(rng.choices(vocabulary, k=6)) + " common" for _ in range(80)]
    items = small.items(spark, *[(i, 1, t, "00:00:00") for i, t in enumerate(titles)])
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 3))) for _ in range(20)] + ["common", "w1 absent", "", "f.example"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    index = SearchIndex(spark, str(tmp_path))
    index.add(items, None, None)
    got = sorted((r.query_id, r.item_id) for r in search.search_batch(index, queries).collect())
    want = [
        (q, i)
        for q, text in enumerate(texts)
        for i, title in enumerate(titles)
        if text and set(text.replace(".", " ").split()) <= {*title.split(), "https", "f", "example", f"i{i}", "f.example"}
    ]
    assert got == sorted(want)


def test_log_percentiles_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(rng.choice("AB"), int(rng.expovariate(0.01))) for _ in range(500)]
    out = metrics.log_metrics(spark.createDataFrame(rows, "route string, duration_ms long"), ["route"])
    for r in out.collect():
        values = sorted(v for k, v in rows if k == r.route)
        assert (r.requests, r.total_ms) == (len(values), sum(values))
        for p, got in ((50, r.p50_ms), (90, r.p90_ms), (99, r.p99_ms)):
            assert got == values[-(-len(values) * p // 100) - 1]
