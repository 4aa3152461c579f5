from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import small
from conftest import at
from feedlake import schemas
from feedlake.operators import cadence, changes, feeds, ingest, polling

NOW = at("2024-01-10T00:00:00")


def now():
    return F.lit(NOW)


# --- cadence -------------------------------------------------------------------


def brute_median(stamps):
    stamps = sorted(stamps)
    gaps = sorted(g for a, b in zip(stamps, stamps[1:]) if (g := (b - a).total_seconds()) >= 60)
    half = len(gaps) // 2
    middle = [gaps[r - 1] for r in (half, half + 1) if 1 <= r <= len(gaps)]
    return (sum(middle) / len(middle) if middle else None), len(gaps)


def test_cadence_prefers_published(spark):
    items = small.items(spark, (1, 1, "a", "00:00:00"), (2, 1, "b", "00:00:01"), (3, 1, "c", "00:00:02"))
    details = small.details(
        spark, (1, "", "", "2024-01-01T00:00:00"), (2, "", "", "2024-01-01T02:00:00"), (3, "", "", "2024-01-01T04:00:00")
    )
    row = cadence.cadence(items, details, small.feeds(spark, (1, {}))).first()
    assert (row.cadence_seconds, row.inserted_samples, row.published_samples) == (7200, 0, 2)


def test_cadence_against_plain_python(spark):
    """Feed 1 holds most rows; bulk inserts share one time; counts are odd and even."""
    rng = random.Random(2)
    base = at("2024-01-01T00:00:00")
    rows, made = [], {}
    for feed, n in ((1, 400), (2, 9), (3, 10), (4, 1), (5, 2), (6, 3)):
        for _ in range(n):
            t = base + dt.timedelta(microseconds=rng.choice([rng.randint(0, 10**12), rng.randint(0, 10**9)]))
            rows.append((len(rows), feed, "t", t.isoformat()))
            made.setdefault(feed, []).append(t)
    rows.append((len(rows), 2, "t", made[2][0].isoformat()))
    items = small.items(spark, *rows)
    medians = small.dicts(cadence.low_median(items.select("feed_id", F.col("inserted_at").alias("ts")), "m", "n"), "feed_id")
    for feed, stamps in made.items():
        want, n = brute_median(stamps)
        if n:
            assert medians[feed]["n"] == n and medians[feed]["m"] == pytest.approx(want)
        else:
            assert feed not in medians
    all_feeds = small.feeds(spark, *[(f, {}) for f in made], (9, {}))
    rows = small.dicts(cadence.cadence(items, small.details(spark), all_feeds), "feed_id")
    assert rows[9]["cadence_seconds"] is None and rows[4]["cadence_seconds"] is None
    assert small.dicts(cadence.poll_intervals(cadence.cadence(items, small.details(spark), all_feeds)), "feed_id")[9][
        "poll_interval_seconds"
    ] == 6000


def test_gaps_of_exactly_a_minute_and_before_the_epoch(spark):
    stamps = ["1969-12-31T23:58:30", "1969-12-31T23:59:30", "1970-01-01T00:00:29.999999", "1970-01-01T00:01:29.999999"]
    items = small.items(spark, *[(i, 1, "t", s) for i, s in enumerate(stamps)])
    got = sorted(r.gap_seconds for r in cadence.gaps(items.select("feed_id", F.col("inserted_at").alias("ts"))).collect())
    assert got == [60.0, 60.0]


# --- due feeds, requests -------------------------------------------------------------


def test_lease_once_and_again_when_expired(spark):
    f = small.feeds(spark, (1, {}), (2, {"is_enabled": False}), (3, {}), (4, {}), (5, {}))
    q = small.queue(
        spark,
        (1, "2024-01-09T00:00:00", None, None, 0),
        (2, "2024-01-01T00:00:00", None, None, 0),
        (3, "2024-01-11T00:00:00", None, None, 0),
        (4, "2024-01-08T00:00:00", "2024-01-10T00:01:00", "x", 2),
        (5, "2024-01-07T00:00:00", "2024-01-10T00:00:00", "y", 3),
    )
    leased = polling.due_feeds(q, f, now(), "b1").collect()
    assert [(r.feed_id, r.attempts) for r in leased] == [(1, 1), (5, 4)]
    assert len({r.lease_token for r in leased}) == 2 and leased[1].lease_token != "y"
    assert leased[0].lease_expires_at == NOW + dt.timedelta(seconds=300)
    assert [r.feed_id for r in polling.due_feeds(q, f, now(), "b1", limit=1).collect()] == [5]
    after = polling.queue_after_lease(q, polling.due_feeds(q, f, now(), "b1"), now())
    assert polling.due_feeds(after, f, now(), "b2").count() == 0
    assert after.schema.fieldNames() == schemas.QUEUE_COLUMNS


def test_fetch_requests(spark):
    f = small.feeds(spark, (1, {}), (2, {"is_enabled": False}), (3, {}), (4, {}))
    q = small.queue(spark, (1, "2024-01-11T00:00:00", None, None, 1), (3, "2024-01-09T00:00:00", None, None, 1))
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,), (1,)], "feed_id long")
    answers = polling.fetch_requests(asked, f, q, now())
    got = {r.feed_id: (r.sendable, r.status, r.due_at) for r in answers.collect()}
    assert got == {
        1: (True, "queued", NOW),
        2: (False, "paused", None),
        3: (True, "queued", at("2024-01-09T00:00:00")),
        4: (True, "queued", NOW),
        9: (True, "not_found", None),
    }
    counts = polling.request_counts(answers).first()
    assert (counts.queued, counts.rejected) == (3, 2)
    after = {r.feed_id: (r.due_at, r.attempts) for r in polling.apply_requests(q, answers, now()).collect()}
    assert after == {1: (NOW, 1), 3: (at("2024-01-09T00:00:00"), 1), 4: (NOW, 0)}


def test_fetch_plan_and_outcomes(spark):
    f = small.feeds(spark, (1, {"etag": '"a"'}), (2, {"etag": '"b"', "last_modified": "Mon"}), (3, {}))
    q = small.queue(spark, *[(i, "2024-01-01T00:00:00", None, None, 0) for i in (1, 2, 3)])
    plan = small.dicts(polling.fetch_plan(polling.due_feeds(q, f, now(), "b")), "feed_id")
    assert plan[1]["headers"] == {"If-None-Match": '"a"'}
    assert plan[2]["headers"] == {"If-None-Match": '"b"', "If-Modified-Since": "Mon"}
    assert plan[3]["headers"] == {}
    rows = [(304, None), (200, True), (200, False), (404, True), (503, None), (None, None), (301, True)]
    got = polling.fetch_outcomes(spark.createDataFrame(rows, "status int, parsed_ok boolean")).collect()
    assert [r.outcome for r in got] == ["not_modified", "fetched", "failed", "failed", "failed", "failed", "fetched"]


# --- completion ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def completion(spark):
    f = small.feeds(
        spark,
        (1, {"title": "old", "failure_count": 2}),
        (2, {"failure_count": 1, "etag": "keep"}),
        (3, {"poll_interval_seconds": 4000}),
        (4, {}),
        (5, {}),
    )
    q = small.queue(spark, *[(i, "2024-01-09T00:00:00", "2024-01-10T01:00:00", f"t{i}", 3) for i in (1, 2, 3, 4)],
                    (5, "2024-01-09T00:00:00", "2024-01-10T00:00:00", "t5", 3))
    checked = "2024-01-10T00:00:00"
    o = small.outcomes(
        spark,
        (1, 10, "t1", checked, "fetched", {"title": "new", "etag": "e1"}),
        (1, 11, "t1", checked, "failed", {}),
        (2, 12, "t2", checked, "not_modified", {}),
        (3, 13, "t3", checked, "failed", {}),
        (4, 14, "t4x", checked, "fetched", {}),
        (5, 15, "t5", checked, "fetched", {}),
    )
    stored = small.items(spark, (1, 1, "t", "2024-01-09T00:00:00"), (2, 1, "t", "2024-01-09T01:00:00"))
    e = small.entries(
        spark,
        (1, 100, "e1", {}),
        (1, 101, "new", {"published_at": at("2024-01-09T00:00:00")}),
        (1, 102, "new", {"title": "later copy"}),
        (1, 103, "bare", {"summary": None, "content": None, "author": None, "published_at": None}),
        (4, 104, "lost", {}),
    ).withColumn("outcome_seq", F.when(F.col("feed_id") == 1, F.lit(10).cast("long")).otherwise(F.lit(14).cast("long")))
    return polling.complete_batch(o, e, f, stored, small.details(spark), q, now())


def test_completion_accepts_once(completion):
    assert sorted((r.feed_id, r.seq) for r in completion.accepted.collect()) == [(1, 10), (2, 12), (3, 13)]
    assert sorted(r.seq for r in completion.rejected.collect()) == [11, 14, 15]


def test_completion_stores_new_entries(completion):
    rows = completion.items.orderBy("id").collect()
    assert [(r.id, r.external_id, r.title, r.inserted_at) for r in rows] == [
        (3, "new", "t101", NOW), (4, "bare", "t103", NOW),
    ]
    assert [(r.id, r.feed_item_id) for r in completion.details.collect()] == [(3, 3)]


def test_completion_updates_feeds(completion):
    rows = small.dicts(completion.feeds, "id")
    # The new rows are part of the cadence: gaps of one hour and 23 hours.
    assert rows[1]["poll_interval_seconds"] == 6000
    assert (rows[1]["title"], rows[1]["etag"], rows[1]["failure_count"]) == ("new", "e1", 0)
    assert rows[1]["last_inserted_at"] == rows[1]["last_success_at"] == NOW
    assert (rows[2]["etag"], rows[2]["failure_count"], rows[2]["poll_interval_seconds"]) == ("keep", 0, 600)
    assert rows[2]["last_inserted_at"] is None and rows[2]["last_success_at"] == NOW
    assert (rows[3]["failure_count"], rows[3]["poll_interval_seconds"], rows[3]["last_success_at"]) == (1, 6000, None)
    assert rows[3]["last_checked_at"] == NOW
    assert rows[4]["last_checked_at"] is None and rows[4]["poll_interval_seconds"] == 300


def test_completion_reschedules(completion):
    rows = small.dicts(completion.queue, "feed_id")
    assert (rows[1]["due_at"], rows[1]["attempts"], rows[1]["lease_token"]) == (NOW + dt.timedelta(seconds=6000), 0, None)
    assert (rows[2]["due_at"], rows[2]["attempts"]) == (NOW + dt.timedelta(seconds=600), 0)
    assert (rows[3]["attempts"], rows[3]["lease_expires_at"]) == (3, None)
    assert (rows[4]["lease_token"], rows[4]["due_at"]) == ("t4", at("2024-01-09T00:00:00"))


# --- poll state ------------------------------------------------------------------------------


def walk(state, history):
    for _, stamp, outcome, resolved in history:
        if outcome == "fetched":
            state["poll_interval_seconds"] = max(60, min(6000, resolved))
        else:
            state["poll_interval_seconds"] = max(60, min(6000, 2 * state["poll_interval_seconds"]))
        state["failure_count"] = state["failure_count"] + 1 if outcome == "failed" else 0
        if outcome != "failed":
            state["last_success_at"] = stamp
        state["last_checked_at"] = stamp
    return state


def histories(seed):
    rng = random.Random(seed)
    out, seq = {}, 0
    for feed in range(1, 13):
        n = 300 if feed == 1 else rng.randint(0, 12)
        kinds = ["failed"] if feed == 2 else ["not_modified", "failed"] if feed == 3 else ["fetched", "not_modified", "failed"]
        rows = []
        for _ in range(n):
            seq += 1
            rows.append((seq, NOW + dt.timedelta(seconds=seq), rng.choice(kinds), rng.choice([10, 60, 100, 1700, 9999])))
        out[feed] = rows
    return out


STATE = "feed_id long, poll_interval_seconds long, failure_count long, last_success_at timestamp, last_checked_at timestamp"
POLLS = "feed_id long, seq long, checked_at timestamp, outcome string, resolved_interval long"


@pytest.mark.parametrize("seed", [1, 2])
def test_poll_state_against_a_walk(spark, seed):
    rng = random.Random(seed)
    start = {f: {"feed_id": f, "poll_interval_seconds": rng.choice([5, 300, 5000]), "failure_count": rng.randint(0, 3),
                 "last_success_at": None, "last_checked_at": None} for f in range(1, 13)}
    initial = spark.createDataFrame([tuple(s.values()) for s in start.values()], STATE)
    past = histories(seed)
    rows = [(f, *r) for f, h in past.items() for r in h]
    rng.shuffle(rows)
    got = small.dicts(polling.poll_state(spark.createDataFrame(rows, POLLS), initial), "feed_id")
    assert got == {f: walk(dict(s), past[f]) for f, s in start.items()}


# --- changes -------------------------------------------------------------------------------------


def test_changes(spark):
    f = small.feeds(spark, (1, {}), (2, {"is_enabled": False}))
    items = small.items(spark, (1, 1, "a", "00:00:00"), (2, 2, "b", "00:00:00"))
    details = small.details(spark, (1, "s", "c", "2024-01-01T00:00:00"), (2, "s", "c", "2024-01-01T00:00:00"))
    q = small.queue(spark, (1, "2024-01-12T00:00:00", None, None, 0), (2, "2024-01-12T00:00:00", None, None, 0))
    after = changes.update_items(items, spark.createDataFrame([(2, "new", None), (7, "x", "y")], "id long, title string, url string"))
    assert {(r.id, r.title, r.url) for r in after.collect()} == {(1, "a", "https://f.example/i1"), (2, "new", "https://f.example/i2")}
    asked = spark.createDataFrame([(2,), (7,)], "id long")
    assert [r.id for r in changes.unknown_keys(items, asked, "id").collect()] == [7]
    kept, kept_details = changes.delete_items(items, details, asked)
    assert [r.id for r in kept.collect()] == [1] and [r.id for r in kept_details.collect()] == [1]
    left = changes.delete_feeds(f, items, details, q, spark.createDataFrame([(1,)], "id long"))
    assert [left["feeds"].first().id, left["feed_items"].first().id] == [2, 2]
    assert [r.feed_item_id for r in left["feed_item_details"].collect()] == [2]
    assert [r.feed_id for r in left["feed_update_queue"].collect()] == [2]
    flags = spark.createDataFrame([(1, False), (2, True)], "id long, is_enabled boolean")
    assert {(r.id, r.is_enabled) for r in feeds.set_enabled(f, flags).collect()} == {(1, False), (2, True)}
    woken = {r.feed_id: r.due_at for r in feeds.wake_enabled(q, flags, now()).collect()}
    assert woken == {1: at("2024-01-12T00:00:00"), 2: NOW}


def test_upsert_and_seed_feeds(spark):
    f = small.feeds(spark, (4, {"title": "kept"}))
    asked = [(" https://b.example ", 2), ("https://a.example", 1), ("https://b.example", 3), ("  ", 0), ("https://f.example/4", 5)]
    after = feeds.upsert_feeds(spark.createDataFrame(asked, "url string, seq long"), f)
    assert [(r.id, r.url, r.title, r.poll_interval_seconds, r.is_enabled) for r in after.orderBy("id").collect()] == [
        (4, "https://f.example/4", "kept", 300, True),
        (5, "https://a.example", None, 300, True),
        (6, "https://b.example", None, 300, True),
    ]
    seeded = feeds.seed_default_feeds(f)
    assert seeded.count() == 1 + len(feeds.DEFAULT_FEED_URLS)
    assert feeds.seed_default_feeds(seeded).count() == seeded.count()


def test_insert_twice(spark):
    stored = small.items(spark, (5, 1, "x", "00:00:00"))
    e = small.entries(spark, (1, 1, "e5", {}), (2, 2, "e5", {}), (1, 3, "n", {"published_at": None}), (1, 4, "n", {}))
    rows = ingest.insert_items(e, stored, NOW).orderBy("id").collect()
    assert [(r.id, r.feed_id, r.external_id) for r in rows] == [(6, 2, "e5"), (7, 1, "n")]
    dates = {r.feed_item_id: r.published_at for r in ingest.insert_details(e, stored, NOW).collect()}
    assert dates == {6: at("2024-01-01T00:00:00"), 7: NOW}
    again = ingest.insert_items(e, stored.unionByName(ingest.insert_items(e, stored, NOW)), NOW)
    assert again.count() == 0
    assert small.dicts(ingest.ingest_summary(ingest.insert_items(e, stored, NOW)), "feed_id")[1]["inserted_items"] == 1


def test_lease_bounds(spark):
    from feedlake.operators import polling

    frame = spark.createDataFrame([], "feed_id long")
    for given in ({"limit": 0}, {"limit": 101}, {"lease_seconds": 0}, {"lease_seconds": 3601}):
        with pytest.raises(ValueError):
            polling.due_feeds(frame, frame, F.current_timestamp(), "b", **given)
