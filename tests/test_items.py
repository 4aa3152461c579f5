from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import small
from conftest import at
from feedlake.operators import items as ops
from feedlake.sources.timeline_blocks import TimelineBlocks


@pytest.fixture(scope="module")
def tables(spark):
    feeds = small.feeds(spark, (1, {"title": "Timetable blog"}), (2, {}))
    items = small.items(
        spark,
        (1, 1, "Harbour ferries", "2024-01-01T00:00:00"),
        (2, 2, "Orchard prices", "2024-01-02T00:00:00"),
        (3, 1, "Third", "2024-01-01T12:00:00"),
        (4, 9, "No such feed", "2024-01-05T00:00:00"),
    )
    details = small.details(
        spark,
        (1, "Timetable changes", "", "2030-01-01T00:00:00"),
        (2, "Pruning advice", "", "2024-01-01T18:00:00"),
    )
    return items, details, feeds


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(params=[None, 1, 8, 4096], ids=["no blocks", "blocks of 1", "blocks of 8", "one block"])
def block_ids(request):
    return request.param


def blocks_of(items, details, block_ids, tmp_path):
    """Blocks as two batches leave them, the first of them written twice."""
    if block_ids is None:
        return None
    blocks = TimelineBlocks(items.sparkSession, str(tmp_path / "blocks"), block_ids)
    for batch in (0, 0, 1):
        blocks.add(items.filter(F.col("id") % 2 == batch), details, batch)
    return blocks


def test_timeline_order_and_future_dates(tables, block_ids, tmp_path):
    items, details, feeds = tables
    blocks = blocks_of(items, details, block_ids, tmp_path)
    for limit in (None, 3, 20_000):
        rows = ops.timeline(items, details, feeds, limit=limit, blocks=blocks).collect()
        # Item 1 claims 2030 but counts as inserted; item 2 was published earlier than inserted.
        assert [r.id for r in rows] == [2, 3, 1]
        assert rows[2].published_at == at("2030-01-01T00:00:00")
        assert rows[1].summary is None
    assert ids(ops.timeline(items, details, feeds, limit=2, blocks=blocks)) == [2, 3]
    assert ids(ops.timeline(items, details, feeds, limit=0, blocks=blocks)) == []
    assert ids(ops.timeline(items.limit(0), details, feeds, limit=2, blocks=blocks)) == []


def test_timeline_against_plain_python(spark, block_ids, tmp_path):
    """Late and early published dates, items without details, limits on both sides of the cutoff."""
    rng = random.Random(21)
    day = at("2024-01-01T00:00:00")
    rows = [(i, rng.choice([1, 1, 2, 9]), "t", (day + dt.timedelta(minutes=rng.randint(0, 900))).isoformat()) for i in range(150)]
    published = {
        r[0]: at(r[3]) + dt.timedelta(minutes=rng.choice([-5000, -300, -20, 0, 400])) for r in rows if rng.random() < 0.7
    }
    items = small.items(spark, *rows)
    details = small.details(spark, *[(i, "", "", p.isoformat()) for i, p in published.items()])
    feeds = small.feeds(spark, (1, {}), (2, {}))
    order = sorted(((min(published.get(i, at(t)), at(t)), i, f) for i, f, _, t in rows if f != 9), reverse=True)
    blocks = blocks_of(items, details, block_ids, tmp_path)
    for limit in (1, 7, 60, 500):
        assert ids(ops.timeline(items, details, feeds, limit=limit, blocks=blocks)) == [i for _, i, _ in order][:limit]
        assert ids(ops.timeline(items, details, feeds, limit=limit, feed_id=2, blocks=blocks)) == [i for _, i, f in order if f == 2][:limit]


def test_blocks_leave_old_items_unread(spark, tmp_path):
    """Of 4,000 items in order, a list of 20 is ranked from the last blocks alone."""
    rows = spark.range(1, 4001).selectExpr(
        "id", "1L as feed_id", "cast(id as string) as external_id", "'t' as title", "'u' as url",
        "timestamp_seconds(1700000000 + id * 60) as inserted_at",
    )
    rows.write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    details = items.selectExpr("id", "id as feed_item_id", "'s' as summary", "'c' as content", "'a' as author", "inserted_at as published_at")
    blocks = TimelineBlocks(spark, str(tmp_path / "blocks"), 50)
    blocks.add(items, details)
    left = []

    def rank(some, bodies):
        left.append(some.count())
        return ops._dated(some, bodies, small.feeds(spark, (1, {})))

    kept, kept_details = blocks.newest(items, details, rank, 20)
    assert left == [51] and kept.count() == kept_details.count() == 51
    assert ids(ops.timeline(items, details, small.feeds(spark, (1, {})), limit=20, blocks=blocks)) == list(range(4000, 3980, -1))


def test_timeline_filters(tables, block_ids, tmp_path):
    items, details, feeds = tables
    blocks = blocks_of(items, details, block_ids, tmp_path)

    def found(**kw):
        return set(ids(ops.timeline(items, details, feeds, blocks=blocks, **kw)))

    assert found(feed_id=2) == {2}
    assert found(query="pruning") == {2}
    assert found(query="  ") == {1, 2, 3}
    assert found(query="timetable") == {1, 3}  # detail of 1, feed title of both
    # Both words must be in one document, not spread over title and summary.
    assert found(query="harbour changes") == set()
    assert found(query="harbour ferries") == {1}
    # Excluded words count per document: some document of item 1 lacks it.
    assert found(query="-harbour") == {1, 2, 3}
    assert found(query="timetable", feed_id=1, limit=1) == {3}


def test_all_items_and_lookups(tables):
    items, details, feeds = tables
    assert ids(ops.all_items(items)) == [4, 2, 3, 1]
    assert ids(ops.all_items_with_detail(items, details)) == [4, 2, 3, 1]
    assert ids(ops.latest_items(items, 2)) == [4, 2]
    assert ids(ops.items_by_feed(items, 1)) == [3, 1]
    assert ids(ops.items_by_feed(items, 77)) == []
    assert ids(ops.item_by_id(items, 99)) == []
    assert ops.item_with_detail(items, details, 3).first().summary is None
    assert ops.item_with_detail(items, details, 2).first().summary == "Pruning advice"
    assert ids(ops.recent_items(items, at("2024-01-03T00:00:00"))) == [4, 2]
    assert ops.high_watermark(items).first()[0] == 4
    assert ops.high_watermark(items.limit(0)).first()[0] == 0


def test_items_after(spark):
    items = small.items(spark, *[(i, 1, "t", "00:00:00") for i in range(1, 7)])
    rows = ops.items_after(items, 1, 2).collect()
    assert [(r.id, r.skipped_older) for r in rows] == [(5, True), (6, True)]
    rows = ops.items_after(items, 3, 3).collect()
    assert [(r.id, r.skipped_older) for r in rows] == [(4, False), (5, False), (6, False)]
    assert ops.items_after(items, 1, 0).count() == 0
    assert ops.items_after(items, 6, 5).count() == 0


def test_upsert_newest(spark):
    rng = random.Random(3)
    current, incoming = {}, {}
    for target, size in ((current, 40), (incoming, 25)):
        while len(target) < size:
            i = rng.randint(1, 60)
            target[i] = (i, 1, f"{id(target)}-{i}", f"2024-01-{rng.randint(1, 28):02d}T00:00:00")
    merged = current | incoming
    want = sorted(merged.values(), key=lambda r: (r[3], r[0]), reverse=True)[:30]
    a, b = small.items(spark, *current.values()), small.items(spark, *incoming.values())
    doubled = b.unionByName(b)
    got = ops.upsert_newest(a, doubled, 30).collect()
    assert [(r.id, r.title) for r in got] == [(r[0], r[2]) for r in want]
    assert got[0].published_at is None


def test_upsert_newest_last_version_of_a_batch_wins(spark):
    current = small.items(spark, (1, 1, "stored", "00:00:00"), (2, 1, "alone", "00:00:01"))
    versions = [("z first", 1), ("a last", 3), ("m middle", 2)]
    batch = None
    for title, place in versions:
        rows = small.items(spark, (1, 1, title, "00:00:00"), (3, 1, title, "00:00:02")).withColumn("place", F.lit(place))
        batch = rows if batch is None else batch.unionByName(rows)
    got = ops.upsert_newest(current, batch.repartition(5), order="place").collect()
    assert [(r.id, r.title) for r in got] == [(3, "a last"), (2, "alone"), (1, "a last")]
    # without an order the greatest by content, whatever the partitions
    for parts in (1, 5):
        got = ops.upsert_newest(current, batch.repartition(parts)).collect()
        assert [(r.id, r.title) for r in got] == [(3, "z first"), (2, "alone"), (1, "z first")]


def test_large_ids_are_pushed_down(tables, tmp_path):
    items, _, _ = tables
    items.write.parquet(str(tmp_path / "items"))
    stored = items.sparkSession.read.parquet(str(tmp_path / "items"))
    plan = ops.items_after(stored, 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,2)" in plan and "TakeOrderedAndProject" in plan
    narrow = ops.latest_items(stored, 3).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,inserted_at:timestamp>" in narrow


def test_timeline_never_shuffles_text(tables, tmp_path):
    items, details, feeds = tables
    spark = items.sparkSession
    for df, name in ((items, "items"), (details, "details")):
        df.write.parquet(str(tmp_path / name))
    stored = [spark.read.parquet(str(tmp_path / n)) for n in ("items", "details")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ops.timeline(*stored, feeds, limit=5)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    ranking = plan.toString().split("TakeOrderedAndProject")[1]
    schemas = re.findall(r"ReadSchema: (\S+)", ranking)
    assert schemas[:2] == [
        "struct<id:bigint,feed_id:bigint,inserted_at:timestamp>",
        "struct<feed_item_id:bigint,published_at:timestamp>",
    ]


def test_key_violations_report(spark):
    from feedlake.operators import keys

    items = small.items(spark, (1, 1, "a", "00:00:00"), (2, 1, "b", "00:00:00"), (3, 5, "c", "00:00:00"))
    same = items.withColumn("external_id", F.lit("x"))
    details = small.details(spark, (1, "", "", "2024-01-01T00:00:00"), (8, "", "", "2024-01-01T00:00:00"))
    report = {(r.rule, r.key, r.row_count) for r in keys.key_violations(same, details, small.feeds(spark, (1, {}))).collect()}
    assert report == {("duplicate item", "1/x", 2), ("item without feed", "5", 1), ("detail without item", "8", 1)}
    assert keys.require_unique(items, ["feed_id", "external_id"]).count() == 3
    with pytest.raises(Exception, match="duplicate key 1/x"):
        keys.require_unique(same, ["feed_id", "external_id"]).collect()


def test_assign_ids_are_dense_and_stable(spark):
    from feedlake.operators.keys import assign_ids

    rng = random.Random(5)
    values = sorted(rng.sample(range(-500, 5000), 700))
    df = spark.createDataFrame([(v,) for v in values], "seq long")
    for block, parts in ((16, 3), (1 << 20, 1), (1000, 7)):
        rows = assign_ids(df.repartition(parts), "seq", 100, block_rows=block).orderBy("seq").collect()
        assert [r.seq for r in rows] == values
        assert [r.id for r in rows] == list(range(101, 101 + len(values)))
