"""Registered queries: each operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators import (
    cadence,
    cards,
    changes,
    feeds,
    ingest,
    items,
    keys,
    metrics,
    polling,
    replay,
    search,
    titles,
    topics,
)
from feedlake.plans.tables import Given
from feedlake.schemas import DETAIL_COLUMNS, ENTRIES, ITEM_COLUMNS
from feedlake.sources import feed_xml, logs
from feedlake.streaming.tail import live_tail

Query = Callable[[SparkSession, str], DataFrame]

#: Arguments of single-item reads and searches; the SQL side uses the same.
SOME_FEED, SOME_ITEM, DETAILED_ITEM = 7, 42, 41
SEARCH = '"of the" tion or leaux pour -src3'
BATCH_NAME = "batch-1"
MISSING_DATE = "2024-06-01 00:00:00"

QUERIES: dict[str, Query] = {}


def query(build: Callable[[Given], DataFrame]) -> Callable[[Given], DataFrame]:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Given(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Scores are compared at a precision both engines share."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- lists, lookups, timeline ------------------------------------------------


@query
def feeds_list(g: Given) -> DataFrame:
    return feeds.feeds_list(g.feeds)


@query
def feeds_newest(g: Given) -> DataFrame:
    return feeds.feeds_newest(g.feeds)


@query
def feeds_by_name(g: Given) -> DataFrame:
    return feeds.feeds_by_name(g.feeds)


@query
def feed_by_id(g: Given) -> DataFrame:
    return feeds.feed_by_id(g.feeds, SOME_FEED)


@query
def fetchable_feeds(g: Given) -> DataFrame:
    return feeds.fetchable_feeds(g.feeds)


@query
def source_report(g: Given) -> DataFrame:
    return feeds.source_report(g.feeds)


@query
def link_source_id(g: Given) -> DataFrame:
    return feeds.link_source_id(g.links)


@query
def items_all(g: Given) -> DataFrame:
    return items.all_items(g.items)


@query
def items_detail_all(g: Given) -> DataFrame:
    return items.all_items_with_detail(g.items, g.details)


@query
def item_by_id(g: Given) -> DataFrame:
    return items.item_by_id(g.items, SOME_ITEM)


@query
def detail_by_item(g: Given) -> DataFrame:
    return items.detail_by_item(g.details, DETAILED_ITEM)


@query
def item_with_detail(g: Given) -> DataFrame:
    return items.item_with_detail(g.items, g.details, DETAILED_ITEM)


@query
def items_by_feed(g: Given) -> DataFrame:
    return items.items_by_feed(g.items, SOME_FEED)


@query
def items_recent(g: Given) -> DataFrame:
    return items.recent_items(g.items, g.now)


@query
def latest_items(g: Given) -> DataFrame:
    return items.latest_items(g.items, 50)


@query
def latest_by_feed(g: Given) -> DataFrame:
    return items.timeline(g.items, g.details, g.feeds, limit=50, feed_id=SOME_FEED, blocks=g.timeline_blocks)


@query
def timeline(g: Given) -> DataFrame:
    return items.timeline(g.items, g.details, g.feeds, limit=items.TIMELINE_LIMIT, blocks=g.timeline_blocks)


@query
def timeline_named(g: Given) -> DataFrame:
    rows = items.timeline(g.items, g.details, g.feeds, limit=items.TIMELINE_LIMIT, blocks=g.timeline_blocks)
    return cards.with_feed_labels(rows, g.feeds)


@query
def timeline_upsert(g: Given) -> DataFrame:
    shown = items.timeline(g.items, g.details, g.feeds, limit=items.TIMELINE_LIMIT, blocks=g.timeline_blocks)
    redelivered = g.event_items(g.events.filter("event_type = 'purchase'")).withColumn("title", F.upper("title"))
    return items.upsert_newest(shown, redelivered)


@query
def timeline_versions(g: Given) -> DataFrame:
    """Every stored item comes in several versions inside one batch; the last wins."""
    shown = items.timeline(g.items, g.details, g.feeds, limit=items.TIMELINE_LIMIT, blocks=g.timeline_blocks)
    number = F.explode(F.sequence(F.lit(1), F.lit(3)))
    versions = g.items.withColumn("version_seq", number).withColumn(
        "title", F.concat((F.lit(9) - F.col("version_seq")).cast("string"), F.lit(" "), F.col("title"))
    )
    return items.upsert_newest(shown, versions, order="version_seq")


@query
def high_watermark(g: Given) -> DataFrame:
    return items.high_watermark(g.items)


@query
def item_cards(g: Given) -> DataFrame:
    return cards.item_cards(g.page_rows, g.page_rows.agg(F.max("inserted_at")).scalar())


# --- title index and topics --------------------------------------------------


@query
def title_tokens(g: Given) -> DataFrame:
    return titles.title_tokens(g.doc_items)


@query
def title_index(g: Given) -> DataFrame:
    return rounded(g.doc_index(), 6, "tf_idf")


@query
def title_index_recent(g: Given) -> DataFrame:
    return rounded(g.doc_index(recent=True), 6, "tf_idf")


def _flat(index: DataFrame) -> DataFrame:
    """Nested sources as one text, so that any engine can compare them."""
    source = F.transform(
        "items", lambda s: F.concat(s["feed_src_id"].cast("string"), F.lit(":"), s["occurrences"].cast("string"))
    )
    return rounded(index, 6, "tf_idf").withColumns(
        {"source_count": F.size("items").cast("long"), "items": F.array_join(source, ",")}
    )


@query
def title_index_nested(g: Given) -> DataFrame:
    return _flat(g.doc_index(nested=True))


@query
def title_index_json(g: Given) -> DataFrame:
    """Written as JSON with the legacy names, then read back."""
    written = titles.index_json(g.doc_index(recent=True, nested=True))
    return _flat(titles.index_from_json(written))


@query
def topic_scaled(g: Given) -> DataFrame:
    return rounded(topics.topic_scaled(g.doc_index(recent=True)), 6, "tf_idf", "font_size")


@query
def topic_sources(g: Given) -> DataFrame:
    counts = titles.word_counts(titles.in_last_day(g.doc_items, g.doc_now))
    return rounded(topics.topic_sources(counts, g.doc_feeds), 6, "bar_percent")


@query
def words_sliding(g: Given) -> DataFrame:
    return titles.words_sliding(g.doc_items, "24 hours", "6 hours")


# --- search --------------------------------------------------------------------


@query
def search_tokens(g: Given) -> DataFrame:
    pages = g.page_rows
    return search.search_tokens(pages, pages.withColumn("feed_item_id", F.col("id")))


@query
def search_dictionary(g: Given) -> DataFrame:
    """The words of a new index, built each time, and in how many documents they are."""
    return g.new_index.dictionary().filter("token <> ''")


@query
def search_items(g: Given) -> DataFrame:
    rows = items.timeline(g.doc_items, g.doc_details, g.doc_feeds, query=SEARCH, index=g.search_index)
    return rows.select(*ITEM_COLUMNS, *DETAIL_COLUMNS)


@query
def search_latest(g: Given) -> DataFrame:
    return items.timeline(g.doc_items, g.doc_details, g.doc_feeds, limit=100, query=SEARCH, index=g.search_index, blocks=g.doc_blocks).select(
        "id", "inserted_at"
    )


@query
def search_batch(g: Given) -> DataFrame:
    return search.search_batch(g.item_index, g.searches)


# --- entries and ingest --------------------------------------------------------


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _missing_date() -> Column:
    return F.lit(MISSING_DATE).cast("timestamp")


@query
def external_ids(g: Given) -> DataFrame:
    entries = feed_xml.normalize_entries(g.raw_entries, _missing_date())
    return entries.select("page_id", "external_id", "title", "url")


@query
def parse_feeds(g: Given) -> DataFrame:
    entries = feed_xml.read_entries(g.bodies, _missing_date())
    return _ntz(entries.withColumn("pos", F.col("pos").cast("long")), "published_at")


@query
def feed_metadata(g: Given) -> DataFrame:
    return feed_xml.read_feeds(g.bodies)


@query
def fetch_outcomes(g: Given) -> DataFrame:
    parsed = feed_xml.read_feeds(g.responses)
    return polling.fetch_outcomes(parsed).select("feed_id", "outcome")


@query
def ingest_dedup(g: Given) -> DataFrame:
    return ingest.insert_items(g.entries, g.stored_keys, g.now)


@query
def ingest_details(g: Given) -> DataFrame:
    return ingest.insert_details(g.entries, g.stored_keys, g.now)


@query
def ingest_summary(g: Given) -> DataFrame:
    return ingest.ingest_summary(ingest.insert_items(g.entries, g.stored_keys, g.now))


@query
def key_violations(g: Given) -> DataFrame:
    """Against the enabled feeds alone, items of the others are orphans."""
    return keys.key_violations(g.items, g.details, g.feeds.filter("is_enabled"))


@query
def strict_items(g: Given) -> DataFrame:
    """A plain insert of every first entry of a key; a repeated key would be an error."""
    first = g.items.groupBy("feed_id", "external_id").agg(F.min("id").alias("id"))
    return keys.require_unique(g.items.join(first.select("id"), "id", "left_semi"), ["feed_id", "external_id"])


# --- changes -------------------------------------------------------------------


@query
def update_items(g: Given) -> DataFrame:
    new = g.events.filter("event_type = 'purchase'").selectExpr(
        "event_id as id", "upper(props) as title", "concat('https://new.example/', event_id) as url"
    )
    return changes.update_items(g.items, new)


@query
def update_details(g: Given) -> DataFrame:
    new = g.events.filter("event_type = 'click'").selectExpr(
        "event_id as feed_item_id", "'updated' as summary", "props as content", "'editor' as author", "ts as published_at"
    )
    return changes.update_details(g.details, new)


@query
def delete_items(g: Given) -> DataFrame:
    gone = g.events.filter("event_type = 'signup'").selectExpr("event_id as id")
    kept_items, kept_details = changes.delete_items(g.items, g.details, gone)
    return _named_ids({"feed_items": kept_items, "feed_item_details": kept_details})


def _named_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Which rows each table keeps."""
    parts = [
        rows.select(F.lit(name).alias("table_name"), F.col("feed_id" if name == "feed_update_queue" else "id").alias("id"))
        for name, rows in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def delete_feeds_cascade(g: Given) -> DataFrame:
    gone = g.feeds.filter("failure_count = 3").select("id")
    return _named_ids(changes.delete_feeds(g.feeds, g.items, g.details, g.queue, gone))


@query
def upsert_feeds(g: Given) -> DataFrame:
    return feeds.upsert_feeds(g.feed_urls, g.known_feeds).select(
        "id", "url", "poll_interval_seconds", "is_enabled", "failure_count"
    )


@query
def seeded_feeds(g: Given) -> DataFrame:
    """The starter feeds among those people know, seeded twice; one is there already."""
    known = feeds.upsert_feeds(g.feed_urls.unionByName(g.feed_urls.selectExpr("seq + 1000000000 as seq", f"'{feeds.DEFAULT_FEED_URLS[0]}' as url")), g.known_feeds)
    return feeds.seed_default_feeds(feeds.seed_default_feeds(known)).select("id", "url", "is_enabled", "failure_count")


@query
def set_enabled(g: Given) -> DataFrame:
    flags = g.feeds.filter("failure_count < 2").selectExpr("id", "not is_enabled as is_enabled")
    switched = feeds.set_enabled(g.feeds, flags).select(F.col("id").alias("feed_id"), "is_enabled")
    return switched.join(feeds.wake_enabled(g.queue, flags, g.now).select("feed_id", "due_at"), "feed_id")


# --- polling ---------------------------------------------------------------------


def _cadence(g: Given) -> DataFrame:
    return cadence.cadence(g.items, g.details, g.feeds)


@query
def cadence_(g: Given) -> DataFrame:
    """From the days that two batches left; ``poll_intervals`` reads all items."""
    return rounded(g.cadence_state.cadence(g.feeds), 3, "median_inserted", "median_published")


QUERIES["cadence"] = QUERIES.pop("cadence_")


@query
def poll_intervals(g: Given) -> DataFrame:
    return cadence.poll_intervals(_cadence(g))


@query
def poll_backoff(g: Given) -> DataFrame:
    return cadence.poll_backoff(g.feeds)


@query
def queue_backfill(g: Given) -> DataFrame:
    return cadence.queue_backfill(g.feeds, g.now)


@query
def fetch_requests(g: Given) -> DataFrame:
    """Every user asks for its own feed and for one further on, which may not exist."""
    own = g.events.select(F.col("user_id").alias("feed_id"))
    other = g.events.select((F.col("user_id") * 2).alias("feed_id"))
    return polling.fetch_requests(own.unionByName(other), g.feeds, g.queue, g.now)


@query
def fetch_request_counts(g: Given) -> DataFrame:
    requests = g.events.select((F.col("user_id") * 2).alias("feed_id"))
    return polling.request_counts(polling.fetch_requests(requests, g.feeds, g.queue, g.now))


@query
def queue_after_requests(g: Given) -> DataFrame:
    """The queue of all feeds but every fourth, after the requests for those twice as far."""
    requests = g.events.select((F.col("user_id") * 2).alias("feed_id"))
    queue = g.queue.filter("feed_id % 4 <> 0")
    return polling.apply_requests(queue, polling.fetch_requests(requests, g.feeds, queue, g.now), g.now)


def _leased(g: Given) -> DataFrame:
    return polling.due_feeds(g.queue, g.feeds, g.now, BATCH_NAME)


@query
def due_feeds(g: Given) -> DataFrame:
    return _leased(g)


@query
def queue_after_lease(g: Given) -> DataFrame:
    return polling.queue_after_lease(g.queue, _leased(g), g.now)


@query
def fetch_plan(g: Given) -> DataFrame:
    every = polling.due_feeds(g.queue, g.feeds, g.now, BATCH_NAME, limit=None)
    return polling.fetch_plan(every).select(
        "feed_id",
        "url",
        "lease_token",
        F.col("headers")["If-None-Match"].alias("if_none_match"),
        F.col("headers")["If-Modified-Since"].alias("if_modified_since"),
        F.size("headers").cast("long").alias("header_count"),
    )


@query
def accepted_outcomes(g: Given) -> DataFrame:
    return polling.accepted_outcomes(g.outcomes, g.queue, g.now).select("feed_id", "seq", "outcome")


@query
def rejected_outcomes(g: Given) -> DataFrame:
    return polling.rejected_outcomes(g.outcomes, g.queue, g.now).select("feed_id", "seq", "outcome")


@query
def outcome_counts(g: Given) -> DataFrame:
    return polling.outcome_counts(g.outcomes)


def _completion(g: Given) -> polling.Completion:
    return polling.complete_batch(
        g.outcomes, g.entries, g.feeds, g.stored_items, g.stored_details, g.queue, g.now, g.stored_keys, g.stored_cadence
    )


@query
def apply_outcomes(g: Given) -> DataFrame:
    return _completion(g).feeds


@query
def next_due(g: Given) -> DataFrame:
    return _completion(g).queue.select("feed_id", "due_at", "lease_token", "attempts")


@query
def apply_outcomes_stored(g: Given) -> DataFrame:
    """The feeds after a batch that was read from and written to a table store."""
    store = g.filled_store()
    polling.complete_stored_batch(g.outcomes, g.entries.select("outcome_seq", *ENTRIES.fieldNames()), store, g.now, 2)
    after = store.snapshot("feeds")
    return after.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else c for c in after.columns])


@query
def poll_state(g: Given) -> DataFrame:
    start = g.feeds.select(
        F.col("id").alias("feed_id"), "poll_interval_seconds", "failure_count",
        F.lit(None).cast("timestamp_ntz").alias("last_success_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_checked_at"),
    )
    return polling.poll_state(g.outcomes, start)


# --- replay and live events --------------------------------------------------------


@query
def event_frames(g: Given) -> DataFrame:
    return replay.event_frames(g.items)


@query
def live_tail_(g: Given) -> DataFrame:
    """The events file as a stream, run until it is drained."""
    stream = (
        g.spark.readStream.schema(g.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(g.folder)
    )
    folder = g.new_folder("live-tail")
    live_tail(g.event_items(stream), f"{folder}/events", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return g.spark.read.schema("id long, event string, data string").parquet(f"{folder}/events")


QUERIES["live_tail"] = QUERIES.pop("live_tail_")


@query
def replay_after(g: Given) -> DataFrame:
    return items.items_after(g.items, keys.max_id(g.items) - 700, items.REPLAY_LIMIT)


@query
def replay_cursors(g: Given) -> DataFrame:
    both = replay.resume_cursors(replay.request_cursors(g.consumers), g.snapshots)
    return both.select("consumer_id", "cursor", "resume_cursor")


@query
def replay_marker(g: Given) -> DataFrame:
    """Markers are written as JSON and read back."""
    windows = replay.replay_windows(replay.request_cursors(g.consumers), g.items)
    written = replay.marker_data(replay.replay_markers(windows)).select("consumer_id", "data")
    return written.select("consumer_id", "data", replay.read_marker(F.col("data")).alias("m")).select(
        "consumer_id", "data", "m.*"
    )


@query
def replay_session(g: Given) -> DataFrame:
    live = F.col("inserted_at") > g.now - F.expr("INTERVAL 1 HOUR")
    stored = g.items.filter(~live)
    return replay.replay_session(stored, g.items.filter(live), keys.max_id(stored) - 700)


@query
def consumer_lag(g: Given) -> DataFrame:
    return replay.consumer_lag(replay.request_cursors(g.consumers), g.items)


# --- logs ----------------------------------------------------------------------------


def _logs(g: Given) -> DataFrame:
    folder = g.new_folder("logs")
    logs.write_logs(g.logs, folder)
    return logs.read_logs(g.spark, folder)


@query
def log_metrics(g: Given) -> DataFrame:
    return metrics.log_metrics(_logs(g), ["method", "route"])


@query
def fetch_durations(g: Given) -> DataFrame:
    return metrics.log_metrics(_logs(g), ["outcome"])


__all__ = ["QUERIES"]
