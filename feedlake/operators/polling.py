"""The poll cycle: due feeds and leases, fetch results, completion, poll state."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import scores
from feedlake.functions.times import add_seconds
from feedlake.operators import ingest
from feedlake.operators.cadence import cadence
from feedlake.operators.skew import spread_join
from feedlake.schemas import DEFAULT_POLL_INTERVAL_SECONDS, FEED_COLUMNS, ITEM_COLUMNS, QUEUE_COLUMNS
from feedlake.session import settled
from feedlake.sources.cadence_state import CadenceState
from feedlake.sources.key_store import KeyStore

if TYPE_CHECKING:
    from feedlake.sources.tables import TableStore

# Batch size and length of a lease.
DEFAULT_LEASE_BATCH = 25
MAX_LEASE_BATCH = 100
DEFAULT_LEASE_SECONDS = 300
MAX_LEASE_SECONDS = 3600

FETCHED, NOT_MODIFIED, FAILED = "fetched", "not_modified", "failed"


# --- requests and leases ---------------------------------------------------


def fetch_requests(requests: DataFrame, feeds: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """Answer ``requests(feed_id)`` to fetch now, one row per distinct feed.

    A missing feed is an error, a paused one is rejected, the others become
    due now unless they were due earlier already.  ``sendable`` is what a
    client may decide beforehand: it holds back only feeds known as paused.
    """
    known = feeds.select(F.col("id").alias("feed_id"), "is_enabled")
    status = (
        F.when(F.col("is_enabled").isNull(), "not_found")
        .when(F.col("is_enabled"), "queued")
        .otherwise("paused")
    )
    return (
        requests.select("feed_id")
        .distinct()
        .join(known, "feed_id", "left")
        .join(queue.select("feed_id", "due_at"), "feed_id", "left")
        .select(
            "feed_id",
            F.coalesce("is_enabled", F.lit(True)).alias("sendable"),
            status.alias("status"),
            F.when(F.col("is_enabled"), F.least("due_at", now)).alias("due_at"),
        )
    )


def request_counts(answers: DataFrame) -> DataFrame:
    return answers.agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("status") != "queued").alias("rejected"),
    )


def apply_requests(queue: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Queue after the answered requests; feeds without a row get one."""
    granted = answers.filter("status = 'queued'").select("feed_id", F.col("due_at").alias("granted"))
    joined = queue.join(granted, "feed_id", "full")
    values = {
        "due_at": F.least("granted", "due_at"),
        "attempts": F.coalesce("attempts", F.lit(0).cast("long")),
        "updated_at": F.when(F.col("granted").isNotNull(), now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in QUEUE_COLUMNS])


def due_keys(queue: DataFrame, feeds: DataFrame, now: Column, limit: int | None) -> DataFrame:
    """Feeds to poll: enabled, due, not under a running lease; longest due first."""
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    due = (
        queue.filter((F.col("due_at") <= now) & free)
        .select("feed_id", "due_at")
        .join(feeds.filter("is_enabled").select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    )
    return due.select("feed_id") if limit is None else due.orderBy("due_at", "feed_id").limit(limit).select("feed_id")


def lease_token(batch: str, feed_id: Column) -> Column:
    """Token of a lease; the same batch run again hands out the same token."""
    return F.md5(F.concat(F.lit(f"{batch}-"), feed_id.cast("string")).cast("binary"))


def due_feeds(
    queue: DataFrame,
    feeds: DataFrame,
    now: Column,
    batch: str,
    limit: int | None = DEFAULT_LEASE_BATCH,
    lease_seconds: int = DEFAULT_LEASE_SECONDS,
) -> DataFrame:
    """Lease due feeds: what a fetcher needs to know of each, by feed id.

    ``limit`` None takes every due feed; other values and the lease's length must
    lie within their bounds.
    """
    if limit is not None and not 1 <= limit <= MAX_LEASE_BATCH:
        raise ValueError(f"a lease batch has 1 to {MAX_LEASE_BATCH} feeds, not {limit}")
    if not 1 <= lease_seconds <= MAX_LEASE_SECONDS:
        raise ValueError(f"a lease lasts 1 to {MAX_LEASE_SECONDS} seconds, not {lease_seconds}")
    picked = due_keys(queue, feeds, now, limit)
    if limit is not None:
        # at most MAX_LEASE_BATCH rows
        picked = F.broadcast(picked)
    meta = feeds.withColumnRenamed("id", "feed_id").drop("is_enabled")
    leased = queue.select("feed_id", (F.col("attempts") + 1).alias("attempts")).join(picked, "feed_id")
    return (
        meta.join(leased, "feed_id")
        .withColumn("lease_token", lease_token(batch, F.col("feed_id")))
        .withColumn("lease_expires_at", add_seconds(now, F.lit(lease_seconds)))
        .orderBy("feed_id")
    )


def queue_after_lease(queue: DataFrame, leased: DataFrame, now: Column) -> DataFrame:
    """Queue with the lease columns of ``leased`` written in."""
    new = leased.select(
        "feed_id",
        F.col("lease_token").alias("t"),
        F.col("lease_expires_at").alias("e"),
        F.col("attempts").alias("a"),
    )
    taken = F.col("t").isNotNull()
    values = {
        "leased_at": F.when(taken, now).otherwise(F.col("leased_at")),
        "updated_at": F.when(taken, now).otherwise(F.col("updated_at")),
        "lease_token": F.coalesce("t", "lease_token"),
        "lease_expires_at": F.coalesce("e", "lease_expires_at"),
        "attempts": F.coalesce("a", "attempts"),
    }
    return queue.join(new, "feed_id", "left").select(*[values.get(c, F.col(c)).alias(c) for c in QUEUE_COLUMNS])


def fetch_plan(leased: DataFrame) -> DataFrame:
    """Conditional request headers per leased feed; unknown validators are left out."""
    headers = F.create_map(
        F.lit("If-None-Match"), F.col("etag"), F.lit("If-Modified-Since"), F.col("last_modified")
    )
    return leased.select(
        "feed_id", "url", "lease_token", F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers")
    )


# --- fetch results ---------------------------------------------------------


def fetch_outcomes(responses: DataFrame) -> DataFrame:
    """Label ``responses(status, parsed_ok)``: no status means no answer at all."""
    readable = (F.col("status") < 400) & F.coalesce("parsed_ok", F.lit(False))
    label = F.when(F.col("status") == 304, NOT_MODIFIED).when(readable, FETCHED).otherwise(FAILED)
    return responses.withColumn("outcome", label)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("feeds"))


def _winners(outcomes: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """``(feed_id, seq)`` of the outcomes that count.

    Completing clears the lease, so only the first outcome with the running
    lease of its feed does.  Reducing comes first, it makes the join small.
    """
    first = outcomes.groupBy("feed_id", "lease_token").agg(F.min("seq").alias("seq"))
    leases = queue.filter(F.col("lease_expires_at") > now).select("feed_id", "lease_token")
    return first.join(leases, ["feed_id", "lease_token"], "left_semi").select("feed_id", "seq")


def accepted_outcomes(outcomes: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    return outcomes.join(_winners(outcomes, queue, now), ["feed_id", "seq"], "left_semi")


def rejected_outcomes(outcomes: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """Outcomes with a stale, unknown, expired or already used lease."""
    return outcomes.join(_winners(outcomes, queue, now), ["feed_id", "seq"], "left_anti")


# --- completion ------------------------------------------------------------


def _success() -> Column:
    return F.col("outcome") != FAILED


def apply_to_feeds(feeds: DataFrame, accepted: DataFrame, added: DataFrame, cadences: DataFrame) -> DataFrame:
    """Feed table after accepted outcomes.

    ``added(feed_id, inserted_items)`` and ``cadences`` describe the state
    after the new items were stored.
    """
    meta = ("title", "site_url", "etag", "last_modified")
    result = accepted.select(
        F.col("feed_id").alias("id"), "outcome", "checked_at", *[F.col(c).alias(f"_new_{c}") for c in meta]
    )
    joined = (
        feeds.join(result, "id", "left")
        .join(added.select(F.col("feed_id").alias("id"), "inserted_items"), "id", "left")
        .join(cadences.select(F.col("feed_id").alias("id"), "cadence_seconds"), "id", "left")
    )
    polled, success = F.col("outcome").isNotNull(), _success()
    interval = F.when(
        F.col("outcome") == FETCHED, scores.resolved_interval(F.col("cadence_seconds"))
    ).otherwise(scores.backoff_interval(F.col("poll_interval_seconds")))
    got_rows = success & (F.coalesce("inserted_items", F.lit(0)) > 0)
    values = {c: F.when(success, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) for c in meta} | {
        "poll_interval_seconds": F.when(polled, interval).otherwise(F.col("poll_interval_seconds")),
        "last_checked_at": F.coalesce("checked_at", "last_checked_at"),
        "last_success_at": F.when(success, F.col("checked_at")).otherwise(F.col("last_success_at")),
        "last_inserted_at": F.when(got_rows, F.col("checked_at")).otherwise(F.col("last_inserted_at")),
        "failure_count": F.when(success, F.lit(0).cast("long"))
        .when(polled, F.col("failure_count") + 1)
        .otherwise(F.col("failure_count")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in FEED_COLUMNS])


def next_due(accepted: DataFrame, feeds_after: DataFrame, queue: DataFrame) -> DataFrame:
    """Next due time and attempts of every polled feed."""
    intervals = feeds_after.select(F.col("id").alias("feed_id"), "poll_interval_seconds")
    return (
        accepted.select("feed_id", "outcome", "checked_at")
        .join(intervals, "feed_id")
        .join(queue.select("feed_id", "attempts"), "feed_id")
        .select(
            "feed_id",
            add_seconds(F.col("checked_at"), F.col("poll_interval_seconds")).alias("due_at"),
            F.when(_success(), F.lit(0).cast("long")).otherwise(F.col("attempts")).alias("attempts"),
        )
    )


def queue_after_polls(queue: DataFrame, rescheduled: DataFrame, now: Column) -> DataFrame:
    """Queue with new due times and cleared leases."""
    new = rescheduled.select("feed_id", F.col("due_at").alias("d"), F.col("attempts").alias("a"))
    done = F.col("d").isNotNull()

    def cleared(name: str) -> Column:
        return F.when(~done, F.col(name))

    values = {
        "due_at": F.coalesce("d", "due_at"),
        "attempts": F.coalesce("a", "attempts"),
        "leased_at": cleared("leased_at"),
        "lease_expires_at": cleared("lease_expires_at"),
        "lease_token": cleared("lease_token"),
        "updated_at": F.when(done, now).otherwise(F.col("updated_at")),
    }
    return queue.join(new, "feed_id", "left").select(*[values.get(c, F.col(c)).alias(c) for c in QUEUE_COLUMNS])


@dataclass
class Completion:
    """Everything one batch of outcomes changes, still lazy."""

    items: DataFrame
    details: DataFrame
    feeds: DataFrame
    queue: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def complete_batch(
    outcomes: DataFrame,
    entries: DataFrame,
    feeds: DataFrame,
    items: DataFrame,
    details: DataFrame,
    queue: DataFrame,
    now: Column,
    keys: KeyStore | None = None,
    state: CadenceState | None = None,
    batch_id: int | None = None,
    once: bool = False,
) -> Completion:
    """Validate leases, number new entries, refresh cadence, reschedule.

    ``entries`` carry ``outcome_seq``, the outcome they came with; those of
    rejected outcomes are dropped.  The cadence sees the rows just added.
    What everything else builds on, the accepted outcomes and the numbers of
    the new entries, is settled first.

    With ``keys`` and ``state`` (as they were before ``batch_id``) stored items
    and details are not read: known entries come from the keys' filters, the
    cadence of the polled feeds from their days.

    ``once`` settles new items, new details and the feeds too, for callers that
    write them all: each is computed a single time, whatever builds on it.
    """

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return settled(rows, name) if once else rows

    accepted = settled(accepted_outcomes(outcomes, queue, now), "accepted")
    bodies = accepted.filter(F.col("outcome") == FETCHED).select("feed_id", F.col("seq").alias("outcome_seq"))
    body_entries = kept(entries.join(bodies, ["feed_id", "outcome_seq"], "left_semi"), "body-entries")
    numbers = settled(ingest.number_new(body_entries, items if keys is None else keys, batch_id), "numbers")
    fresh_items = kept(ingest.new_items(body_entries, numbers, now), "new-items")
    fresh_details = kept(ingest.new_details(body_entries, numbers, now), "new-details")
    polled = accepted.filter(F.col("outcome") == FETCHED).select(F.col("feed_id").alias("id"))
    if state is None:
        # gaps of unpolled feeds are asked for by nobody
        theirs = items.join(polled.select(F.col("id").alias("feed_id")), "feed_id", "left_semi").select(*ITEM_COLUMNS)
        cadences = cadence(theirs.unionByName(fresh_items), details.unionByName(fresh_details), polled)
    else:
        cadences = state.cadence(polled, fresh_items, fresh_details, batch_id)
    feeds_after = kept(apply_to_feeds(feeds, accepted, ingest.ingest_summary(fresh_items), cadences), "feeds-after")
    return Completion(
        items=fresh_items,
        details=fresh_details,
        feeds=feeds_after,
        queue=queue_after_polls(queue, next_due(accepted, feeds_after, queue), now),
        accepted=accepted,
        rejected=outcomes.join(accepted.select("feed_id", "seq"), ["feed_id", "seq"], "left_anti"),
    )


def store_completion(done: Completion, store: TableStore, batch_id: int) -> None:
    """Write what a completed batch changes to all four tables.

    Every table has a folder of this batch, which is replaced if the batch is
    repeated; inputs must be read as they were before it (``before_batch``).  The
    queue comes last: until it is there, the leases of the batch still run.
    """
    items = settled(done.items, "completed-items")
    store.append("feed_item_details", done.details, batch_id)
    store.append("feed_items", items, batch_id)
    store.keys(batch_id).append(items, batch_id)
    store.write_snapshot("feeds", done.feeds, batch_id)
    store.write_snapshot("feed_update_queue", done.queue, batch_id)


def complete_stored_batch(outcomes: DataFrame, entries: DataFrame, store: TableStore, now: Column, batch_id: int) -> Completion:
    """One poll batch from and to a table store; repeating it replaces its rows.

    Reads keys and cadence of what the batch names, the feeds and the queue, but
    no stored item.
    """
    none = {name: store.empty(name) for name in ("feed_items", "feed_item_details")}
    done = complete_batch(
        outcomes,
        entries,
        store.snapshot("feeds", batch_id),
        none["feed_items"],
        none["feed_item_details"],
        store.snapshot("feed_update_queue", batch_id),
        now,
        store.keys(batch_id),
        store.cadence_state(batch_id),
        batch_id,
        once=True,
    )
    store_completion(done, store, batch_id)
    return done


# --- poll state over many outcomes -----------------------------------------


def poll_state(outcomes: DataFrame, initial: DataFrame) -> DataFrame:
    """Poll state per feed after all its outcomes, in ``seq`` order.

    ``outcomes(feed_id, seq, checked_at, outcome, resolved_interval)``;
    ``initial(feed_id, poll_interval_seconds, failure_count, last_success_at,
    last_checked_at)`` is the state before.  Only the last fetch, the last
    success and what follows them matter, so two small aggregations replace an
    ordered walk: the first finds where they are, the second reads the rows
    from there on.  Both combine on the map side, and no feed's history is
    ever gathered in one place.
    """
    seq, outcome = F.col("seq"), F.col("outcome")
    marks = outcomes.groupBy("feed_id").agg(
        F.max(F.when(outcome == FETCHED, seq)).alias("fetch_seq"),
        F.max(F.when(outcome != FAILED, seq)).alias("success_seq"),
        F.max(seq).alias("last_seq"),
    )
    after_fetch = F.col("fetch_seq").isNull() | (seq > F.col("fetch_seq"))
    after_success = F.col("success_seq").isNull() | (seq > F.col("success_seq"))

    def value_at(mark: str, value: str) -> Column:
        return F.max(F.when(seq == F.col(mark), F.col(value)))

    slim = outcomes.select("feed_id", "seq", "checked_at", "resolved_interval")
    tails = (
        spread_join(slim, marks, "feed_id", by="seq")
        .filter(after_fetch | (seq == F.col("fetch_seq")))
        .groupBy("feed_id")
        .agg(
            value_at("fetch_seq", "resolved_interval").alias("fetched_interval"),
            value_at("success_seq", "checked_at").alias("success_at"),
            value_at("last_seq", "checked_at").alias("checked_at"),
            F.count_if(after_fetch).alias("backoffs"),
            F.count_if(after_success).alias("failures"),
        )
    )
    state = initial.join(tails, "feed_id", "full")
    no_rows = F.lit(0).cast("long")
    fetched = F.col("fetched_interval")
    start = F.coalesce(
        F.when(fetched.isNotNull(), scores.clamp_interval(fetched)),
        F.col("poll_interval_seconds"),
        F.lit(DEFAULT_POLL_INTERVAL_SECONDS).cast("long"),
    )
    # Failures before this batch count on only if nothing has succeeded since.
    earlier = F.when(F.col("success_at").isNull(), F.coalesce("failure_count", no_rows)).otherwise(no_rows)
    return state.select(
        "feed_id",
        scores.repeated_backoff(start, F.coalesce("backoffs", no_rows)).alias("poll_interval_seconds"),
        (earlier + F.coalesce("failures", no_rows)).alias("failure_count"),
        F.coalesce("success_at", "last_success_at").alias("last_success_at"),
        F.coalesce("checked_at", "last_checked_at").alias("last_checked_at"),
    )
