"""The given tables in the shape of feeds, items, details, queue and outcomes.

Every adapter covers its whole source table and whole texts.  ``oracles.py``
states the same shapes in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators import polling, titles
from feedlake.schemas import DETAIL_COLUMNS, FEED_COLUMNS, ITEM_COLUMNS, QUEUE_COLUMNS
from feedlake.session import configure, new_folder, settled, shared_folder
from feedlake.sources.cadence_state import CadenceState
from feedlake.sources.key_store import KeyStore
from feedlake.sources.search_index import SearchIndex
from feedlake.sources.tables import TableStore
from feedlake.sources.timeline_blocks import TimelineBlocks

#: Pages per feed body, a bound on what one body holds.
BODY_PAGES = 10
#: The square of a larger number of minutes is longer than an interval can be.
OLDEST_PAGE = 392_065


#: Search indexes, cadence states and timeline blocks of this session.
_STORED: dict[tuple, Any] = {}


class Given:
    """One scale factor's tables, read once per instance."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def new_folder(self, name: str) -> str:
        return new_folder(self.spark, name)

    # --- events: one feed per user -----------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def now(self) -> Column:
        """The newest insertion stands for the present."""
        return self.events.agg(F.max("ts")).scalar()

    @cached_property
    def feeds(self) -> DataFrame:
        users = self.events.groupBy("user_id").agg(
            F.max("ts").alias("last_checked_at"),
            F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success_at"),
            F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_inserted_at"),
        )
        return users.selectExpr(
            "user_id as id",
            "concat('https://feeds.example/', user_id) as url",
            "case when user_id % 3 <> 0 then concat('User ', user_id) end as title",
            """case when user_id % 4 = 0 then '   '
                    when user_id % 4 > 1 then concat('https://site.example/', user_id) end as site_url""",
            "case when user_id % 2 = 0 then concat('\"v', user_id, '\"') end as etag",
            "case when user_id % 5 < 3 then 'Mon, 01 Jan 2024 00:00:00 GMT' end as last_modified",
            "300 * (1 + user_id % 5) as poll_interval_seconds",
            "user_id % 5 <> 0 as is_enabled",
            "last_checked_at",
            "last_success_at",
            "last_inserted_at",
            "user_id % 4 as failure_count",
        ).select(*FEED_COLUMNS)

    @cached_property
    def items(self) -> DataFrame:
        return self.event_items(self.events)

    @staticmethod
    def event_items(events: DataFrame) -> DataFrame:
        return events.selectExpr(
            "event_id as id",
            "user_id as feed_id",
            "concat(event_type, '-', cast(floor(value) as bigint) % 10) as external_id",
            "concat(event_type, ' ', props) as title",
            "concat('https://example.com/', event_id, '#', event_id % 3) as url",
            "ts as inserted_at",
        )

    @cached_property
    def details(self) -> DataFrame:
        """Details of all items but errors, some published after insertion."""
        return self.events.filter("event_type <> 'error'").selectExpr(
            "event_id as id",
            "event_id as feed_item_id",
            "concat('<p>', event_type, '  ', props, '</p>') as summary",
            "props as content",
            "event_type as author",
            "timestampadd(SECOND, cast(event_id % 7 * 3600 - 10800 as int), ts) as published_at",
        )

    @cached_property
    def queue(self) -> DataFrame:
        return self.feeds.selectExpr(
            "id as feed_id",
            "timestampadd(SECOND, cast(poll_interval_seconds * 20 as int), last_checked_at) as due_at",
            "case when id % 3 <> 0 then last_checked_at end as leased_at",
            "case when id % 3 <> 0 then timestampadd(HOUR, 12, last_checked_at) end as lease_expires_at",
            "case when id % 3 <> 0 then md5(cast(concat('lease-', id) as binary)) end as lease_token",
            "failure_count as attempts",
            "last_checked_at as updated_at",
        ).select(*QUEUE_COLUMNS)

    @cached_property
    def outcomes(self) -> DataFrame:
        """One finished poll per event; every fifth with a stale lease."""
        return self.events.selectExpr(
            "user_id as feed_id",
            "event_id as seq",
            """case when event_id % 5 = 0 then 'stale'
                    else md5(cast(concat('lease-', user_id) as binary)) end as lease_token""",
            "ts as checked_at",
            f"""case event_type when 'error' then '{polling.FAILED}' when 'view' then '{polling.NOT_MODIFIED}'
                    else '{polling.FETCHED}' end as outcome""",
            "case when event_id % 2 = 0 then concat('Feed ', props) end as title",
            "cast(null as string) as site_url",
            "concat('\"e', event_id, '\"') as etag",
            "cast(null as string) as last_modified",
            "60 + cast(floor(value) as bigint) % 100 * 60 as resolved_interval",
        )

    @cached_property
    def entries(self) -> DataFrame:
        """All events as entries; those of a feed came with its first good poll."""
        first = self.events.groupBy("user_id").agg(
            F.min(F.expr("case when event_id % 5 <> 0 then event_id end")).alias("outcome_seq")
        )
        published = "timestampadd(SECOND, cast(event_id % 7 * 3600 - 10800 as int), ts)"
        plain = self.events.join(first, "user_id").selectExpr(
            "user_id as feed_id",
            "event_id as seq",
            "outcome_seq",
            "concat(event_type, '-', cast(floor(value) as bigint) % 10) as external_id",
            "concat(event_type, ' ', props) as title",
            "concat('https://example.com/', event_id, '#', event_id % 3) as url",
            "case when event_type <> 'error' then concat('<p>', event_type, '  ', props, '</p>') end as summary",
            "case when event_type not in ('error', 'signup') then props end as content",
            "case when event_type <> 'error' then event_type end as author",
            f"case when event_type not in ('error', 'purchase') then {published} end as published_at",
        )
        return plain

    @cached_property
    def stored_items(self) -> DataFrame:
        """What earlier polls stored: views and clicks, each key once."""
        seen = self.event_items(self.events.filter("event_type in ('view', 'click')"))
        first = seen.groupBy("feed_id", "external_id").agg(F.min("id").alias("id"))
        return seen.join(first.select("id"), "id", "left_semi").select(*ITEM_COLUMNS)

    @cached_property
    def stored_keys(self) -> KeyStore:
        """The keys of the stored items, as two earlier batches left them."""
        keys = KeyStore(self.spark, self.new_folder("item-keys"))
        stored = settled(self.stored_items.select("feed_id", "external_id", "id"), "stored-keys")
        for batch in (0, 1):
            keys.append(stored.filter(F.col("id") % 2 == batch), batch)
        return keys

    @cached_property
    def stored_details(self) -> DataFrame:
        return self._details_of(self.stored_items)

    def _details_of(self, items: DataFrame) -> DataFrame:
        ids = items.select(F.col("id").alias("feed_item_id"))
        return self.details.join(ids, "feed_item_id", "left_semi").select("id", "feed_item_id", *DETAIL_COLUMNS)

    @cached_property
    def consumers(self) -> DataFrame:
        def newest(kind: str) -> Column:
            return F.max(F.when(F.col("event_type") == kind, F.col("event_id")))

        users = self.events.groupBy(F.col("user_id").alias("consumer_id")).agg(
            newest("signup").alias("s"), newest("view").alias("query_id"), newest("click").alias("c")
        )
        return users.selectExpr(
            "consumer_id",
            "case when consumer_id % 10 = 0 then 'abc' else cast(s as string) end as header_id",
            "query_id",
            "cast(c as string) as stored_cursor",
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Items a consumer still shows."""
        return self.events.filter("value > 150").selectExpr("user_id as consumer_id", "event_id as id")

    @cached_property
    def logs(self) -> DataFrame:
        return self.events.selectExpr(
            "cast(ts as string) as timestamp",
            "case when event_type = 'error' then 'ERROR' else 'INFO' end as level",
            "case when user_id % 2 = 0 then 'GET' else 'POST' end as method",
            "concat('/api/', event_type) as route",
            "case event_type when 'error' then 'error' when 'view' then 'not_modified' else 'fetched' end as outcome",
            "cast(floor(value * 10) as bigint) as duration_ms",
        )

    @cached_property
    def links(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id as link_id",
            """concat('https://news.example/news?q=', event_type, case event_id % 9
                when 0 then concat('&source_id=', user_id) when 1 then concat('&feed_id=', user_id)
                when 2 then '&source_id=&feed_id=5' when 3 then '&source_id=abc' when 4 then '&source_id=1.5'
                when 5 then '&source_id=0&feed_id=9' when 6 then '&source_id=-1'
                when 7 then concat('&source_id=', user_id, '&feed_id=9') else '' end) as url""",
        )

    # --- documents: titled items of one feed per source ---------------------

    @cached_property
    def doc_items(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id as id",
            "cast(substr(source, 4) as bigint) as feed_id",
            "concat('doc-', doc_id) as external_id",
            "text as title",
            "concat('https://docs.example/', doc_id) as url",
            "timestampadd(MINUTE, cast(doc_id * 10 as int), timestamp_ntz'2024-01-01 00:00:00') as inserted_at",
        )

    @cached_property
    def doc_details(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id as id",
            "doc_id as feed_item_id",
            "concat('<p>', source, '</p>') as summary",
            "concat('language ', lang, ', ', n_chars, ' characters') as content",
            "lang as author",
            """timestampadd(MINUTE, cast(doc_id * 10 - doc_id % 5 * 60 as int),
                timestamp_ntz'2024-01-01 00:00:00') as published_at""",
        )

    @cached_property
    def doc_feeds(self) -> DataFrame:
        sources = self.table("documents").select("source").distinct()
        empty_time = "cast(null as timestamp_ntz)"
        return sources.selectExpr(
            "cast(substr(source, 4) as bigint) as id",
            "concat('https://docs.example/feeds/', source) as url",
            "case when cast(substr(source, 4) as bigint) % 3 <> 0 then concat('Source ', source) end as title",
            "cast(null as string) as site_url",
            "cast(null as string) as etag",
            "cast(null as string) as last_modified",
            "300L as poll_interval_seconds",
            "true as is_enabled",
            f"{empty_time} as last_checked_at",
            f"{empty_time} as last_success_at",
            f"{empty_time} as last_inserted_at",
            "0L as failure_count",
        )

    @property
    def doc_now(self) -> Column:
        return self.doc_items.agg(F.max("inserted_at")).scalar()

    def doc_index(self, recent: bool = False, nested: bool = False) -> DataFrame:
        if recent:
            return titles.title_index_recent(self.doc_items, self.doc_now, nested=nested)
        return titles.title_index(self.doc_items, nested=nested)

    # --- pages: raw entries and raw bodies ----------------------------------

    @cached_property
    def raw_entries(self) -> DataFrame:
        """Entries as publishers write them: ids, links, titles or dates may lack."""
        return self.table("pages").selectExpr(
            "page_id",
            "case when url like 'http://%' then '' else url end as guid",
            "case when url not like '%?%' then url end as link",
            "nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') as title",
            "cast(null as string) as summary",
            "html as content",
            "cast(null as string) as author",
            """case when url not like '%#%' then
                timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 61.001001) end as given""",
        )

    @cached_property
    def page_rows(self) -> DataFrame:
        """Pages as items with details, the later pages the older ones: a page's age is
        its id squared in minutes, from ``OLDEST_PAGE`` on the oldest that a time holds."""
        place = f"if(abs(page_id) > {OLDEST_PAGE}, {OLDEST_PAGE}, page_id)"
        return self.table("pages").selectExpr(
            "page_id as id",
            "page_id % 10 as feed_id",
            "url as external_id",
            "regexp_extract(html, '<title>(.*?)</title>', 1) as title",
            "url",
            f"""timestampadd(SECOND, -60 * {place} * {place}, timestamp_ntz'2024-03-01 00:00:00')
                as inserted_at""",
            "'' as summary",
            "html as content",
            "'' as author",
            "cast(null as timestamp_ntz) as published_at",
        )

    @cached_property
    def bodies(self) -> DataFrame:
        """Bodies of a few pages each, five dialects in turn: Atom, RSS 2.0, Atom
        with a prefix, JSON Feed, RSS 1.0."""

        def tag(name: str, value: str, attributes: str = "") -> str:
            return f"coalesce(concat('<{name}{attributes}>', {value}, '</{name}>'), '')"

        def atom(p: str) -> str:
            return f"""concat('<{p}entry>', {tag(p + "title", "x.title")},
                coalesce(concat('<{p}link href="', x.link, '" rel="alternate"/>'), ''), {tag(p + "id", "x.guid")},
                {tag(p + "content", "x.content", ' type="html"')}, '<{p}author><{p}name>Page author</{p}name></{p}author>',
                {tag(p + "published", "iso")}, '</{p}entry>')"""

        def rss(opening: str, guid: str, date: str) -> str:
            return f"""concat({opening}, {tag("title", "x.title")}, {tag("link", "x.link")}, {guid},
                {tag("description", "x.content")}, {date}, '</item>')"""

        rss2 = rss(
            "'<item>'", tag("guid", "x.guid", ' isPermaLink="false"'),
            tag("pubDate", "concat(date_format(given, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT')"),
        )
        rss1 = rss("""'<item rdf:about="', x.guid, '">'""", "''", tag("dc:date", "iso"))
        json = """to_json(struct(guid as id, link as url, title, content as content_html,
            array(struct('Page author' as name)) as authors, iso as date_published))"""
        columns = ("guid", "link", "title", "content")
        escaped = ", ".join(f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as {c}" for c in columns)
        page = self.raw_entries.selectExpr(
            "page_id", f"page_id div {BODY_PAGES} as body_id", *columns, "given",
            "date_format(given, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as iso", f"struct({escaped.replace(' as ', ' AS ')}) as x",
        )
        entries = page.selectExpr(
            "body_id",
            "page_id",
            f"""case body_id % 5 when 0 then {atom("")} when 1 then {rss2} when 2 then {atom("a:")}
                when 3 then {json} else {rss1} end as entry""",
        )
        # At most BODY_PAGES entries meet in one group.
        grouped = entries.groupBy("body_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "entry"))).alias("e"))
        inner = grouped.selectExpr(
            "body_id as feed_id", "body_id % 5 as dialect", "array_join(e.entry, if(body_id % 5 = 3, ',', '')) as inner",
            "concat('Pages ', body_id) as title", "concat('https://pages', body_id, '.example') as site",
        )
        return inner.selectExpr(
            "feed_id",
            """case dialect
               when 0 then concat('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>',
                title, '</title><link href="', site, '"/>', inner, '</feed>')
               when 1 then concat('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>', title,
                '</title><link>', site, '/home</link>', inner, '</channel></rss>')
               when 2 then concat('<?xml version="1.0"?><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>',
                title, '</a:title><a:link href="', site, '"/>', inner, '</a:feed>')
               when 3 then concat('{"version":"https://jsonfeed.org/version/1.1","title":"', title,
                '","home_page_url":"', site, '/home","items":[', inner, ']}')
               else concat('<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" ',
                'xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>', title,
                '</title><link>', site, '/home</link></channel>', inner, '</rdf:RDF>')
               end as body""",
        )

    @cached_property
    def responses(self) -> DataFrame:
        """What fetching each body returned: unchanged, errors, cut off, or fine."""
        return self.bodies.selectExpr(
            "feed_id",
            """case when feed_id % 11 = 4 then cast(null as int) when feed_id % 5 = 1 then 304
                    when feed_id % 5 = 2 then 503 else 200 end as status""",
            "case when feed_id % 7 = 3 then substr(body, 1, length(body) - 8) else body end as body",
        )

    @cached_property
    def feed_urls(self) -> DataFrame:
        """Urls people asked to add: padded, repeated, some blank."""
        return self.table("pages").selectExpr(
            "page_id as seq",
            "case when page_id % 20 = 7 then '   ' else concat('  ', split(url, '[?#]')[0], ' ') end as url",
        )

    @cached_property
    def known_feeds(self) -> DataFrame:
        """Feeds that were added before: the secure urls."""
        urls = (
            self.feed_urls.selectExpr("seq", "trim(url) as url")
            .filter("url like 'https://%'")
            .groupBy("url")
            .agg(F.min("seq").alias("seq"))
        )
        empty_time = "cast(null as timestamp_ntz)"
        return urls.selectExpr(
            "seq as id", "url", "cast(null as string) as title", "cast(null as string) as site_url",
            "cast(null as string) as etag", "cast(null as string) as last_modified",
            "900L as poll_interval_seconds", "true as is_enabled", f"{empty_time} as last_checked_at",
            f"{empty_time} as last_success_at", f"{empty_time} as last_inserted_at", "2L as failure_count",
        )

    @cached_property
    def searches(self) -> DataFrame:
        """Page titles as searches: bare words, a phrase, an exclusion, alternatives."""
        title = "filter(regexp_extract_all(regexp_extract(html, '<title>(.*?)</title>', 1), '[\\\\p{L}\\\\p{N}]+', 0), w -> lower(w) <> 'or')"
        w = [f"coalesce(get(w, {i}), '')" for i in range(6)]
        return self.table("pages").selectExpr("page_id as query_id", f"{title} as w").selectExpr(
            "query_id",
            f"""case query_id % 4
                when 0 then array_join(w, ' ')
                when 1 then concat('"', {w[0]}, ' ', {w[1]}, '"')
                when 2 then concat({w[0]}, ' ', {w[1]}, ' -', {w[2]})
                else concat({w[0]}, ' ', {w[1]}, ' ', {w[2]}, ' or "', {w[3]}, ' ', {w[4]}, '" ', {w[5]}) end as text""",
        )

    def _stored(self, kind: Callable, source: str, name: str, build: Callable[[Any], None]) -> Any:
        """A ``kind`` of store as a user has it: built once per session and state of
        the table ``source``, then only read."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{source}.parquet")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        summary = files.getContentSummary(root)
        state = f"{files.getFileStatus(root).getModificationTime()}-{summary.getLength()}-{summary.getFileCount()}"
        key = (self.spark.sparkContext.applicationId, shared_folder(self.spark), self.folder, state, name)
        if key not in _STORED:
            store = kind(self.spark, self.new_folder(name))
            build(store)
            _STORED[key] = store
        return _STORED[key]

    @property
    def cadence_state(self) -> CadenceState:
        """Cadence of all items in two batches, as they came."""

        def build(state: CadenceState) -> None:
            for batch in (0, 1):
                state.add(self.items.filter(F.col("id") % 2 == batch), self.details, batch)

        return self._stored(CadenceState, "events", "cadence-all", build)

    @property
    def stored_cadence(self) -> CadenceState:
        """Cadence of what earlier polls stored."""
        return self._stored(CadenceState, "events", "cadence-stored", lambda state: state.add(self.stored_items, self.stored_details))

    @property
    def timeline_blocks(self) -> TimelineBlocks:
        """Blocks of all items in two batches."""

        def build(blocks: TimelineBlocks) -> None:
            for batch in (0, 1):
                blocks.add(self.items.filter(F.col("id") % 2 == batch), self.details, batch)

        return self._stored(TimelineBlocks, "events", "blocks-events", build)

    @property
    def doc_blocks(self) -> TimelineBlocks:
        return self._stored(TimelineBlocks, "documents", "blocks-documents", lambda blocks: blocks.add(self.doc_items, self.doc_details))

    def filled_store(self) -> TableStore:
        """A new store with the feeds, the queue and what earlier polls stored."""
        def instants(rows: DataFrame) -> DataFrame:
            return rows.select(*[F.col(c).cast("timestamp").alias(c) if c.endswith("_at") or c == "lease_expires_at" else c for c in rows.columns])

        store = TableStore(self.spark, self.new_folder("store"))
        stored = settled(instants(self.stored_items), "stored-items")
        details = self._details_of(stored)
        for batch in (0, 1):
            mine = F.col("id") % 2 == batch
            items = stored.filter(mine)
            store.append("feed_item_details", instants(details).filter(mine), batch)
            store.append("feed_items", items, batch)
            store.keys(batch).append(items, batch)
        store.write_snapshot("feeds", instants(self.feeds), 1)
        store.write_snapshot("feed_update_queue", instants(self.queue), 1)
        return store

    @property
    def search_index(self) -> SearchIndex:
        """Items, details and feeds in one batch."""
        return self._stored(SearchIndex, "documents", "index-all", lambda index: index.add(self.doc_items, self.doc_details, self.doc_feeds))

    @property
    def item_index(self) -> SearchIndex:
        """Items in two batches, as they came."""

        def build(index: SearchIndex) -> None:
            for batch in (0, 1):
                index.add(self.doc_items.filter(F.col("id") % 2 == batch), None, None, batch)

        return self._stored(SearchIndex, "documents", "index-items", build)

    @property
    def new_index(self) -> SearchIndex:
        index = SearchIndex(self.spark, self.new_folder("search-index"))
        index.add(self.doc_items, self.doc_details, None)
        return index
