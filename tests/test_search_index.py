"""The positional index against the search predicate on the texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import small
from feedlake.functions import matching
from feedlake.operators import items as item_ops
from feedlake.operators import search
from feedlake.sources import search_index
from feedlake.sources.search_index import DETAIL, FEED, ITEM, SearchIndex, alternatives

VOCABULARY = ["ash", "birch", "cedar", "elm", "fir", "oak-leaf", "pine.", "<b>rowan</b>", "søk", "Ümlaut", "or", "7"]


def phrase(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def searches(rng):
    words = ["ash", "birch", "cedar", "elm", "Fir", "leaf", "pine", "rowan", "SØK", "missing", "docs.example", "localhost"]
    pieces = [
        lambda: rng.choice(words),
        lambda: "-" + rng.choice(words),
        lambda: f'"{rng.choice(words)} {rng.choice(words)}"',
        lambda: f'-"{rng.choice(words)} {rng.choice(words)}"',
        lambda: f'"{rng.choice(words)} or {rng.choice(words)}"',
        lambda: "or",
        lambda: "oak-leaf",
        lambda: rng.choice(['"unclosed ash', "--", '""', "!", '-"', "f.example"]),
    ]
    return [" ".join(rng.choice(pieces)() for _ in range(rng.randint(1, 5))) for _ in range(60)]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(17)
    rows = [(i, i % 4 + 1, phrase(rng, rng.randint(0, 9)), "00:00:00") for i in [*range(1, 60), *range(5000, 5020), 700_000]]
    items = small.items(spark, *rows).withColumn("url", F.when(F.col("id") % 7 == 0, "http://localhost/").otherwise(F.col("url")))
    details = small.details(spark, *[(r[0], phrase(rng, 3), phrase(rng, 4), "2024-01-01T00:00:00") for r in rows if r[0] % 3])
    feeds = small.feeds(spark, *[(i, {"title": phrase(rng, 3) if i % 2 else None}) for i in (1, 2, 3, 4)])
    return items, details, feeds


@pytest.fixture(scope="module")
def index(spark, documents, tmp_path_factory):
    """In two batches that share blocks, one of them written twice."""
    items, details, feeds = documents
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
    index.add(items.filter("id % 2 = 0"), details, None, 0)
    for _ in range(2):
        index.add(items.filter("id % 2 = 1"), None, feeds, 1)
    return index


def test_grammar_as_a_column(spark):
    texts = [*searches(random.Random(3)), "", "   ", "or or", 'a"b c"d', "x -y OR z", None, "-", "a\tb\nc", "word " * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", alternatives(F.col("text")).alias("a")).collect():
        got = [[(t.negated, " ".join(t.words)) for t in alternative] for alternative in r.a]
        assert got == matching.query_terms(r.text or ""), r.text


def test_hits_equal_the_predicate(spark, documents, index):
    items, details, feeds = documents
    texts = [*searches(random.Random(5)), "", "-missing", "ash or -ash", "ash " * 200]
    queries = spark.createDataFrame([*enumerate(texts), (99_999, None)], "query_id long, text string")
    got = {tuple(r) for r in index.hits(queries).collect()}
    sides = [
        (ITEM, items, "id", matching.item_document(F.col("title"), F.col("url"))),
        (DETAIL, details, "feed_item_id", matching.detail_document(F.col("summary"), F.col("content"), F.col("author"))),
        (FEED, feeds, "id", matching.feed_document(F.col("title"), F.col("url"))),
    ]
    want = set()
    for kind, rows, key, doc in sides:
        flags = rows.select(key, F.array(*[matching.matches(doc, t) for t in texts]))
        want |= {(q, kind, r[0]) for r in flags.collect() for q, hit in enumerate(r[1]) if hit}
    assert got == want
    assert {k for _, k, _ in got} == {ITEM, DETAIL, FEED}


def test_timeline_by_index_equals_timeline_by_text(documents, index):
    items, details, feeds = documents
    for query in ("ash birch", '"ash birch" or elm', "-ash", "cedar -fir or -missing rowan", "absent"):
        for limit in (None, 5):
            by_text = item_ops.timeline(items, details, feeds, limit=limit, query=query)
            by_index = item_ops.timeline(items, details, feeds, limit=limit, query=query, index=index)
            assert [r.id for r in by_index.collect()] == [r.id for r in by_text.collect()], query


def test_no_text_is_tokenised_at_search_time(spark, index, monkeypatch):
    plan = search.search_batch(index, spark.createDataFrame([(1, "ash")], "query_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "title" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_blocks_without_the_rarest_word_are_not_met(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_IDS", 8)
    rows = [(i, 1, "common rare" if i == 77 else "common", "00:00:00") for i in range(200)]
    index = SearchIndex(spark, str(tmp_path))
    index.add(small.items(spark, *rows), None, None)
    assert index.postings().filter("token = 'common'").count() == 25
    found = search.search_batch(index, spark.createDataFrame([(1, "common rare"), (2, "common -rare")], "query_id long, text string"))
    got = sorted(map(tuple, found.collect()))
    assert got == [(1, 77)] + [(2, i) for i in range(200) if i != 77]


def test_empty_index_and_empty_searches(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    index.add(small.items(spark), small.details(spark), small.feeds(spark))
    queries = spark.createDataFrame([(1, "ash"), (2, "-ash")], "query_id long, text string")
    assert index.hits(queries).count() == 0
    assert index.hits(queries.limit(0)).count() == 0


def test_many_searches_in_parts_of_bounded_size(spark, documents, index, monkeypatch):
    """equal and repeated searches, evaluated part by part and block by block."""
    texts = searches(random.Random(29))[:25] * 2
    queries = spark.createDataFrame([*enumerate(texts), (0, "cedar"), (None, "ash")], "query_id long, text string")
    want = {tuple(r) for r in index.hits(queries).collect()}
    for name, value in (("WORD_ROWS", 40), ("TASK_PAIRS", 50), ("PUSHED_WORDS", 3)):
        monkeypatch.setattr(search_index, name, value)
    got = [tuple(r) for r in index.hits(queries).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(k, i) for q, k, i in want if q == 3} == {(k, i) for q, k, i in want if q == 28}


def test_no_lists_are_gathered_for_a_search(spark, index):
    """what is moved between tasks are bitmaps, however long a word's list is."""
    plan = index.hits(spark.createDataFrame([(1, '"ash birch" elm -fir')], "query_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "map_from_entries" not in text and "bits0" in text


def test_texts_are_moved_once_to_be_indexed(documents):
    """a block's texts are dealt out, its lists stay where they are built."""
    rows = search_index._lists(documents[0], ITEM, "id", ["title"], "url")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_searches_are_never_held_by_the_driver(spark, index, monkeypatch):
    """searches in parts were broadcast together, so the driver held all of them."""
    monkeypatch.setattr(search_index, "WORD_ROWS", 40)
    queries = spark.createDataFrame([*enumerate(searches(random.Random(31)))], "query_id long, text string")
    text = index.hits(queries)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "Union" not in text


def test_many_askers_of_one_search(spark, index, monkeypatch):
    """those who ask the same are dealt out in rows of bounded length."""
    texts = ["ash", "cedar or -birch", '"ash birch" -elm']
    want = {t: {(r.kind, r.id) for r in index.hits_of(t).collect()} for t in texts}
    monkeypatch.setattr(search_index, "ASKERS", 4)
    got = index.hits(spark.createDataFrame([(q, texts[q % 3]) for q in range(90)], "query_id long, text string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(q, *d) for q in range(90) for d in want[texts[q % 3]]}
