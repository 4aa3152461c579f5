"""Column functions on literal cases and against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import at
from feedlake.functions import links, matching, scores, text, times


def apply(spark, values, kind, build):
    """``build`` applied to a column of values, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_stop_word_lists():
    assert len(text.DEFAULT_STOP_WORDS) == 249
    assert len(set(text.DEFAULT_STOP_WORDS)) == 244


@pytest.mark.parametrize(
    ("title", "words"),
    [
        ("Rust, rust! state of the art --rust--", ["rust", "rust", "state", "of", "the", "art", "rust"]),
        ("Blåbær på ØYA", ["blåbær", "på", "øya"]),
        ("caféra naïve x", ["caf", "ra", "na", "ve"]),
        # A kelvin sign lower-cases to k but is no title letter.
        ("abKcd", ["ab", "cd"]),
        ("", []),
    ],
)
def test_long_words(spark, title, words):
    assert apply(spark, [title], "string", text.long_words) == [words]


def test_external_ids(spark):
    cases = {
        "https://news.example/a/c4gy#8": "https://news.example/a/c4gy",
        "https://news.example/a/c4gy#0#1": "https://news.example/a/c4gy",
        "urn:uuid:1234#x": "urn:uuid:1234#x",
        "https://example.com/1": "https://example.com/1",
        "HTTP://example.com/#1": "HTTP://example.com/#1",
    }
    assert apply(spark, list(cases), "string", text.normalize_external_id) == list(cases.values())
    twice = apply(
        spark, list(cases), "string", lambda c: text.normalize_external_id(text.normalize_external_id(c))
    )
    assert twice == list(cases.values())


def test_external_id_choice(spark):
    rows = [("", "https://a.example/x#4", "T", "d"), ("g#1", "l", "T", "d"), ("", None, "T", None), (None, None, None, "d")]
    df = spark.createDataFrame(rows, "g string, l string, t string, d string")
    got = [r[0] for r in df.select(text.external_id(*[F.col(c) for c in "gltd"])).collect()]
    assert got == ["https://a.example/x", "g#1", "fallback:T:", "fallback::d"]


def test_compact_preview_truncate(spark):
    assert apply(spark, ["<p>a <b>b</b></p>\n  c ", "  "], "string", text.compact_text) == ["a b c", ""]
    assert apply(spark, ["hello world"] * 2, "string", lambda c: text.truncate(c, 8)) == ["hello w…"] * 2
    assert apply(spark, ["hello world"], "string", lambda c: text.truncate(c, 7)) == ["hello…"]
    assert apply(spark, ["short"], "string", lambda c: text.truncate(c, 5)) == ["short"]
    df = spark.createDataFrame([("<i></i>", "body"), (None, None), ("s", "c")], "s string, c string")
    assert [r[0] for r in df.select(text.preview_text(F.col("s"), F.col("c"))).collect()] == ["body", "", "s"]


def test_names(spark):
    df = spark.createDataFrame(
        [(" T ", "s", "u"), ("  ", " s ", "u"), (None, "\t", "u"), ("", None, "u")], "t string, s string, u string"
    )
    assert [r[0] for r in df.select(text.feed_name(F.col("t"), F.col("s"), F.col("u"))).collect()] == ["T", "s", "u", "u"]
    assert [r[0] for r in df.select(text.feed_label(F.col("t"), F.col("u"))).collect()] == [" T ", "  ", "u", ""]


def test_host(spark):
    cases = {
        "https://www.foo.bar.com/x": "foo.bar.com",
        "http://EXAMPLE.com:80/": "example.com",
        "https://user:pw@h.example?q": "h.example",
        "not a url": "",
        "": "",
    }
    assert apply(spark, list(cases), "string", links.host) == list(cases.values())
    assert apply(spark, ["https://example.com", "https://example.com/a"], "string", links.with_root_path) == [
        "https://example.com/",
        "https://example.com/a",
    ]


def test_source_ids(spark):
    base = "https://n.example/news"
    cases = {
        "?source_id=7": 7, "?feed_id=8": 8, "?source_id=7&feed_id=8": 7, "?source_id=&feed_id=8": None, "": None,
        "?source_id=abc": None, "?source_id=1.5": None, "?source_id=0": None, "?source_id=-1": None,
        "?source_id=1e2": 100, "?source_id=0x1F": 31, "?source_id=3.0": 3, "?source_id=%20%204": 4,
        "?source_id=NaN": None, "?source_id=1d": None,
    }
    assert apply(spark, [base + q for q in cases], "string", links.source_id) == list(cases.values())


def test_topic_link(spark):
    assert apply(spark, ["ai safety"], "string", lambda c: links.topic_link(c, F.lit(7))) == [
        "/news?q=ai+safety&source_id=7"
    ]


def test_ages(spark):
    now = at("2024-03-01T00:00:00")
    import datetime as dt

    gaps = {59: "just now", 60: "1m ago", 3600: "1h ago", 86400 * 29: "29d ago", 86400 * 31: "2024-01-30", -5: "just now"}
    stamps = [now - dt.timedelta(seconds=s) for s in gaps]
    assert apply(spark, stamps, "timestamp", lambda c: times.age_label(c, F.lit(now))) == list(gaps.values())


def test_interval_labels(spark):
    cases = {45: "45s", 59: "59s", 60: "1m", 90: "1m 30s", 3600: "1h", 3661: "1h 1m", 7260: "2h 1m", 3601: "1h"}
    assert apply(spark, list(cases), "bigint", times.interval_label) == list(cases.values())


def test_date_labels(spark):
    got = apply(spark, [None, "", "nonsense", "2024-01-02 03:04:05"], "string", times.date_label)
    assert got == ["Never", "Never", "Unknown", "2024-01-02 03:04"]


def test_feed_dates(spark):
    cases = {
        "Mon, 01 Jan 2024 10:00:00 GMT": at("2024-01-01T10:00:00"),
        "1 Jan 2024 10:00:00 +0200": at("2024-01-01T08:00:00"),
        "2026-07-01T10:00:00Z": at("2026-07-01T10:00:00"),
        "2026-07-01T10:00:00.25+01:00": at("2026-07-01T09:00:00.250000"),
        "soon": None,
        None: None,
    }
    assert apply(spark, list(cases), "string", times.feed_date) == list(cases.values())


def test_rfc3339(spark):
    stamps = [at("2024-01-01T00:00:07"), at("2024-01-01T00:00:07.250000"), at("2024-01-01T00:00:07.000125")]
    assert apply(spark, stamps, "timestamp", lambda c: times.rfc3339(c, "Z")) == [
        "2024-01-01T00:00:07Z", "2024-01-01T00:00:07.250Z", "2024-01-01T00:00:07.000125Z",
    ]


def test_intervals(spark):
    rng = random.Random(1)
    values = [rng.randint(-(2**63), 2**63 - 1) for _ in range(50)] + [0, 1, 29, 30, 31, 2999, 3000, 3001, 6000, 9000, None]

    def clamp(v):
        return max(60, min(6000, v))

    assert apply(spark, values, "bigint", scores.resolved_interval) == [6000 if v is None else clamp(v) for v in values]
    known = [v for v in values if v is not None]
    assert apply(spark, known, "bigint", scores.backoff_interval) == [clamp(2 * v) for v in known]

    def repeat(v, n):
        for _ in range(n):
            v = clamp(2 * v)
        return v

    for n in (0, 1, 2, 5, 40):
        got = apply(spark, known, "bigint", lambda c, n=n: scores.repeated_backoff(c, F.lit(n).cast("long")))
        assert got == [repeat(v, n) for v in known]


def test_cadence_choice(spark):
    rows = [(100.4, 2, 50.0, 9), (100.5, 1, 50.5, 2), (None, 0, 50.0, 1), (None, 0, None, 0)]
    df = spark.createDataFrame(rows, "mp double, np long, mi double, ni long")
    got = [r[0] for r in df.select(scores.cadence_choice(*[F.col(c) for c in ("mp", "np", "mi", "ni")])).collect()]
    assert got == [100, 51, None, None]


def test_scores(spark):
    rows = [(10, 5, 5), (4, 3, 3), (2, 1, 3), (1, 1, 10), (5, 1, 10), (3, 0, 4), (3, 1, 0)]
    df = spark.createDataFrame(rows, "t long, d long, n long")
    s = [r[0] for r in df.select(scores.tf_idf(F.col("t"), F.col("d"), F.col("n"))).collect()]
    assert s[0] == 0 and s[1] == 0 and s[2] > 0 and s[3] < s[4] < 5 * s[3] and s[5] == s[6] == 0


def test_display_scales(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    lit = F.lit
    assert one(scores.rescale(lit(5.0), lit(0.0), lit(10.0), 0.75, 3.0)) == 1.875
    assert one(scores.rescale(lit(5.0), lit(5.0), lit(5.0), 0.75, 3.0)) == 1.875
    shares = {0.71: "top", 0.7: "high", 0.41: "high", 0.4: "medium", 0.21: "medium", 0.2: "low", 0.0: "low"}
    for share, band in shares.items():
        assert one(scores.score_band(lit(share), lit(1.0))) == band
    assert one(scores.score_band(lit(0.0), lit(0.0))) == "none"
    assert one(scores.bar_share(lit(1), lit(200))) == 2.0
    assert one(scores.bar_share(lit(50), lit(200))) == 25.0
    assert one(scores.bar_share(lit(0), lit(0))) == 2.0


@pytest.mark.parametrize(
    ("query", "hits"),
    [
        ("harbour", {0, 1}),
        ("HARBOUR ferries", {0}),
        ('"ferries harbour"', set()),
        ('"harbour ferries"', {0}),
        ("orchard or ferries", {0, 2}),
        ("harbour -ferries", {1}),
        ("-harbour", {2}),
        ('-"harbour ferries" harbour', {1}),
        ("docs.example", {0, 1, 2}),
        ("!!! --", set()),
        ("or", set()),
        ("strong", set()),
        ("søk", {2}),
    ],
)
def test_search_queries(spark, query, hits):
    rows = [(0, "Harbour ferries <strong>notes"), (1, "<b>harbour</b>-side"), (2, "Orchard SØK")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("u", F.lit("https://docs.example/7"))
    doc = matching.document([F.col("t")], F.col("u"))
    found = {r.i for r in df.filter(matching.matches(doc, query)).collect()}
    assert found == hits


def test_blank_query():
    assert matching.clean_query("  ") is None and matching.clean_query(None) is None
    assert matching.clean_query(" a ") == "a"


def test_token_set(spark):
    df = spark.createDataFrame([("A a-b <i>c</i>", "https://x.example/a")], "t string, u string")
    got = df.select(matching.token_set([F.col("t")], F.col("u"))).first()[0]
    assert sorted(got) == sorted(["a", "b", "c", "https", "x", "example", "x.example"])


def test_null_order_is_an_error(spark):
    from feedlake.operators.keys import assign_ids

    rows = spark.createDataFrame([(1,), (None,)], "seq long")
    with pytest.raises(Exception, match="seq is null"):
        assign_ids(rows, "seq").collect()
