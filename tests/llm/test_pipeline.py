"""Every stage of the pipeline on planted documents, against plain Python on the stage's own input."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from feedlake.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score string, row_key string, key string"
BIG = 9007199254740993


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} - {()}


def windows(text, n=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return words, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def contaminated(text, items):
    words = windows(text)[0]
    hit = set()
    for window in items:
        for i in range(len(words) - len(window) + 1):
            if tuple(words[i : i + len(window)]) == window:
                hit.update(range(i, i + len(window)))
    return bool(hit) and 20 * len(hit) >= len(words)


def planted():
    """Rows of documents, labels and a benchmark."""
    rng = random.Random(11)

    def prose(n):
        return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(60)}" for _ in range(n)]

    rows, labels = [], []
    for i in range(240):
        words = prose(rng.randrange(20, 60))
        poor, toxic = i % 6 == 0, i % 6 == 1
        if poor:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[3] = words[9] = f"vexo{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if poor else 1, int(toxic)))
    items = [(f"i{k}", " ".join(prose(n))) for k, n in enumerate((14, 30, 5, 0, 13))]
    plain = [t for i, t in rows if i % 6 > 1]
    for k, text in enumerate(plain[:6]):
        words = text.split()
        words[-1] = "other"
        rows.append((300 + k, " ".join(words)))  # near copies
        rows.append((320 + k, text))  # exact copies
    rows += [(340, plain[7] + " " + items[0][1]), (341, items[2][1]), (342, " ".join(prose(900)) + " " + items[4][1])]
    # one id with texts that have nothing in common, one with a copy, rows without an id, ids beyond a double
    rows += [(350, " ".join(prose(30))), (350, " ".join(prose(30))), (350, plain[8]), (351, plain[9]), (351, plain[9])]
    rows += [(None, " ".join(prose(25))), (None, plain[10]), (BIG, " ".join(prose(25))), (BIG + 2, " ".join(prose(25)))]
    lonely = " ".join(prose(25))
    rows += [(None, lonely), (None, lonely), (360, None), (361, ""), (362, None), (None, None), (363, "one"), (363, "one")]
    return rows, labels, items


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows, labels, items = planted()
    docs = [(i, t, None, "s", None, "x", "y", "z") for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = df.collect()
    assert all((r._score, r.row_key, r.key) == ("x", "y", "z") for r in got)
    return Counter((r.doc_id, r.text) for r in got)


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.read.parquet(f"{given}/documents.parquet")


@pytest.mark.parametrize("stage, judge, kept", [
    (pipeline.good_quality, quality.quality_scores, 1), (pipeline.not_toxic, toxicity.toxicity_scores, 0)
])
def test_classifiers_keep_what_their_scores_accept(spark, given, docs, stage, judge, kept):
    got = rows_of(stage(spark, docs, given))
    scored = judge(docs.drop("_score"), spark.read.parquet(f"{given}/labels.parquet"))
    want = Counter(r.doc_id for r in scored.collect() if r.predicted == kept)
    found = Counter()
    for (doc_id, _), n in got.items():
        found[doc_id] += n
    assert found == want
    planted_ids = range(0, 240, 6) if kept else range(1, 240, 6)
    assert sum(i in found for i in planted_ids) <= 2
    assert sum(i in found for i in range(240) if i % 6 > 1) >= 158


def test_one_of_each_against_all_pairs(spark, given, docs):
    found = rows_of(pipeline.one_of_each(spark, docs, given))
    assert set(found.values()) == {1}
    rows = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    nodes = list(rows)
    sets = [shingles(t) for _, t in nodes]
    group = list(range(len(nodes)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    texts = Counter()
    for (doc_id, _), n in rows.items():
        texts[doc_id] += n
    groups = {}
    for x, node in enumerate(nodes):
        groups.setdefault(root(x), []).append(node)
    assert len(found) == len(groups) < len(nodes) < sum(rows.values())
    for members in groups.values():
        kept = [m for m in members if m in found]
        own = [m[0] for m in members if m[0] is not None and texts[m[0]] == 1]
        assert len(kept) == 1 and (not own or kept[0][0] == min(own))
    # texts of one id that are no copies all stay
    assert sum(n for (i, _), n in found.items() if i == 350) == 2
    assert {BIG, BIG + 2} <= {i for i, _ in found}


def test_one_of_each_beyond_large_ids(spark, given, docs):
    high = docs.withColumn("doc_id", F.when(F.col("doc_id") == BIG, F.lit(2**63 - 1)).otherwise(F.col("doc_id")))
    assert sum(rows_of(pipeline.one_of_each(spark, high, given)).values()) == sum(
        rows_of(pipeline.one_of_each(spark, docs, given)).values()
    )
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {i for i, _ in rows_of(pipeline.one_of_each(spark, nameless, given))} == {None}
    assert not rows_of(pipeline.one_of_each(spark, docs.limit(0), given))


def test_contaminated_documents_go(spark, given, docs):
    items = {w for _, text in planted()[2] for w in windows(text)[1]}
    rows = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = Counter({row: n for row, n in rows.items() if not contaminated(row[1], items)})
    assert rows_of(pipeline.uncontaminated(spark, docs, given)) == want
    assert {340, 341} == {i for i, _ in rows - want}


def test_run_packs_what_the_stages_keep(spark, given, docs):
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, given).collect(), SCHEMA)
    pieces = pipeline.run(spark, given).collect()
    starts = Counter(r.doc_id for r in pieces if r.piece == 0)
    assert starts == Counter(r.doc_id for r in left.select("doc_id").collect())
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for taken in places.values():
        end = 0
        for offset, length in sorted(taken):
            assert offset == end
            end += length
        assert end <= 1024
