"""Centroid clustering, vector codes and source mixing against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import centroids, mixing, vector_codes
from feedlake.llm.integers import matrix

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    extra = {"x": F.lit("x"), "cluster": F.lit(1), "key": F.lit(2.0), "code": F.lit("c"), "error": F.lit(3)}
    return spark.createDataFrame(rows, VECTORS).withColumns(extra)


def usable(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]


def odd_rows(dims):
    return [
        (None, [0.5] * dims, None),
        (1 << 53, [0.25] * dims, 1),
        ((1 << 53) + 1, [0.25] * dims, 1),
        (7, None, 1),
        (8, [None] * dims, 1),
        (9, [NAN] + [0.0] * (dims - 1), 2),
        (10, [INF] + [0.0] * (dims - 1), 2),
        (11, [0.0] * (dims - 1), 2),
        (12, [], 2),
        (13, [0.0] * dims, None),
        (13, [0.0] * dims, None),
        (14, [1e5] * dims, 3),
    ]


def clouds(rng, n, dims, groups):
    middles = rng.normal(0, 3, (groups, dims))
    return [(100 + i, [float(np.float32(x)) for x in middles[i % groups] + rng.normal(0, 0.2, dims)], i % 3) for i in range(n)]


# -- op11


def plain_clusters(rows, k, rounds, scale, dims):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in usable(rows, dims)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middles = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(middles)]
    return Counter((i, c, d) for i, (d, c) in ((i, nearest(v)) for i, v in kept)), middles


@pytest.mark.parametrize("k,rounds", [(5, 3), (16, 3), (40, 6), (1, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = clouds(np.random.default_rng(k), 400, 6, 8) + odd_rows(6)
    want, middles = plain_clusters(rows, k, rounds, 64, 6)
    found = centroids.clustered(vectors(spark, rows), clusters=k, rounds=rounds, dims=6)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.rows.collect()) == want
    assert found.centroids == middles
    report = centroids.cluster_report(found).collect()
    for r in report:
        own = [x for x in want.elements() if x[1] == r.cluster]
        assert r.cluster_inertia == sum(x[2] for x in own)
        assert r.inertia == sum(x[2] for x in want.elements())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middles[r.cluster])).encode()).hexdigest()


def test_only_expired_vectors_are_scanned_again(spark):
    # far groups settle after the first round: nothing is due any more
    rows = clouds(np.random.default_rng(3), 600, 8, 4)
    found = centroids.clustered(vectors(spark, rows), clusters=4, rounds=6, dims=8)
    assert found.scanned[0] == 600
    assert found.scanned[-1] == 0
    want, _ = plain_clusters(rows, 4, 6, 64, 8)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.rows.collect()) == want


def test_few_or_no_vectors_cluster(spark):
    rows = [(1, [0.0, 1.0], 1), (2, [3.0, 1.0], 1)]
    found = centroids.clustered(vectors(spark, rows), dims=2)
    assert {r.vec_id: r.distance for r in found.rows.collect()} == {1: 0, 2: 0}
    empty = centroids.cluster_report(centroids.clustered(vectors(spark, rows).limit(0), dims=2))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# -- op13


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(9)
    for scale in (3, 50, 1 << 30):
        values = rng.integers(-scale, scale, (500, 4))
        book = rng.integers(-scale, scale, (16, 4))
        book[5] = book[2]  # a tie in every row
        entries = [[int(x) for x in e] for e in book]
        chosen, best, computed = vector_codes.equal_average_search(matrix_of(values), entries)
        for v, e, d in zip(values.tolist(), chosen, best):
            assert (int(d), int(e)) == min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(entries))
        assert computed < 500 * 16


def matrix_of(values):
    import pandas as pd

    return matrix(pd.Series(list(values.astype(float))), values.shape[1])


def plain_codes(rows, parts, entries, rounds, scale, dims):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in usable(rows, dims)]
    start = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    w = dims // parts
    books = [[v[p * w : p * w + w] for v in start] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, m)), e) for e, m in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = v[p * w : p * w + w]
                groups.setdefault(nearest(part, book)[1], []).append(part)
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else m for e, m in enumerate(book)]
    out = []
    for i, v, label in kept:
        found = [nearest(v[p * w : p * w + w], book) for p, book in enumerate(books)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def test_codes_equal_plain_rounds(spark):
    rows = clouds(np.random.default_rng(4), 300, 8, 5) + odd_rows(8)
    want, books = plain_codes(rows, 4, 16, 6, 4096, 8)
    found = vector_codes.coded(vectors(spark, rows), parts=4, dims=8)
    assert found.codebooks == books
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.code_report(found).collect())
    assert got == Counter((i, label, c, e, sums[label], digest) for i, label, c, e in want)
    assert vector_codes.decoded(want[0][2], books)[0] == (books[0][int(want[0][2][:2], 16)][0] + 0.5) / 4096


def test_no_vectors_no_codes(spark):
    rows = vectors(spark, [(1, None, 1)])
    assert vector_codes.code_report(vector_codes.coded(rows)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.coded(rows, parts=7)


# -- op12

DOCS = "doc_id long, text string, source string"


def documents(spark, rows):
    extra = {c: F.lit(9) for c in ("size", "target", "q", "digest", "copies", "m", "n_chars")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra)


def corpus(rng, sizes):
    rows = []
    for source, lengths in sizes.items():
        rows += [(len(rows) + i, " ".join(f"w{rng.randrange(50)}" for _ in range(n)), source) for i, n in enumerate(lengths)]
    return rows


def water_filled(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left = set(names), sum(sizes.values())
    goal = {}
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if most * sizes[s] <= w[s] * level]
        if not full:
            return goal | {s: w[s] * level for s in free}
        for s in full:
            goal[s] = most * sizes[s]
            left -= goal[s]
            free.discard(s)
    return goal


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    sizes = {
        "hot": [rng.randrange(1, 60) for _ in range(900)],
        "b": [rng.randrange(1, 200) for _ in range(200)],
        "tiny": [3, 4, 5],
        None: [rng.randrange(1, 90) for _ in range(300)],
        "": [10] * 40,
    }
    rows = corpus(rng, sizes)
    rows += [(None, "same row twice", "b"), (None, "same row twice", "b"), (5000, None, "b"), (5001, "", "hot"), (5002, " \t ", "only empty")]
    docs = documents(spark, rows)
    got = mixing.mixture(docs).collect()
    total = Counter()
    for _, t, s in rows:
        total[s] += len((t or "").split())
    goal = water_filled(total)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    for s in total:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == total[s] and math.isclose(r.target, goal[s]) for r in own)
        assert all(0 <= r.copies <= 3 for r in own)
        # floor and ceiling of the rate, and nothing else
        rate = goal[s] / total[s] if total[s] else 0
        assert {r.copies for r in own} <= {math.floor(rate + 1e-9), math.ceil(rate - 1e-9)}
        assert abs(sum(r.size * r.copies for r in own) - goal[s]) <= max([r.size for r in own], default=0) / 2
    again = mixing.mixture(docs.repartition(7)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    other = mixing.mixture(docs, seed="2").collect()
    assert Counter((r.doc_id, r.copies) for r in other) != Counter((r.doc_id, r.copies) for r in got)
    words = mixing.mixed_documents(docs, mixing.mixture(docs)).collect()
    assert sum(len(r.text.split()) for r in words) == sum(r.size * r.copies for r in got)


def test_pareto_order_prefers_appealing_documents(spark):
    rows = [(i, "one two three four", "s" if i < 1000 else "t") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixture(docs, appeal=F.when(F.col("doc_id") % 2 == 0, 3.0)).collect()
    own = [r for r in got if r.source == "t"]
    assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 4
    even = sum(r.copies for r in own if r.doc_id % 2 == 0)
    odd = sum(r.copies for r in own if r.doc_id % 2)
    assert even > 2 * odd > 0


def test_many_equal_rows_share_copies(spark):
    rows = [(1, "a b c", "s")] * 9000 + [(2, "d e", "t")]
    got = mixing.mixture(documents(spark, rows)).collect()
    own = [r.copies for r in got if r.doc_id == 1]
    goal = water_filled({"s": 27000, "t": 2})["s"]
    assert len(own) == 9000
    assert abs(3 * sum(own) - goal) <= 1.5


def test_empty_mix(spark):
    assert mixing.mixture(documents(spark, [(1, "x", "s")]).limit(0)).count() == 0
    only = mixing.mixture(documents(spark, [(1, None, "s"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.copies * r.size) for r in only] == [(0, 0.0, 0)] * 2
