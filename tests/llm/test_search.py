import math
import random

import pytest
from pyspark.sql import functions as F

from kgspark.llm import search


def by_hand(rows, k, step):
    good = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[vec_id] = [math.floor(64 * x) for x in v]
    want = []
    for q in good:
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], good[d])), d) for d in good if d != q)
            want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(scores[:k])]
    return sorted(want)


def test_hits_are_those_of_all_pairs(spark, shared, monkeypatch):
    for name, value in (("BLOCK", 4), ("RANGE", 16), ("GROUP", 3)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(8)
    rows = [(i * 3, [rng.choice([-2.0, -0.7, 0.0, 0.3, 1.9, 40.25]) for _ in range(6)]) for i in range(150)]
    rows += [(1000, None), (1005, [1.0, None] * 3), (1010, [math.nan] * 6), (1015, [math.inf] * 6), (1020, [0.5] * 6), (1025, [1.0, 2.0]), (1030, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, q string")
    for k in (1, 20, 500):
        got = search.top_k(df, F.col("vec_id") % 5 == 0, k).collect()
        assert sorted(map(tuple, got)) == by_hand(rows, k, 5)


def test_no_vectors_no_hits(spark, shared):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.top_k(df, F.col("vec_id") % 5 == 0, 3).count() == 0
    one = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>")
    assert search.top_k(one, F.col("vec_id") % 5 == 0, 3).count() == 0


def test_every_row_counts(spark, shared, monkeypatch):
    for name, value in (("BLOCK", 4), ("RANGE", 16), ("GROUP", 3)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-9, 9)) for _ in range(5)]) for i in range(1, 60)]
    rows += [(101, [9.0, 9.0, 9.0, 9.0, 9.0])] * 30  # the best of many queries, more often than k
    rows += [rows[6], rows[6], rows[9], rows[9], (10, [1.0] * 5)]  # repeated candidates and queries
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (3, 20):
        want = []
        for q in {i for i, _ in good if i % 5 == 0}:
            own = [v for i, v in good if i == q]
            scores = sorted((-sum(a * b for a, b in zip(v, w)), d) for v in own for d, w in good if d != q)
            want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(scores[:k])]
        got = search.top_k(df, F.col("vec_id") % 5 == 0, k).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_great_components_are_not_cut(spark, shared):
    """The greatest vector times itself is beyond 64 bits, but no score is."""
    rows = [(0, [2e6, 1.0]), (2, [3e6, 0.0]), (3, [4e6, 0.5]), (5, [-5e6, 3.0]), (7, [2e8, -1e5]), (8, [1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in search.top_k(df, F.col("vec_id").isin(0, 8), 5).orderBy("query_id", "rank").collect()]
    q = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    assert got == [(a, b, s) for a in (0, 8) for s, b in sorted(((sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a), key=lambda x: (-x[0], x[1]))]


def test_scores_beyond_64_bits_raise(spark, shared):
    for top in (1e10, 1e18):
        df = spark.createDataFrame([(0, [top]), (1, [top])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="exceeds 62 bits"):
            search.top_k(df, F.lit(True), 5).collect()
