import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import quantised
from kgspark.operators import vectors as V
from kgspark.operators.quantised import QuantisedIndex, similar_pairs


def some_vectors(n, dims, clusters, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(clusters, 1), dims)) * (2 if clusters else 0)
    mat = rng.standard_normal((n, dims)) + centres[rng.integers(0, max(clusters, 1), n)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(mat)]
    return [*rows, (n, None), (n + 1, []), (n + 2, [float("nan")] * dims), (n + 3, [1.0] * (dims - 1)), (n + 4, [0.0] * dims), (n + 5, [None] + [1.0] * (dims - 1))]


def hits(df):
    return {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_while_a_fifth_is_scored(spark, tmp_path, clusters):
    rows = some_vectors(2000, 24, clusters)
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    index = QuantisedIndex(spark, str(tmp_path / "index")).build(df.where("doc_id < 1500 OR doc_id >= 2000"))
    index.add(df.where("doc_id >= 1500 AND doc_id < 2000"))
    asked = df.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    again = QuantisedIndex(spark, str(tmp_path / "index"))  # opened by its folder alone
    exact = hits(V.nearest(df.where("doc_id < 2000"), asked.where("query_id < 2000"), 10))
    found = hits(again.search(asked, 10, 400))
    want, got = ({(q, d) for (q, _), (d, _) in x.items()} for x in (exact, found))
    assert len(want) == 200 and len(want & got) >= 0.9 * len(want)
    few = again.search(asked.where("query_id < 2000"), 10, 2100, threshold=0.3)  # a pool of all is exact
    assert hits(few) == {k: v for k, v in exact.items() if v[1] >= 0.3}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, embedding array<float>")
    index = QuantisedIndex(spark, str(tmp_path / "index"))
    df = spark.createDataFrame(some_vectors(20, 5, 0), "doc_id long, embedding array<float>")
    index.build(df)
    assert index.search(none.withColumnRenamed("doc_id", "query_id"), 3, 5).count() == 0
    assert similar_pairs(none, 0.8, 3).count() == 0


def test_similar_pairs_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + 0.35 * rng.standard_normal(16)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + some_vectors(0, 16, 0)  # many equal ones, and odd ones
    rows += [(900, [0.0] * 16), (901, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 8)) for r in similar_pairs(df, 0.8, 3).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    want = {}
    for i, a in good:
        near = [(round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 10), j) for j, b in good if j != i]
        near = sorted(((s, j) for s, j in near if s >= 0.8), key=lambda x: (-x[0], x[1]))[:3]
        want |= {(i, r + 1): (j, round(s, 8)) for r, (s, j) in enumerate(near)}
    assert found == want and len(want) > 500


def test_similar_pairs_never_makes_rows_of_all_pairs_in_a_bucket(spark, monkeypatch):
    plans, cut = [], quantised.cut_lineage
    monkeypatch.setattr(quantised, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().toString()), cut(df))[1])
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in 1 + 0.01 * rng.standard_normal(8)]) for i in range(300)]  # all in one cluster
    found = similar_pairs(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), 0.8, 3)
    assert found.count() == 900
    assert not any("Join" in line and "bucket" in line for plan in plans for line in plan.splitlines())
