import math
import random

import numpy as np
from pyspark.sql import functions as F

from kgspark.operators import evaluation as E
from kgspark.operators import fusion as R
from kgspark.operators import lexical as L
from kgspark.operators import vectors as V


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "")], "doc_id INT, text STRING")
    queries = spark.createDataFrame([(7, "a a b")], "query_id INT, text STRING")
    got = {r["doc_id"]: r["score"] for r in L.bm25_scores(docs, queries).collect()}
    avg = 5 / 3
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert abs(got[1] - (2 * part(2, 3, 1) + part(1, 3, 2))) < 1e-12
    assert abs(got[2] - part(1, 2, 2)) < 1e-12 and 3 not in got


def test_bm25_scope_sees_only_its_own(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "x", "b")], "doc_id INT, text STRING, kb STRING")
    queries = spark.createDataFrame([(1, "x", "a")], "query_id INT, text STRING, kb STRING")
    assert [r["doc_id"] for r in L.bm25_scores(docs, queries, ["kb"]).collect()] == [1]


def _vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[5] = m[2]  # an exact copy
    return m, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "doc_id LONG, embedding ARRAY<DOUBLE>")


def test_nearest_against_numpy_with_small_blocks(spark):
    m, corpus = _vectors(spark, 120, 6, 1)
    q, queries = _vectors(spark, 9, 6, 2)
    queries = queries.withColumnRenamed("doc_id", "query_id")
    hits = V.nearest(corpus.repartition(3), queries, 4, None, salts=3, corpus_block=16, query_block=4).collect()
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    for i in range(9):
        want = sorted(range(120), key=lambda j: (-round(sims[i, j], 10), j))[:4]
        assert [r["doc_id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_approximate_search_recall(spark):
    _, corpus = _vectors(spark, 300, 6, 3)
    _, queries = _vectors(spark, 12, 6, 4)
    queries = queries.withColumnRenamed("doc_id", "query_id")
    exact = {(r["query_id"], r["doc_id"]) for r in V.nearest(corpus, queries, 5, None).collect()}
    cells = V.index_cells(corpus, 6)
    near = {(r["query_id"], r["doc_id"]) for r in V.approximate_nearest(corpus, queries, 5, cells, probes=4).collect()}
    assert len(exact & near) / len(exact) > 0.8
    full = {(r["query_id"], r["doc_id"]) for r in V.approximate_nearest(corpus, queries, 5, cells, probes=6).collect()}
    assert full == exact  # with all cells the search is exact


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert [r["c"] for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, None]


def test_synonyms_turn_distances(spark):
    near = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 0.1), ("a", "c", 0.6)], "query_id STRING, doc_id STRING, score DOUBLE")
    got = [(r["doc_id"], round(r["score"], 6)) for r in V.synonym_targets(near).collect()]
    assert got == [("b", 0.9)]


def test_rebuild_index_checks_before_publishing(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0], "o"), (2, [0.0, 1.0], "o")], "doc_id INT, embedding ARRAY<DOUBLE>, owner_id STRING")
    path = V.rebuild_index(v, v.select("doc_id"), v.select("doc_id", "embedding"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "current")).first()["version"] == path
    turned = v.withColumn("embedding", F.reverse("embedding"))
    try:
        V.rebuild_index(turned, v.select("doc_id"), v.select("doc_id", "embedding"), str(tmp_path / "index"))
        raise AssertionError("a bad index was published")
    except ValueError:
        assert spark.read.parquet(str(tmp_path / "index" / "current")).first()["version"] == path


def test_weighted_polling_against_loops(spark):
    rng = random.Random(6)
    owners = [[f"o{i}c{j}" for j in range(rng.randint(0, 7))] for i in range(5)]

    def brute(lists, most, least=1):
        n = len(lists)
        if n == 1:
            return lists[0][:most]
        want = [int(round(most - i / (n - 1) * (most - least))) for i in range(n)]
        out, used, spare = [], [], 0
        for chunks, w in zip(lists, want):
            k = min(w, len(chunks))
            out += chunks[:k]
            used.append(k)
            spare += w - k
        for _ in range(spare):
            i = next((i for i in range(n) if used[i] < len(lists[i])), None)
            if i is None:
                break
            out.append(lists[i][used[i]])
            used[i] += 1
        return out

    for lists in (owners, owners[:1], [o for o in owners if o]):
        rows = [(1, i, j, c) for i, o in enumerate(lists) for j, c in enumerate(o)]
        df = spark.createDataFrame(rows or [(9, 0, 0, "x")], "query_id INT, owner_pos INT, chunk_pos INT, chunk_id STRING")
        places = spark.createDataFrame([(1, i) for i in range(len(lists))], "query_id INT, owner_pos INT")
        picked = R.weighted_polling(R.owner_chunks(df), places, 4).filter("query_id = 1").orderBy("rank")
        assert [r["chunk_id"] for r in picked.collect()] == brute(lists, 4)


def brute_parents(hits, limit, max_parents=6, budget=4500):
    chosen, order, used, per_doc = [], [], 0, {}
    docs = {h["doc_id"] for h in hits}
    for h in hits:
        p = h["parent_id"] or h["chunk_id"]
        if p not in order:
            if len(order) >= max_parents or (order and used + h["parent_tokens"] > budget):
                continue
            order.append(p)
            used += h["parent_tokens"]
        if len(chosen) >= limit:
            break
        if per_doc.get(h["doc_id"], 0) >= 3 and len(docs) > 1:
            continue
        per_doc[h["doc_id"]] = per_doc.get(h["doc_id"], 0) + 1
        chosen.append(h["rank"])
    return chosen


def test_parents_against_loop(spark):
    rng = random.Random(2)
    rows = []
    for q in range(6):
        for i in range(1, 31):
            d = rng.choice("abcd")
            p = rng.choice(["", f"{d}{rng.randint(0, 3)}"])
            size = 100 + 50 * (ord(p[-1]) if p else i) % 1700
            rows.append((q, i, f"{q}-{i}", d, p, size))
    df = spark.createDataFrame(rows, "query_id INT, rank INT, chunk_id STRING, doc_id STRING, parent_id STRING, parent_tokens INT")
    got = R.aggregate_parents(df, 8).collect()
    for q in range(6):
        hits = [dict(zip(df.columns, r)) for r in rows if r[0] == q]
        assert sorted(r["rank"] for r in got if r["query_id"] == q) == brute_parents(hits, 8)


def test_path_bundles_prefixes(spark):
    rows = [(1, 1, "a", 1, "p", "A", 0.1), (1, 2, "b", 2, "p → q", "B", 0.5), (1, 3, "c", 0, None, "C", 0.3), (1, 4, "d", 2, "x", "D", None)]
    df = spark.createDataFrame(rows, "query_id INT, rank INT, chunk_id STRING, hop INT, path STRING, content STRING, raw_score DOUBLE")
    got = R.path_bundles(df).orderBy("bundle").collect()
    assert [(b["path_id"], [m["chunk_id"] for m in b["members"]], b["raw_score"]) for b in got] == [("p → q", ["a", "b"], 0.5), ("x", ["d"], 0.0), ("c", ["c"], 0.3)]
    flat = R.expand_bundles(R.path_bundles(df).withColumn("admission_score", F.lit(0.9))).orderBy("rank").collect()
    assert [r["chunk_id"] for r in flat] == ["a", "b", "d", "c"]


def test_budget_stops_before_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "query_id INT, rank INT, n INT")
    assert [r["rank"] for r in R.within_budget(df, F.col("n"), 10).collect()] == [1]
    assert R.within_budget(df, F.col("n"), 0).count() == 0


def test_admission_and_threshold(spark):
    df = spark.createDataFrame([(1, 1, 0.25, None), (1, 2, None, 0.2)], "query_id INT, doc_id INT, vector_score DOUBLE, keyword_score DOUBLE")
    got = {r["doc_id"]: r["admission_score"] for r in R.admit(df, "vector").collect()}
    assert abs(got[1] - 0.5) < 1e-12 and got[2] is None
    kept = R.by_threshold(R.admit(df.withColumn("score", F.lit(0.9)), "vector"), 0.2)
    assert [r["doc_id"] for r in kept.collect()] == [1]  # without a judged signal a hit is not trusted
    plain = R.by_threshold(df.withColumn("score", F.lit(0.9)), 0.2)
    assert sorted(r["doc_id"] for r in plain.collect()) == [1, 2]
    assert R.snap_ratio(0.4) == 0.5 and R.snap_ratio(2) == 1.0


def test_forged_citations_are_removed(spark):
    answers = spark.createDataFrame([(1, "a [C1] b [C9]", "k"), (2, "x [C2]", "k")], "query_id INT, answer STRING, kb_id STRING")
    cites = spark.createDataFrame([(1, "C1", "d", "k", None), (2, "C2", "d", "other", None)], "query_id INT, citation_id STRING, doc_id STRING, kb_id STRING, version_id STRING")
    kept = R.validate_citations(answers, cites)
    got = {r["query_id"]: (r["answer"], r["answerable"]) for r in R.cleaned_answers(answers, kept).collect()}
    assert got == {1: ("a [C1] b", True), 2: (R.REFUSAL, False)}


def test_fit_floor(spark):
    rows = [("sep", "positive", 0.8), ("sep", "irrelevant", 0.4), ("mix", "positive", 0.0), ("mix", "positive", 0.3), ("mix", "hard_negative", 0.5), ("none", "irrelevant", 0.5)]
    df = spark.createDataFrame(rows, "k STRING, label STRING, score DOUBLE")
    assert {r["k"]: r["floor"] for r in E.fit_floor(df, ["k"]).collect()} == {"sep": 0.6, "mix": 0.29, "none": 0.25}


def test_quality_gate(spark):
    off = spark.createDataFrame([("mix", 0.9, 0.0, 0, None), ("graph", 0.9, 0.0, 0, 1.0)], "mode STRING, recall_5 DOUBLE, false_return_rate DOUBLE, leaks INT, multihop DOUBLE")
    on = spark.createDataFrame([("mix", 0.8, 0.1, 1, None), ("graph", 0.9, 0.0, 0, 0.5)], off.schema)
    got = {r["mode"]: r["failures"] for r in E.quality_gate(off, on).collect()}
    assert got == {"mix": ["leaks", "recall", "false_returns"], "graph": ["multihop"]}
