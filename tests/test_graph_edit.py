import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph_build as G
from kgspark.operators import graph_edit as X


def follow(mapping):
    first = {}
    for s, t in sorted((s, t) for s, t in mapping if s is not None and t is not None and s != t):
        first.setdefault(s, t)
    out = {}
    for s in first:
        seen, at = {s}, first[s]
        while at in first and at not in seen:
            seen.add(at)
            at = first[at]
        cyclic = at in first
        out[s] = (first[s] if cyclic else at, cyclic)
    return out


def test_chains_end_and_cycles_are_told(spark):
    rng = random.Random(1)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(100)] + [("a100", "end"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("tail", "c2"), ("self", "self"), ("two", "x"), ("two", "b"), (None, "x"), ("x", None)]
    pairs += [(f"r{i}", f"r{rng.randrange(60)}") for i in range(40)]
    rng.shuffle(pairs)
    got = X.resolve_merges(spark.createDataFrame(pairs, "source string, target string")).collect()
    assert {r["source"]: (r["target"], r["cyclic"]) for r in got} == follow(pairs) and len(got) == len(follow(pairs))
    assert X.resolve_merges(spark.createDataFrame([], "source string, target string")).count() == 0


def test_merge_keeps_the_graph_whole(spark):
    nodes = spark.createDataFrame(
        [("a", 1, "T1", "x<SEP>y", "first"), ("b", 2, "", "y<SEP>z", None), ("c", 3, "T3", "z", "third"), ("d", 4, "T4", None, ""), ("o", 5, "T5", "q", "other")],
        "name string, position long, entity_type string, source_id string, description string",
    )
    edges = spark.createDataFrame([("a", "o", 1, 2.0), ("o", "b", 2, 5.0), ("a", "b", 3, 9.0), ("d", "o", 4, 1.0)], "src string, tgt string, position long, weight double")
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("gone", "c"), ("d", "o"), ("o", "d")], "source string, target string")
    n, e, left = X.merge_graph(nodes, edges, mapping, {"entity_type": "keep_last", "source_id": "join_unique", "description": "concatenate"}, {"weight": "max"})
    assert sorted(map(tuple, n.collect())) == [("c", "T3", "x<SEP>y<SEP>z", "first\n\nthird", 3), ("d", "T4", "", "", 1), ("o", "T5", "q", "other", 1)]
    assert sorted(map(tuple, e.collect())) == [("c", "o", 5.0, 2), ("d", "o", 1.0, 1)]
    assert sorted((r["source"], r["reason"]) for r in left.collect()) == [("d", "cycle"), ("gone", "missing"), ("o", "cycle")]
    with pytest.raises(ValueError):
        X.merge_graph(nodes, edges, mapping, {"entity_type": "median"}, {})


def test_edges_follow_renames(spark):
    nodes = spark.createDataFrame([("a", "T", "d"), ("b", "T", "d"), ("c", "T", "d")], "name string, entity_type string, description string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, tgt string, weight double")
    changes = spark.createDataFrame(
        [("a", "z", None, None), ("b", "y", "N", None), ("c", "z", None, None), ("gone", "g", None, None)], "name string, new_name string, entity_type string, description string"
    )
    n, e, rejected = X.edit_graph(nodes, edges, changes)
    assert sorted((r["name"], r["entity_type"]) for r in n.collect()) == [("c", "T"), ("y", "N"), ("z", "T")]
    assert sorted(map(tuple, e.collect())) == [("c", "y", 2.0), ("y", "z", 1.0)]
    assert sorted((r["name"], r["reason"]) for r in rejected.collect()) == [("c", "taken"), ("gone", "missing")]


def test_relations_are_checked_and_edited(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    edges = spark.createDataFrame([("a", "b", 1.0, "k")], "src string, tgt string, weight double, keywords string")
    new = spark.createDataFrame([("b", "a"), ("c", "a"), ("a", "c"), ("a", "x"), ("b", "b")], "src string, tgt string")
    created, rejected = X.create_relations(new, edges, nodes)
    assert [tuple(r) for r in created.collect()] == [("a", "c")]
    assert sorted(map(tuple, rejected.collect())) == [("a", "b", "exists"), ("a", "x", "missing end")]
    changes = spark.createDataFrame([("b", "a", 4.0, None), ("a", "c", 1.0, "n")], "src string, tgt string, weight double, keywords string")
    after, missing = X.edit_relations(edges, changes)
    assert [tuple(r) for r in after.collect()] == [("a", "b", 4.0, "k")] and missing.count() == 1


def test_stored_edges_are_closed_by_incoming_ones(spark):
    rows = [(i, f"s{i % 2}", "r", f"t{i % 3}", i, 100 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "relation_id long, src string, relation_type string, tgt string, position long, at long")
    whole = {tuple(r)[:6] for r in X.supersede_onto(None, df).collect()}
    parts = {tuple(r)[:6] for r in X.supersede_onto(df.where("position < 5"), df.where("position >= 5")).collect()}
    assert whole == parts and {r[:6] for r in whole} == {tuple(r)[:6] for r in G.supersede(df).select("src", "relation_type", "tgt", "relation_id", "status", "superseded_by").collect()}
    closed = X.supersede_onto(None, df).where(F.col("status") == "superseded").collect()
    assert closed and all(r["invalid_at"] == 100 + r["superseded_by"] for r in closed)
