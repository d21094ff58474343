"""The split helpers equal plain windows, also when one key holds most rows."""

import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators import scale as SC


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(0, 400), rng.randint(0, 3)) for i in range(600)]
    return spark.createDataFrame(data, "k STRING, id LONG, t LONG, v INT").repartition(5)


def test_rank(rows):
    order = [F.col("t"), F.col("id")]
    got = SC.rank_in_groups(rows, ["k"], order, F.floor(F.col("t") / 50), "rn")
    want = rows.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, want.select("id", "rn").collect()))


def test_running_sum(rows):
    order = [F.col("t"), F.col("id")]
    got = SC.running_sum(rows, ["k"], order, F.floor(F.col("t") / 70), F.col("v"), "s")
    want = rows.withColumn("s", F.sum("v").over(W.partitionBy("k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.select("id", "s").collect())) == sorted(map(tuple, want.select("id", "s").collect()))


def test_previous_and_next(rows):
    order = [F.col("t"), F.col("id")]
    win = W.partitionBy("k").orderBy(*order)
    seg = F.floor(F.col("t") / 30)
    got = SC.previous_row(rows, ["k"], order, seg, F.col("v"), "p").select("id", "p")
    want = rows.withColumn("p", F.lag("v").over(win)).select("id", "p")
    key = lambda r: (r[0], str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    value = F.when(F.col("v") == 2, F.col("id"))
    got = SC.next_value(rows, ["k"], order, seg, value, "n").select("id", "n")
    later = win.rowsBetween(1, W.unboundedFollowing)
    want = rows.withColumn("n", F.first(value, ignorenulls=True).over(later)).select("id", "n")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_salted_join_equals_join(spark, rows):
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "k STRING, w INT")
    for how in ("inner", "left"):
        got = SC.salted_join(rows, small, ["k"], ["id"], how, salts=5).select("id", "w")
        want = rows.join(small, "k", how).select("id", "w")
        key = lambda r: (r[0], str(r[1]))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_cut_lineage_uses_the_named_folder(spark, rows):
    assert SC.cut_lineage(rows).count() == 600


def _plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_bm25_never_shuffles_query_document_pairs(spark):
    from kgspark.operators.lexical import keyword_hits

    docs = spark.createDataFrame([(i, f"w{i % 7} common words") for i in range(50)], "doc_id LONG, text STRING")
    queries = spark.createDataFrame([(1, "w3 common"), (2, "w5")], "query_id LONG, text STRING")
    plan = _plan(keyword_hits(docs, queries, 3))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line]
    assert not [line for line in shuffles if "doc_id" in line]
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bm25_shuffles_no_texts(spark):
    from kgspark.operators.lexical import keyword_hits

    docs = spark.createDataFrame([(i, f"w{i % 7} common words") for i in range(50)], "doc_id LONG, text STRING")
    plan = _plan(keyword_hits(docs, docs.limit(2).withColumnRenamed("doc_id", "query_id"), 3))
    assert "text" not in plan  # postings are a table of their own by then


def test_dense_search_funnels_neither_side(spark):
    from kgspark.operators.vectors import approximate_nearest, nearest

    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id LONG, embedding ARRAY<DOUBLE>").repartition(4)
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    centres = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 1.0])], "cell INT, embedding ARRAY<DOUBLE>")
    exact = nearest(corpus, queries, 3)
    shuffled = nearest(corpus, queries, 3, broadcast_bytes=0)
    near = approximate_nearest(corpus, queries, 3, centres, probes=2, threshold=0.15)
    for found in (exact, shuffled, near):
        assert "SinglePartition" not in _plan(found)
    want = sorted(map(tuple, exact.collect()))
    assert sorted(map(tuple, shuffled.collect())) == want and sorted(map(tuple, near.collect())) == want


def test_hashed_embedding_shuffles_nothing(spark):
    from kgspark.operators.vectors import hashed_embedding

    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id LONG, text STRING")
    plan = _plan(hashed_embedding(docs, "doc_id"))
    assert plan.count("Exchange") == 0


def test_chunking_shuffles_nothing(spark):
    from kgspark.operators import chunking as C

    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id LONG, text STRING")
    assert "Exchange" not in _plan(C.chunk_rows(docs, C.fixed_windows(F.col("text"), 2, 1)))
    assert "Exchange" not in _plan(C.text_units(docs))


def test_written_tables_are_discarded(spark):
    from kgspark.operators.scale import discard, written

    table = written(spark.range(10))
    files = table.inputFiles()
    discard(table)
    assert files and not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in files)
