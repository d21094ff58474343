import math

import pytest
from pyspark.sql import functions as F

from kgspark.operators.lexical import single_bm25
from kgspark.plans import search as Q

DOCS = "doc_id LONG, text STRING, kb_id STRING, owner_id STRING"


def index(spark):
    rows = [(1, "red apple pie", "k", "o"), (2, "green apple tree", "k", "o"), (3, "blue sky", "k", ""), (4, "nothing alike", "k", "o")]
    return Q.TextIndex(spark.createDataFrame(rows, DOCS))


def asked(spark):
    return spark.createDataFrame([(1, "red apple")], "query_id LONG, text STRING")


def test_unknown_modes_raise(spark):
    for mode in ("graf", "", "graph", "mix"):  # the last two need what the graph found
        with pytest.raises(ValueError):
            Q.search(index(spark), asked(spark), mode)


def test_graph_mode_ranks_by_the_paths_score_and_hides_what_nobody_owns(spark):
    found = spark.createDataFrame(
        [(1, 2, 1, "a", 0.5, 0.9, 1.0, 0.4), (1, 1, 0, "b", 0.6, 0.8, 0.0, 0.6), (1, 3, 0, "c", 0.9, 0.8, 0.0, 0.9)],
        "query_id LONG, chunk_id LONG, hop INT, path STRING, score DOUBLE, vector_score DOUBLE, keyword_score DOUBLE, ranking_score DOUBLE",
    )
    rows = Q.search(index(spark), asked(spark), "graph", 10, found=found).orderBy("rank").collect()
    assert [(r["doc_id"], r["ranking_score"]) for r in rows] == [(1, 0.6), (2, 0.4)]
    assert Q.search(index(spark), asked(spark), "graph", 1, found=found).count() == 0  # its one place is not shown


def test_mix_scores_chunks_by_cosine_or_keywords_and_entities_take_places(spark):
    i, q = index(spark), asked(spark)
    chunks = spark.createDataFrame([(1, 1, 1), (1, 2, 4), (1, 3, 2)], "query_id LONG, rank INT, chunk_id LONG")
    entities = spark.createDataFrame([(1, "Apple", 0.99), (1, "Pie", None)], "query_id LONG, name STRING, score DOUBLE")
    none = spark.createDataFrame([], "query_id LONG, src STRING, tgt STRING, score DOUBLE")
    found = Q.mix_hits(i, q, chunks, entities, none, 10)
    score = {r["doc_id"]: r["score"] for r in found.collect()}
    assert score[1] == pytest.approx(2 / math.sqrt(6)) and score[2] == pytest.approx(1 / math.sqrt(6))
    assert score[4] == 0 and score[None] == 0.99
    rows = Q.search(i, q, "mix", 3, found=found).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in rows] == [(1, 2), (2, 3)]


def test_bm25_of_one_text(spark):
    df = spark.createDataFrame([("red red apple", "red pie red tree")], "q STRING, t STRING")
    got = df.select(single_bm25(F.col("q"), F.col("t")).alias("s")).first()["s"]
    assert got == pytest.approx(2 * math.log(1 + 0.5 / 1.5) * 2 * 2.5 / (2 + 1.5))


def test_ablation_searches_once_for_all_variants(spark):
    from kgspark.operators import evaluation as E

    class Counting(Q.TextIndex):
        passes = 0

        def lexical(self, queries, k):
            self.passes += 1
            return super().lexical(queries, k)

    docs = index(spark).docs
    asked_of = [(1, "red apple", "k", "", True), (2, "blue和sky", "k", "", True), (3, "zebra", "k", "", False)]
    questions = spark.createDataFrame(asked_of, "query_id LONG, text STRING, kb_id STRING, owner_id STRING, answerable BOOLEAN")
    expected = spark.createDataFrame([(1, 1), (2, 3)], "query_id LONG, unit_id LONG")
    counting = Counting(docs)
    found = {(r["variant"], r["parents"]): r.asDict() for r in Q.ablation(counting, questions, expected).collect()}
    assert counting.passes == 1
    for force in ("single", "subquestions"):
        hits = Q.staged(Q.TextIndex(docs), questions.select("query_id", "text"), "hybrid", 8, threshold=0.5, force=force)
        placed = hits.join(docs.select("doc_id", "kb_id", "owner_id"), "doc_id").withColumnRenamed("doc_id", "unit_id")
        alone = E.metrics(E.question_metrics(questions.drop("text"), expected, placed)).first().asDict()
        assert alone == {k: v for k, v in found[force, True].items() if k not in ("variant", "parents")}
    assert len(found) == 6
