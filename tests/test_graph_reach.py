import math
from hashlib import sha256

from pyspark.sql import functions as F

from kgspark.operators import graph_query as N
from kgspark.operators.vectors import SLOTS, hashed_embedding
from kgspark.plans.catalog import graph_query

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING"


def test_labels_are_worked_out_once_per_document(spark, tmp_path, monkeypatch):
    docs = [(i, f"word common{i % 3} tail", "en", "s") for i in range(40)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word here"), (2, "common2 there")], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    cut, plain = spark.sparkContext.accumulator(0), graph_query._labelled

    def counted(batches):
        for batch in batches:
            cut.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(graph_query, "_labelled", lambda spark, sf: plain(spark, sf).mapInArrow(counted, "name LONG, label STRING"))
    assert graph_query.n13(spark, str(tmp_path)).count() > 0
    assert cut.value == len(docs)


def test_hashed_embedding_is_the_share_of_each_slot(spark):
    texts = {1: "b a b", 2: "", 3: None, 4: "Ünïcode x", 5: "w " * 3 + "知识图谱"}
    words = {1: ["b", "a", "b"], 2: [], 3: [], 4: ["n", "code", "x"], 5: ["w", "w", "w", "知识", "识图", "图谱"]}
    rows = hashed_embedding(spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING"), "doc_id").collect()
    for doc, tokens in words.items():
        counts = {}
        for t in tokens:
            at = int(sha256(t.encode()).hexdigest()[-4:], 16) % SLOTS
            counts[at] = counts.get(at, 0) + 1
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert {r["slot"]: r["w"] for r in rows if r["doc_id"] == doc} == {s: n / norm for s, n in counts.items()}


def test_sparse_product_equals_the_join_and_the_lexical_parts_grow(spark, monkeypatch):
    from kgspark.operators import lexical, vectors

    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 5} d{i}") for i in range(200)], "doc_id LONG, text STRING")
    asked = spark.createDataFrame([(i, f"a b{i} c{i}") for i in range(5)], "query_id LONG, text STRING")
    sides = hashed_embedding(docs, "doc_id"), hashed_embedding(asked, "query_id")
    seen = []
    for cells in (vectors.ASKED_CELLS, 0):
        monkeypatch.setattr(vectors, "ASKED_CELLS", cells)
        seen.append({(r["query_id"], r["doc_id"]): (r["rank"], round(r["score"], 9)) for r in vectors.sparse_hits(*sides, 30).collect()})
    assert seen[0] == seen[1] and len(seen[0]) == 150
    monkeypatch.setattr(lexical, "MEETINGS", 50)
    plan = lexical.bm25_scores(docs, asked)._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and "REPARTITION_BY_NUM" in plan


def test_hops_read_edges_that_are_worked_out_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        asked.add(1)
        return name

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, tgt string")
    edges = edges.select(F.explode(F.array(counted("src"))).alias("src"), "tgt", F.lit("").alias("label"))
    seeds = spark.createDataFrame([(1, "a", 1.0, 1)], "query_id int, name string, seed_score double, position int")
    paths = {(r["name"], r["hop"]) for r in N.expand_paths(seeds, edges, hops=3).collect()}
    assert paths == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert asked.value <= 6
