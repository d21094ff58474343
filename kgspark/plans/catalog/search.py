"""Composite retrieval: modes, staged search, bundles, parents, KG questions, ablation."""

from pyspark.sql import functions as F

from kgspark.functions.text import token_count
from kgspark.hooks import token_overlap
from kgspark.operators import fusion as R
from kgspark.operators import graph_build as G
from kgspark.operators import vectors as V
from kgspark.operators.scale import cut_lineage
from kgspark.plans import domain as D
from kgspark.plans import search as Q
from kgspark.plans import sqlparts as S
from kgspark.plans.catalog.quality import _expected, _questions
from kgspark.plans.registry import query

_c = F.col


def _index(spark, sf):
    return Q.TextIndex(D.docs(spark, sf))


_PUBLIC = """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, lang AS kb_id, source AS owner_id, round(s, 4) AS ranking_score, round(a, 4) AS admission_score,
  round(v, 4) AS vector_score, round(k, 4) AS keyword_score FROM h JOIN documents USING (doc_id) WHERE a >= {limit}"""


@query(
    "R21_search_vector",
    f"""WITH {S.DENSE}, h AS (SELECT query_id, doc_id, score AS s, score AS v, CAST(NULL AS DOUBLE) AS k, 1 / (1 + exp(-(score - 0.25::DOUBLE) / 0.08::DOUBLE)) AS a FROM dense WHERE rank <= 10) {_PUBLIC.format(limit="0.9")}""",
)
def r21_vector(spark, sf):
    return Q.search(_index(spark, sf), D.queries(spark, sf), "vector", 10, threshold=0.9)


@query(
    "R21_search_keyword",
    f"""WITH {S.KEYWORD}, h AS (SELECT query_id, doc_id, score AS s, CAST(NULL AS DOUBLE) AS v, score AS k, 1 / (1 + exp(-(score - 0.15::DOUBLE) / 0.06::DOUBLE)) AS a FROM keyword WHERE rank <= 10) {_PUBLIC.format(limit="0.5")}""",
)
def r21_keyword(spark, sf):
    return Q.search(_index(spark, sf), D.queries(spark, sf), "keyword", 10, threshold=0.3)


@query(
    "R21_search_hybrid",
    f"""WITH {S.KEYWORD}, {S.DENSE}, f AS (SELECT query_id, doc_id, coalesce(d.score, 0) AS v, coalesce(k.score, 0) AS k FROM (FROM dense WHERE rank <= 10) d FULL JOIN (FROM keyword WHERE rank <= 10) k USING (query_id, doc_id)),
    g AS (SELECT *, 0.5::DOUBLE * v + 0.5::DOUBLE * k AS s FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.5::DOUBLE * v + 0.5::DOUBLE * k, 9) DESC, doc_id) <= 10),
    h AS (SELECT *, 1 / (1 + exp(-(s - 0.22::DOUBLE) / 0.08::DOUBLE)) AS a FROM g) {_PUBLIC.format(limit="0.5")}""",
)
def r21_hybrid(spark, sf):
    return Q.search(_index(spark, sf), D.queries(spark, sf), "hybrid", 10, threshold=0.5)


@query("R21_search_tree")
def r21_tree(spark, sf):
    guess = D.queries(spark, sf).withColumn("text", F.concat("text", F.lit(" "), F.reverse("text")))
    return Q.search(_index(spark, sf), D.queries(spark, sf), "tree", 10, hypothetical=guess)


@query("R21_search_reranked")
def r21_reranked(spark, sf):
    return Q.search(_index(spark, sf), D.queries(spark, sf), "hybrid", 5, scorer=token_overlap)


@query("R21_search_graph")
def r21_graph(spark, sf):
    from kgspark.plans.catalog.graph_query import reached

    found = reached(spark, sf, 10)
    return Q.search(_index(spark, sf), D.queries(spark, sf), "graph", 10, threshold=0.5, found=found)


@query("R21_search_mix")
def r21_mix(spark, sf):
    index, asked = _index(spark, sf), D.queries(spark, sf)
    entities, relations, chunks = _kg(spark, sf, "mix")
    chunks = cut_lineage(chunks)
    # Labels of vectors ask the graph; the benchmark text of the same number asks the index.
    scored = V.nearest(D.vectors(spark, sf), D.label_queries(spark, sf), 10)
    known = scored.select("query_id", F.concat(F.lit("P"), "doc_id").alias("name"), "score")
    mine = entities.join(known, ["query_id", "name"], "left")
    theirs = relations.withColumn("score", F.lit(None).cast("double"))
    found = Q.mix_hits(index, asked, chunks, mine, theirs, 10)
    return Q.search(index, asked, "mix", 10, found=found)


@query("R22_staged_search")
def r22(spark, sf):
    return Q.staged(_index(spark, sf), D.queries(spark, sf), "hybrid", 8, scorer=token_overlap)


@query(
    "R23_gather",
    f"""WITH {S.KEYWORD}, {S.DENSE}, a AS (SELECT query_id, doc_id, score, 0 AS l FROM dense WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, score, 1 FROM keyword WHERE rank <= 5),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, l) = 1)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b QUALIFY rank <= 5""",
)
def r23(spark, sf):
    texts = D.queries(spark, sf).select("query_id", F.lit(0).alias("variant"), "text")
    return Q.gather(_index(spark, sf), texts, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _graph_hits(spark, sf):
    """Fused hits with made-up paths: hits of one owner lie on one path, two levels deep."""
    hits = D.fused(spark, sf).join(D.docs(spark, sf), "doc_id").filter(F.col("rank") <= 20)
    deep = F.col("doc_id") % 3
    path = F.when(deep == 0, "").when(deep == 1, F.col("owner_id")).otherwise(F.concat("owner_id", F.lit(" → "), "kb_id"))
    return hits.select("query_id", "rank", _c("doc_id").alias("chunk_id"), deep.cast("int").alias("hop"), path.alias("path"), _c("text").alias("content"), _c("rrf_score").alias("raw_score"))


_BUNDLES = f"""{S.FUSED},
 g AS (SELECT query_id, rank, doc_id AS chunk_id, doc_id % 3 AS hop, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE source || ' → ' || lang END AS path, rrf_score FROM fused JOIN documents USING (doc_id) WHERE rank <= 20),
 pl AS (SELECT h.query_id, h.chunk_id, h.rank, h.rrf_score, arg_min(a.path, (-a.hop, a.rank)) AS path_id, min((-a.hop, a.rank)) AS k FROM g h JOIN g a ON a.query_id = h.query_id AND a.path <> '' AND starts_with(a.path, h.path) WHERE h.path <> '' GROUP BY ALL
   UNION ALL SELECT query_id, chunk_id, rank, rrf_score, CAST(chunk_id AS VARCHAR), (1000, rank) FROM g WHERE path = '')"""


@query(
    "R17_path_bundles",
    f"WITH {_BUNDLES} SELECT query_id, path_id, count(*) AS n_members, round(max(rrf_score), 6) AS raw_score, string_agg(chunk_id, ',' ORDER BY rank) AS members FROM pl GROUP BY query_id, k, path_id",
)
def r17(spark, sf):
    b = R.path_bundles(_graph_hits(spark, sf))
    members = F.array_join(F.transform("members", lambda m: m["chunk_id"].cast("string")), ",")
    return b.select("query_id", "path_id", F.size("members").cast("long").alias("n_members"), F.round("raw_score", 6).alias("raw_score"), members.alias("members"))


@query("R18_expand_bundles", f"WITH {_BUNDLES} SELECT query_id, chunk_id, path_id, row_number() OVER (PARTITION BY query_id ORDER BY k, rank) AS rank FROM pl")
def r18(spark, sf):
    b = R.path_bundles(_graph_hits(spark, sf)).withColumn("admission_score", F.lit(0.5))
    return R.expand_bundles(b).select("query_id", "chunk_id", "path_id", "rank")


@query("R19_aggregate_parents")
def r19(spark, sf):
    hits = D.fused(spark, sf).join(D.docs(spark, sf), "doc_id")
    hits = hits.select("query_id", "rank", _c("doc_id").alias("chunk_id"), _c("owner_id").alias("doc_id"), F.concat("owner_id", "kb_id").alias("parent_id"), token_count(_c("text")).alias("parent_tokens"))
    return R.aggregate_parents(hits, 8)


def _kg(spark, sf, mode):
    near = V.nearest(D.vectors(spark, sf), D.label_queries(spark, sf), 10)
    entity_hits = near.select("query_id", F.concat(F.lit("P"), "doc_id").alias("name"), "score", "rank")
    edges = cut_lineage(D.edges(spark, sf))  # stands for the stored edge table
    # Relation hits: the heaviest edge of each entity hit, in the order of the hits.
    heavy = edges.groupBy("src").agg(F.max_by("tgt", F.struct("weight", "tgt")).alias("tgt"))
    relation_hits = entity_hits.select("query_id", _c("name").alias("src"), "rank").join(heavy, "src")
    chunk_hits = near.select("query_id", _c("doc_id").alias("chunk_id"), "rank")
    r = D.relation_records(spark, sf)
    node_sources = r.select(F.explode(F.array("src", "tgt")).alias("name"), _c("chunk_id").alias("source_id")).distinct()
    return Q.kg_query(
        mode, D.label_queries(spark, sf), entity_hits, relation_hits, chunk_hits, D.nodes(spark, sf), edges, node_sources, G.sources_of(r, ["src", "tgt"])
    )


@query("R24_kg_hybrid_relations")
def r24_relations(spark, sf):
    return _kg(spark, sf, "hybrid")[1]


@query("R24_kg_mix_chunks")
def r24_chunks(spark, sf):
    return _kg(spark, sf, "mix")[2]


@query("R24_kg_local_entities")
def r24_local(spark, sf):
    return _kg(spark, sf, "local")[0]


@query("R24_kg_naive_chunks")
def r24_naive(spark, sf):
    return _kg(spark, sf, "naive")[2]


@query("E5_ablation")
def e5(spark, sf):
    expected = cut_lineage(_expected(spark, sf))
    questions = _questions(spark, sf, expected).join(D.queries(spark, sf), "query_id")
    return Q.ablation(_index(spark, sf), questions, expected)
