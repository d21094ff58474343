"""Graph queries on the graph of parts and suppliers."""

from pyspark.sql import functions as F

from kgspark.operators import graph_build as G
from kgspark.operators import graph_query as N
from kgspark.operators import vectors as V
from kgspark.operators.scale import cut_lineage, top_per_key, written
from kgspark.plans import domain as D
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read

E = """
 ed AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
 bw AS (SELECT src AS node, tgt AS other, weight FROM ed UNION ALL SELECT tgt, src, weight FROM ed),
 dg AS (SELECT node AS name, count(*) AS degree FROM bw GROUP BY ALL)"""


@query("N1_incident_edges", f"WITH {E} SELECT node, other, weight FROM bw WHERE node IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def n1(spark, sf):
    names = read(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("S"), "s_suppkey").alias("name"))
    return N.incident_edges(D.edges(spark, sf), names, "weight")


@query(
    "N1_edge_exists",
    f"""WITH {E}, w AS (SELECT 'P' || p_partkey AS src, 'S' || (p_partkey * 7 % 100) AS tgt FROM part)
    SELECT src, tgt, ed.src IS NOT NULL AS present FROM w LEFT JOIN ed USING (src, tgt)""".replace("ed.src IS NOT NULL", "weight IS NOT NULL"),
)
def n1_exists(spark, sf):
    w = read(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("S"), F.col("p_partkey") * 7 % 100).alias("tgt"))
    return N.exists(w, D.edges(spark, sf), ["src", "tgt"])


@query("N2_node_degree", f"WITH {E} SELECT name, degree FROM dg")
def n2(spark, sf):
    return N.degrees(D.nodes(spark, sf), D.edges(spark, sf))


@query("N2_edge_degree", f"WITH {E} SELECT src, tgt, a.degree + b.degree AS edge_degree FROM ed JOIN dg a ON a.name = src JOIN dg b ON b.name = tgt")
def n2_edges(spark, sf):
    e = D.edges(spark, sf)
    return N.edge_degrees(e, N.degrees(D.nodes(spark, sf), e)).select("src", "tgt", "edge_degree")


@query("N3_all_labels", "SELECT DISTINCT 'P' || l_partkey AS name FROM lineitem UNION SELECT 'S' || l_suppkey FROM lineitem")
def n3(spark, sf):
    return D.nodes(spark, sf).select("name").orderBy("name")


@query(
    "N4_nodes_by_chunks",
    """SELECT DISTINCT unnest(['P' || l_partkey, 'S' || l_suppkey]) AS name FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def n4(spark, sf):
    r = D.relation_records(spark, sf).select(F.explode(F.array("src", "tgt")).alias("name"), F.col("chunk_id").alias("source_id"))
    chunks = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk_id"))
    return N.touching_chunks(r, chunks, ["name"])


@query(
    "N5_top_subgraph",
    f"""WITH {E}, t AS (SELECT name FROM dg ORDER BY degree DESC, name LIMIT 300)
    SELECT src, tgt, weight FROM ed WHERE src IN (FROM t) AND tgt IN (FROM t)""",
)
def n5(spark, sf):
    return N.top_by_degree(D.nodes(spark, sf), D.edges(spark, sf), 300)[1].select("src", "tgt", "weight")


@query(
    "N6_reachable",
    f"""WITH {E}, s AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)),
    h1 AS (SELECT DISTINCT s.name AS start, other AS name FROM s JOIN bw ON node = s.name),
    h2 AS (SELECT DISTINCT start, other AS name FROM h1 JOIN bw ON node = h1.name),
    al AS (SELECT name AS start, name, 0 AS hop FROM s UNION ALL SELECT start, name, 1 FROM h1 UNION ALL SELECT start, name, 2 FROM h2)
    SELECT start, name, CAST(min(hop) AS INT) AS hop FROM al GROUP BY ALL""",
)
def n6(spark, sf):
    return N.reachable(D.edges(spark, sf), _dearest(spark, sf), 2)


def _dearest(spark, sf):
    p = read(spark, sf, "part")
    top = p.agg(F.max("p_retailprice").alias("p_retailprice"))
    return p.join(F.broadcast(top), "p_retailprice").select(F.concat(F.lit("P"), "p_partkey").alias("name"))  # one row


@query(
    "N6_bounded_neighbourhood",
    f"""WITH {E}, s AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)),
    h1 AS (SELECT DISTINCT other AS name FROM s JOIN bw ON node = s.name), h2 AS (SELECT DISTINCT other AS name FROM h1 JOIN bw ON node = h1.name),
    al AS (SELECT name, 0 AS hop FROM s UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2), m AS (SELECT name, min(hop) AS hop FROM al GROUP BY ALL)
    SELECT name, CAST(hop AS INT) AS hop, degree, CAST(row_number() OVER (ORDER BY hop, degree DESC, name) AS INT) AS position, (SELECT count(*) FROM m) > 200 AS truncated
    FROM m JOIN dg USING (name) QUALIFY position <= 200""",
)
def n6_bounded(spark, sf):
    return N.bounded_neighbourhood(D.nodes(spark, sf), D.edges(spark, sf), _dearest(spark, sf), 2, 200)


@query(
    "N7_overview",
    f"""WITH {E}, mt AS (SELECT unnest(['P' || l_partkey, 'S' || l_suppkey]) AS name, l_orderkey FROM lineitem), m AS (SELECT name, count(DISTINCT l_orderkey) AS mentions FROM mt GROUP BY ALL),
    t AS (SELECT name, degree, mentions FROM dg JOIN m USING (name) ORDER BY degree DESC, mentions DESC, name DESC LIMIT 150),
    l AS (SELECT unnest([src, tgt]) AS name FROM ed WHERE src IN (SELECT name FROM t) AND tgt IN (SELECT name FROM t))
    SELECT name, degree, mentions FROM t WHERE name IN (SELECT name FROM l)""",
)
def n7(spark, sf):
    r = D.relation_records(spark, sf).select(F.explode(F.array("src", "tgt")).alias("name"), "chunk_id").distinct()
    mentions = r.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
    return N.overview(D.nodes(spark, sf), D.edges(spark, sf), mentions, 150)


@query(
    "N7_pick_center",
    f"""WITH {E} SELECT 'P' || l_partkey AS name FROM (SELECT DISTINCT l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN dg ON dg.name = 'P' || l_partkey
    WHERE contains(lower(p_name), 'red') ORDER BY lower(p_name) = 'red' DESC, degree DESC, name LIMIT 1""",
)
def n7_center(spark, sf):
    label = read(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_name").alias("label"))
    return N.pick_center(D.nodes(spark, sf).join(label, "name"), D.edges(spark, sf), "RED")


@query(
    "N8_neighbours",
    f"""WITH {E} SELECT node, other, weight, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS INT) AS rank FROM bw
    WHERE node IN (SELECT 'S' || s_suppkey FROM supplier) QUALIFY rank <= 50""",
)
def n8(spark, sf):
    names = read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"))
    return N.neighbours(D.edges(spark, sf), names, 50)


def _region_seeds(spark, sf):
    """One query per region: its suppliers weigh by balance."""
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    return s.select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("S"), "s_suppkey").alias("name"), F.col("s_acctbal").alias("weight"))


@query("N9_expand_paths")
def n9(spark, sf):
    from pyspark.sql import Window as W

    seeds = _region_seeds(spark, sf)
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("weight").desc(), "name"))
    ranked = seeds.select("query_id", "name", (F.col("weight") / 10000).alias("seed_score"), pos.alias("position"))
    paths = N.expand_paths(ranked, D.edges(spark, sf).withColumn("label", F.lit("supplies")))
    return paths.select("query_id", "name", "hop", F.round("score", 6).alias("score"), F.array_join("path", " ").alias("path"))


def _step(n):
    return f"""s{n} AS (SELECT query_id, name, sum(x) AS score FROM (
      SELECT query_id, other AS name, 0.85::DOUBLE * score / degree AS x FROM s{n - 1} p JOIN dg USING (name) JOIN bw ON node = p.name
      UNION ALL SELECT query_id, name, s * (0.15::DOUBLE + 0.85::DOUBLE * coalesce((SELECT sum(score) FROM s{n - 1} l WHERE l.query_id = s0.query_id AND l.name NOT IN (SELECT name FROM dg)), 0)) FROM s0) GROUP BY ALL)"""


@query(
    "N10_pagerank_3_steps",
    f"""WITH {E}, w AS (SELECT n_regionkey AS query_id, 'S' || s_suppkey AS name, greatest(s_acctbal, 0) AS w FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    s0 AS (SELECT query_id, name, w / sum(w) OVER (PARTITION BY query_id) AS s, w / sum(w) OVER (PARTITION BY query_id) AS score FROM w), {_step(1)}, {_step(2)}, {_step(3)}
    SELECT query_id, name, round(score, 8) AS score FROM s3""",
)
def n10(spark, sf):
    score = N.pagerank(D.edges(spark, sf), _region_seeds(spark, sf), steps=3)
    return score.select("query_id", "name", F.round("score", 8).alias("score"))


@query("N10_pagerank")
def n10_full(spark, sf):
    score = N.pagerank(D.edges(spark, sf), _region_seeds(spark, sf))
    return score.select("query_id", "name", F.round("score", 8).alias("score"))


@query("N11_pagerank_retrieval")
def n11(spark, sf):
    hits = _region_seeds(spark, sf).select("query_id", "name", F.col("weight").alias("score"))
    edges = written(D.edges(spark, sf))  # stands for the stored edge table
    best = top_per_key(hits, ["query_id"], [F.col("score").desc(), F.col("name").asc()], 10).drop("rank")
    _, relations = N.pagerank_retrieval(edges, D.nodes(spark, sf), best, 10)
    return relations.select("query_id", "src", "tgt", "rank", F.round("score", 8).alias("score"))


def _labelled(spark, sf):
    """Document nodes: the label is the longest token of the document."""
    from kgspark.functions.text import tokens

    t = F.array_min(F.transform(tokens(F.col("text")), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("t"))))
    return D.docs(spark, sf).select(F.col("doc_id").alias("name"), F.coalesce(t["t"], F.lit("")).alias("label"))


_LABELS = f"""
 tk AS (SELECT doc_id, unnest({S.tokens("text")}) AS t FROM documents),
 lb AS (SELECT doc_id AS name, arg_min(t, (-len(t), t)) AS label FROM tk GROUP BY ALL)"""


@query(
    "N12_label_seeds",
    f"""WITH {_LABELS}, q AS (SELECT item_id AS query_id, text || ' ' || coalesce(label, '') AS text FROM benchmark LEFT JOIN lb ON name = item_id),
    h AS (SELECT query_id, name, label FROM q JOIN lb ON len(label) >= 2 AND contains(text, label))
    SELECT query_id, name, 0.8::DOUBLE AS score FROM h QUALIFY len(label) = max(len(label)) OVER (PARTITION BY query_id)""",
)
def n12(spark, sf):
    nodes = _labelled(spark, sf)
    return N.label_seeds(nodes, _asked(spark, sf, nodes))


def _asked(spark, sf, nodes):
    """Benchmark texts that also name the label of the document with their number."""
    named = nodes.select(F.col("name").alias("query_id"), "label")
    q = D.queries(spark, sf).join(named, "query_id", "left")
    return q.select("query_id", F.concat("text", F.lit(" "), F.coalesce("label", F.lit(""))).alias("text"))


def reached(spark, sf, limit):
    nodes = written(_labelled(spark, sf))  # read for names, labels, edges and sources: the texts are cut once
    asked = written(_asked(spark, sf, nodes))
    # Documents are linked when they share their longest token; sources are the documents.
    same = nodes.filter("label <> ''").groupBy("label").agg(F.min("name").alias("src"))
    edges = written(nodes.join(same, "label").filter("name <> src").select("src", F.col("name").alias("tgt"), F.col("label")))
    vector = D.dense_hits(spark, sf, 8).select("query_id", F.col("doc_id").alias("name"), "score")
    seed = cut_lineage(N.seeds(vector, nodes, asked))
    sources = nodes.select("name", F.col("name").alias("source_id"))
    return N.graph_hits(seed, edges, sources, asked, nodes, limit)


@query("N13_graph_hits")
def n13(spark, sf):
    hits = reached(spark, sf, 20)
    return hits.select("query_id", "chunk_id", "hop", "path", F.round("score", 6).alias("score"), F.round("ranking_score", 6).alias("ranking_score"))


_CENTRES = """
 parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
 means AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM parts GROUP BY ALL),
 centre AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM means GROUP BY ALL),
 vh AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings CROSS JOIN centre),
 top AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, vec_id) AS rank FROM vh WHERE score >= 0.15 QUALIFY rank <= 20)"""


def _vector_hits(spark, sf):
    return V.nearest(D.vectors(spark, sf), D.label_queries(spark, sf), 20)


@query(
    "N14_local_retrieval",
    f"""WITH {E}, {_CENTRES}, m AS (SELECT DISTINCT query_id, src, tgt, weight FROM top JOIN bw ON node = 'P' || vec_id JOIN ed ON src = node AND tgt = other)
    SELECT query_id, src, tgt, m.weight, a.degree + b.degree AS edge_degree FROM m JOIN dg a ON a.name = src JOIN dg b ON b.name = tgt""".replace(
        "SELECT DISTINCT query_id, src, tgt, weight FROM top", "SELECT DISTINCT query_id, src, tgt, ed.weight FROM top"
    ),
)
def n14(spark, sf):
    hits = _vector_hits(spark, sf).select("query_id", F.concat(F.lit("P"), "doc_id").alias("name"), "score")
    _, edges = N.local_retrieval(hits, D.nodes(spark, sf), D.edges(spark, sf))
    return edges.select("query_id", "src", "tgt", "weight", "edge_degree")


@query(
    "N15_global_retrieval",
    f"""WITH {_CENTRES}, r AS (SELECT query_id, rank, unnest(['P' || (vec_id % 50), 'S' || (vec_id % 9)]) AS name, unnest([0, 1]) AS i FROM top),
    f AS (SELECT query_id, name, min(rank * 2 + i) AS at_pos FROM r GROUP BY ALL)
    SELECT query_id, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY at_pos) AS INT) AS position FROM f""",
)
def n15(spark, sf):
    hits = _vector_hits(spark, sf).select(
        "query_id", "rank", F.concat(F.lit("P"), F.col("doc_id") % 50).alias("src"), F.concat(F.lit("S"), F.col("doc_id") % 9).alias("tgt")
    )
    return N.global_retrieval(hits)


@query(
    "N16_graph_stats",
    """SELECT p_type AS entity_type, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY ALL
       UNION ALL SELECT 'SUPPLIER', count(DISTINCT l_suppkey) FROM lineitem""",
)
def n16(spark, sf):
    return N.graph_stats(D.nodes(spark, sf))


@query(
    "N17_entity_list",
    """SELECT 'P' || l_partkey AS name, p_type AS entity_type, count(DISTINCT l_orderkey) AS frequency FROM lineitem JOIN part ON p_partkey = l_partkey
       WHERE p_type = 'ECONOMY' AND contains('p' || l_partkey, 'p1') GROUP BY ALL""",
)
def n17(spark, sf):
    src = D.relation_records(spark, sf).select(F.explode(F.array("src", "tgt")).alias("name"), F.col("chunk_id").alias("source_id"))
    return N.entity_list(D.nodes(spark, sf), src, "P1", "ECONOMY")


@query(
    "N18_relation_list",
    """WITH k AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
       SELECT src, tgt, weight FROM k WHERE r AND (contains(lower(src), 's1') OR contains(lower(tgt), 's1')) AND substr(src, 2)::INT IN (SELECT p_partkey FROM part WHERE p_size > 20)""",
)
def n18(spark, sf):
    scope = read(spark, sf, "part").filter("p_size > 20").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    scope = scope.unionByName(read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name")))
    return N.relation_list(D.edges(spark, sf), scope, "S1", "R").select("src", "tgt", "weight")


@query(
    "N19_scoped_subgraph",
    """SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey
       JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand = 'Brand#2' AND s_nationkey < 12 GROUP BY ALL""",
)
def n19(spark, sf):
    scope = read(spark, sf, "part").filter("p_brand = 'Brand#2'").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    scope = scope.unionByName(read(spark, sf, "supplier").filter("s_nationkey < 12").select(F.concat(F.lit("S"), "s_suppkey").alias("name")))
    return N.induced(D.edges(spark, sf), scope).select("src", "tgt", "weight")
