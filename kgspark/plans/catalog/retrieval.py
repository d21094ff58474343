"""Lexical and vector retrieval, fusion and budgets."""

import math

from pyspark.sql import functions as F

from kgspark.functions.text import token_count
from kgspark.operators import fusion as R
from kgspark.operators import vectors as V
from kgspark.operators.inverted import InvertedIndex
from kgspark.operators.quantised import QuantisedIndex, similar_pairs
from kgspark.operators.scale import new_folder
from kgspark.plans import domain as D
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read


def _r(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c.endswith("score") or c.endswith("weight") else F.col(c) for c in names])


@query("T2_bm25", f"WITH {S.BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm25")
def t2(spark, sf):
    from kgspark.operators.lexical import bm25_scores

    return _r(bm25_scores(D.docs(spark, sf).select("doc_id", "text"), D.queries(spark, sf)), "query_id", "doc_id", "score")


@query(
    "T3_keyword_hits",
    f"WITH {S.KEYWORD} SELECT query_id, doc_id, rank, round(score, 6) AS keyword_score, round(raw_score, 6) AS raw_score FROM keyword",
)
def t3(spark, sf):
    return _r(D.keyword_hits(spark, sf), "query_id", "doc_id", "rank", "keyword_score", "raw_score")


@query(
    "T3_indexed_hits",
    f"WITH {S.KEYWORD} SELECT query_id, doc_id, rank, round(score, 6) AS keyword_score, round(raw_score, 6) AS raw_score FROM keyword",
)
def t3_indexed(spark, sf):
    """The same hits from a stored index to which the documents came in two parts."""
    index = InvertedIndex(spark, new_folder(spark, "inverted"))
    docs = D.docs(spark, sf).select("doc_id", "text")
    index.add(docs.filter("doc_id % 2 = 0")).add(docs.filter("doc_id % 2 = 1"))
    return _r(index.search(D.queries(spark, sf), R.BM25_TOP), "query_id", "doc_id", "rank", "keyword_score", "raw_score")


@query(
    "V1_hashed_embedding",
    f"WITH {S.sparse('v', 'documents', 'doc_id')} SELECT id AS doc_id, slot, round(w, 6) AS w FROM v",
)
def v1(spark, sf):
    return V.hashed_embedding(D.docs(spark, sf), "doc_id").select("doc_id", "slot", F.round("w", 6).alias("w"))


_CENTRES = """
 parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
 means AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM parts GROUP BY ALL),
 centre AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM means GROUP BY ALL)"""


@query(
    "V2_cosine",
    f"""WITH {_CENTRES} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score
    FROM embeddings JOIN centre ON label = query_id""",
)
def v2(spark, sf):
    v = D.vectors(spark, sf)
    q = D.label_queries(spark, sf).select(F.col("query_id").alias("label"), F.col("embedding").alias("q"))
    return v.join(q, "label").select(F.col("doc_id").alias("vec_id"), F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


_TOP = """SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM pairs) WHERE rank <= {k}"""


@query(
    "V3_top_k",
    f"""WITH {_CENTRES}, pairs AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
      FROM embeddings CROSS JOIN centre WHERE list_cosine_similarity(embedding::DOUBLE[], q) >= 0.15)
    {_TOP.format(k=20)}""",
)
def v3(spark, sf):
    hits = V.nearest(D.vectors(spark, sf), D.label_queries(spark, sf), 20)
    return _r(hits, "query_id", "doc_id", "score", "rank")


def _approximate(spark, sf, threshold=None):
    """The given vectors have no clusters, so a recall of 0.9 takes seven in eight cells."""
    v = D.vectors(spark, sf)
    count = max(8, math.isqrt(v.count()) // 3)  # more vectors, more cells
    cells = V.index_cells(v, count)
    return V.approximate_nearest(v, D.label_queries(spark, sf), 20, cells, probes=-(-7 * count // 8), threshold=threshold)


@query("V4_approximate_top_k")
def v4(spark, sf):
    return _r(_approximate(spark, sf), "query_id", "doc_id", "score", "rank")


@query(
    "V4_recall",
    f"""WITH {_CENTRES}, pairs AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
      FROM embeddings CROSS JOIN centre WHERE list_cosine_similarity(embedding::DOUBLE[], q) >= 0.15)
    SELECT count(*) AS n_exact, true AS enough FROM ({_TOP.format(k=20)})""",
)
def v4_recall(spark, sf):
    """Exact hits, and whether the approximate search finds nine in ten of them."""
    exact = V.nearest(D.vectors(spark, sf), D.label_queries(spark, sf), 20).select("query_id", "doc_id")
    found = _approximate(spark, sf, V.DENSE_THRESHOLD).select("query_id", "doc_id", F.lit(1).alias("_hit"))
    both = exact.join(found, ["query_id", "doc_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("_hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def _clustered(spark, sf):
    """Vectors in clusters: the given ones with the label as one more direction each."""
    flag = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(F.col("label") == i, F.lit(1.8)).otherwise(0.0).cast("float"))
    return D.vectors(spark, sf).withColumn("embedding", F.concat("embedding", flag))


_CLUSTERED = "(SELECT vec_id, label, embedding::DOUBLE[] || list_transform(range(10), lambda i: CASE WHEN label = i THEN 1.8::FLOAT::DOUBLE ELSE 0.0::DOUBLE END) AS embedding FROM embeddings)"


@query(
    "V4_quantised_recall",
    f"""WITH given AS (WITH {_CENTRES}, pairs AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings CROSS JOIN centre) {_TOP.format(k=20)}),
    clustered AS (WITH {_CENTRES.replace("FROM embeddings", f"FROM {_CLUSTERED}")}, pairs AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding, q) AS score FROM {_CLUSTERED} CROSS JOIN centre) {_TOP.format(k=20)})
    SELECT 'given' AS vectors, count(*) AS n_exact, true AS enough, true AS few FROM given UNION ALL SELECT 'clustered', count(*), true, true FROM clustered""",
)
def v4_quantised(spark, sf):
    """Exact hits; whether the stored index finds nine in ten of them, and scores fewer than a quarter of the vectors."""
    out = None
    for name, v in (("given", D.vectors(spark, sf)), ("clustered", _clustered(spark, sf))):
        asked = V.centroids(v, "label")
        index = QuantisedIndex(spark, new_folder(spark, "quantised")).build(v.select("doc_id", "embedding"))
        total = v.count()
        pool = max(20, total // 5)
        exact = V.nearest(v, asked, 20).select("query_id", "doc_id")
        found = index.search(asked, 20, pool).select("query_id", "doc_id", F.lit(1).alias("_hit"))
        both = exact.join(found, ["query_id", "doc_id"], "left")
        row = both.agg(
            F.lit(name).alias("vectors"), F.count(F.lit(1)).alias("n_exact"), (F.count("_hit") >= 0.9 * F.count(F.lit(1))).alias("enough"),
            F.lit(pool < 0.25 * total).alias("few"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "V10_banded_synonyms",
    f"""WITH v AS {_CLUSTERED}, pairs AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_cosine_similarity(a.embedding, b.embedding), 10) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    near AS (SELECT * FROM pairs WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) <= 3),
    picked AS (SELECT least(q, d) AS src, greatest(q, d) AS tgt, max(s) AS w FROM near GROUP BY ALL)
    SELECT src, tgt, round(w, 6) AS weight FROM picked
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = src AND l_partkey = tgt OR l_suppkey = tgt AND l_partkey = src)""",
)
def v10_banded(spark, sf):
    """Synonym edges at the fixed threshold, from pairs that share a band of signs."""
    near = similar_pairs(_clustered(spark, sf).select("doc_id", "embedding"), V.SYNONYM_THRESHOLD, V.SYNONYM_POOL)
    edges = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    return V.synonym_edges(near, edges).select("src", "tgt", F.round("weight", 6).alias("weight"))


@query(
    "V5_scoped_hits",
    f"""WITH {_CENTRES}, pairs AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
      FROM embeddings JOIN centre ON label = query_id),
    top AS ({_TOP.format(k=10)})
    SELECT query_id, doc_id, top.score, rank, md5(text) AS text_hash FROM top JOIN documents USING (doc_id)""",
)
def v5(spark, sf):
    v = D.vectors(spark, sf)
    q = D.label_queries(spark, sf).withColumn("label", F.col("query_id"))
    hits = V.nearest(v, q, 10, None, cell="label").join(D.docs(spark, sf), "doc_id")
    return _r(hits.withColumn("text_hash", F.md5("text")), "query_id", "doc_id", "score", "rank", "text_hash")


@query(
    "V6_vectors_by_ids",
    """SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings
       WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def v6(spark, sf):
    ids = read(spark, sf, "labels").filter("quality = 1").select("doc_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return D.vectors(spark, sf).join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("vec_id"), F.round(total, 6).alias("total"))


@query(
    "V7_reuse_vectors",
    """
    WITH cur AS (SELECT doc_id, md5(lang || text) AS s, md5(text) AS h FROM documents),
    prev AS (SELECT d.doc_id AS vec, md5(CASE WHEN d.n_chars % 2 = 0 THEN lang ELSE 'moved' END || text) AS s, md5(text) AS h, embedding
             FROM documents d JOIN embeddings ON vec_id = doc_id),
    a AS (SELECT s, arg_min(embedding, vec) AS e FROM prev GROUP BY s), b AS (SELECT h, arg_min(embedding, s) AS e FROM prev GROUP BY h)
    SELECT doc_id, a.e IS NOT NULL OR b.e IS NOT NULL AS reused FROM cur LEFT JOIN a USING (s) LEFT JOIN b USING (h)
    """,
)
def v7(spark, sf):
    d = read(spark, sf, "documents")
    now = d.select(F.col("doc_id").alias("chunk_id"), F.md5(F.concat("lang", "text")).alias("stable_chunk_id"), F.md5("text").alias("content_hash"), "text")
    was = d.join(D.vectors(spark, sf).select("doc_id", "embedding"), "doc_id").select(
        F.md5(F.concat(F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("moved"), "text")).alias("stable_chunk_id"),
        F.md5("text").alias("content_hash"), "embedding",
    )
    blank = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float")))
    return V.reuse_vectors(now, was, blank).select(F.col("chunk_id").alias("doc_id"), "reused")


@query(
    "V8_index_manifest",
    """
    SELECT label, max(len(embedding)) AS dimension, count(*) AS vectors,
      array_to_string(list_filter([CASE WHEN max(len(embedding)) <> 64 THEN 'dimension' END, CASE WHEN count(*) <> 50 THEN 'vectors' END], lambda x: x IS NOT NULL), ',') AS mismatches
    FROM embeddings GROUP BY label
    """,
)
def v8(spark, sf):
    stored = V.manifest(D.vectors(spark, sf), ["label"])
    checked = V.manifest_mismatches(stored, {"dimension": 64, "vectors": 50})
    return checked.select("label", F.col("dimension").cast("long").alias("dimension"), "vectors", F.concat_ws(",", "mismatches").alias("mismatches"))


_ALL_PAIRS = """
 pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
   FROM embeddings a CROSS JOIN embeddings b),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM pairs WHERE score >= 0.15) WHERE rank <= 8),
 fit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS r FROM near WHERE query_id <> doc_id AND score >= 0.5)"""


@query(
    "V10_synonym_edges",
    f"""WITH {_ALL_PAIRS}, picked AS (SELECT least(query_id, doc_id) AS src, greatest(query_id, doc_id) AS tgt, max(score) AS w FROM fit WHERE r <= 3 GROUP BY ALL)
    SELECT src, tgt, round(w, 6) AS weight FROM picked
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = src AND l_partkey = tgt OR l_suppkey = tgt AND l_partkey = src)""",
)
def v10(spark, sf):
    v = D.vectors(spark, sf)
    near = V.nearest(v, v.select(F.col("doc_id").alias("query_id"), "embedding"), V.SYNONYM_POOL)
    edges = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    return V.synonym_edges(near, edges, threshold=0.5).select("src", "tgt", F.round("weight", 6).alias("weight"))


@query(
    "V11_semantic_cache",
    f"""WITH {_CENTRES}, dead AS (SELECT DISTINCT l_orderkey AS vec_id FROM lineitem WHERE l_returnflag = 'R'),
    pairs AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings JOIN centre ON label = query_id
              WHERE vec_id NOT IN (SELECT vec_id FROM dead) AND vec_id IN (SELECT l_orderkey FROM lineitem))
    SELECT query_id AS request_id, vec_id AS entry_id, round(score, 6) AS score FROM pairs WHERE score >= 0.3
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, vec_id DESC) = 1""",
)
def v11(spark, sf):
    li = read(spark, sf, "lineitem")
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    cited = li.select(F.col("l_orderkey").alias("entry_id"), line.alias("chunk_id"))
    entries = D.vectors(spark, sf).select(F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("position"), "embedding", "label")
    requests = D.label_queries(spark, sf).select(F.col("query_id").alias("request_id"), "embedding", F.col("query_id").alias("label"))
    live = li.filter("l_returnflag <> 'R'").select(line.alias("chunk_id"))
    return _r(V.cache_hits(requests, entries, cited, live, ["label"], threshold=0.3), "request_id", "entry_id", "score")


@query(
    "V12_vector_pick",
    f"""WITH {_CENTRES}, g AS (SELECT DISTINCT l_suppkey % 10 AS query_id, l_suppkey AS group_id, l_orderkey AS chunk_id FROM lineitem
      WHERE l_orderkey IN (SELECT vec_id FROM embeddings) OR l_suppkey % 10 = 9),
    n AS (SELECT query_id, count(DISTINCT group_id) AS n FROM g GROUP BY ALL),
    w AS (SELECT DISTINCT query_id, chunk_id FROM g),
    s AS (SELECT query_id, chunk_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM w JOIN centre USING (query_id) LEFT JOIN embeddings ON vec_id = chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM s
          WHERE query_id NOT IN (SELECT query_id FROM s WHERE score IS NULL))
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r JOIN n USING (query_id) WHERE rank <= floor(5 * n / 2)""",
)
def v12(spark, sf):
    v = D.vectors(spark, sf).withColumnRenamed("doc_id", "chunk_id")
    li = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("query_id"), F.col("l_suppkey").alias("group_id"), F.col("l_orderkey").alias("chunk_id")).distinct()
    known = v.select("chunk_id", F.lit(True).alias("_k"))
    groups = li.join(known, "chunk_id", "left").filter("_k OR query_id = 9").drop("_k")
    q = D.label_queries(spark, sf).withColumn("query_id", F.col("query_id").cast("long"))
    return _r(V.vector_pick(groups, v, q, 5), "query_id", "chunk_id", "score", "rank")


@query(
    "R1_weighted_fuse",
    f"""WITH {S.KEYWORD}, {S.DENSE}
    SELECT query_id, doc_id, round(0.6::DOUBLE * coalesce(d.score, 0) + 0.4::DOUBLE * coalesce(k.score, 0), 6) AS score,
      CASE WHEN d.score IS NULL THEN 'keyword' WHEN k.score IS NULL THEN 'vector' ELSE 'hybrid' END AS source
    FROM dense d FULL JOIN keyword k USING (query_id, doc_id)""",
)
def r1(spark, sf):
    return _r(R.weighted_fuse(D.dense_hits(spark, sf), D.keyword_hits(spark, sf), 0.6), "query_id", "doc_id", "score", "source")


@query(
    "R2_reciprocal_rank",
    f"""WITH {S.FUSED} SELECT query_id, doc_id, rank, channels, round(rrf_score, 6) AS rrf_score,
      round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score FROM fused""",
)
def r2(spark, sf):
    f = D.fused(spark, sf).withColumn("channels", F.concat_ws(",", "channels"))
    return _r(f, "query_id", "doc_id", "rank", "channels", "rrf_score", "vector_score", "keyword_score")


@query("R3_channel_stamp", f"WITH {S.FUSED} SELECT query_id, doc_id, rank, channel, 'v0' AS variant FROM chan")
def r3(spark, sf):
    return D.channels(spark, sf).select("query_id", "doc_id", "rank", "channel", "variant")


@query(
    "R4_best_per_document",
    f"""WITH {S.FUSED} SELECT query_id, doc_id, channel, round(coalesce(v, k), 6) AS score FROM chan
    QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(coalesce(v, k), 9) DESC, channel) = 1""",
)
def r4(spark, sf):
    return _r(R.best_per_document(D.channels(spark, sf), "channel"), "query_id", "doc_id", "channel", "score")


@query(
    "R5_blend",
    f"""WITH {S.FUSED} SELECT query_id, doc_id, round(0.5::DOUBLE * coalesce(max(v), 0) + 0.5::DOUBLE * coalesce(max(k), 0), 6) AS ranking_score
    FROM chan GROUP BY query_id, doc_id""",
)
def r5(spark, sf):
    return _r(R.blend(D.channels(spark, sf), 0.5), "query_id", "doc_id", "ranking_score")


@query(
    "R6_round_robin",
    f"""WITH {S.FUSED}, l AS (SELECT query_id, doc_id, rank AS pos, CASE channel WHEN 'dense' THEN 0 ELSE 1 END AS list_no FROM chan),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos, list_no) = 1)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, list_no) AS rank FROM f""",
)
def r6(spark, sf):
    lists = D.channels(spark, sf).select(
        "query_id", "doc_id", F.col("rank").alias("pos"), F.when(F.col("channel") == "dense", 0).otherwise(1).alias("list_no")
    )
    return R.round_robin(lists, ["query_id"], ["doc_id"]).select("query_id", "doc_id", "rank")


# Owners: suppliers of a nation by account balance; chunks: their orders by line date.
_OWNERS_SQL = """
 own AS (SELECT s_nationkey AS query_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS owner_pos FROM supplier),
 oc AS (SELECT query_id, owner_pos, l_orderkey AS chunk_id, min(l_shipdate) AS d FROM lineitem JOIN own ON s_suppkey = l_suppkey GROUP BY ALL),
 ocp AS (SELECT query_id, owner_pos, chunk_id, row_number() OVER (PARTITION BY query_id, owner_pos ORDER BY d, chunk_id) AS chunk_pos FROM oc),
 kept AS (SELECT query_id, chunk_id, count(*) AS occurrences, min(owner_pos * 1000000000 + chunk_pos) AS place FROM ocp GROUP BY ALL),
 och AS (SELECT query_id, chunk_id, occurrences, place // 1000000000 AS owner_pos, place % 1000000000 AS chunk_pos FROM kept)"""


def _owners(spark, sf):
    from pyspark.sql import Window as W

    from kgspark.operators.scale import rank_in_groups

    pos = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")) - 1
    own = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("query_id"), "s_suppkey", pos.alias("owner_pos"))
    li = read(spark, sf, "lineitem")
    oc = li.join(own, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("query_id", "owner_pos", F.col("l_orderkey").alias("chunk_id")).agg(F.min("l_shipdate").alias("d"))
    month = F.date_trunc("month", F.col("d"))
    placed = rank_in_groups(oc, ["query_id", "owner_pos"], [F.col("d"), F.col("chunk_id")], month, "chunk_pos")
    return own, placed.select("query_id", "owner_pos", "chunk_id", "chunk_pos")


@query("R7_owner_chunks", f"WITH {_OWNERS_SQL} SELECT query_id, chunk_id, occurrences, owner_pos, chunk_pos FROM och")
def r7(spark, sf):
    _, placed = _owners(spark, sf)
    return R.owner_chunks(placed).withColumn("owner_pos", F.col("owner_pos").cast("long")).withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


@query(
    "R8_weighted_polling",
    f"""WITH {_OWNERS_SQL}, n AS (SELECT query_id, count(*) AS n FROM own GROUP BY ALL),
    q AS (SELECT query_id, owner_pos, n, CAST(CASE WHEN n = 1 THEN 5 ELSE round_even(5 - owner_pos::DOUBLE / (n - 1) * 4, 0) END AS INT) AS quota FROM own JOIN n USING (query_id)),
    r AS (SELECT och.*, quota, row_number() OVER (PARTITION BY query_id, owner_pos ORDER BY occurrences DESC, chunk_pos) AS pos FROM och JOIN q USING (query_id, owner_pos)),
    u AS (SELECT query_id, owner_pos, count(*) AS used FROM r WHERE pos <= quota GROUP BY ALL),
    sp AS (SELECT query_id, CASE WHEN max(n) = 1 THEN 0 ELSE sum(quota - coalesce(used, 0)) END AS spare FROM q LEFT JOIN u USING (query_id, owner_pos) GROUP BY ALL),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY owner_pos, pos) AS turn FROM r WHERE pos > quota),
    p AS (SELECT query_id, owner_pos, pos, chunk_id, 0 AS rnd FROM r WHERE pos <= quota UNION ALL
          SELECT query_id, owner_pos, pos, chunk_id, 1 FROM e JOIN sp USING (query_id) WHERE turn <= spare)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rnd, owner_pos, pos) AS rank FROM p""",
)
def r8(spark, sf):
    own, placed = _owners(spark, sf)
    return R.weighted_polling(R.owner_chunks(placed), own.select("query_id", "owner_pos"), 5).select("query_id", "chunk_id", "rank")


_COSTED = f"""{S.FUSED}, costed AS (SELECT query_id, doc_id, rank, {S.token_count("text")} AS cost FROM fused JOIN documents USING (doc_id)),
 run AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM costed)"""


@query("R9_token_budget", f"WITH {_COSTED} SELECT query_id, doc_id, CAST(used AS BIGINT) AS used_tokens FROM run WHERE used <= 4500")
def r9(spark, sf):
    hits = D.fused(spark, sf).join(D.docs(spark, sf), "doc_id")
    return R.within_budget(hits, token_count(F.col("text")), 4500).select("query_id", "doc_id", "used_tokens")


@query(
    "R10_chunk_budget",
    f"""WITH {_COSTED}, b AS (SELECT item_id AS query_id, 6000 - 500 - 5 * {S.token_count("text")} - {S.token_count("text")} - 100 AS budget FROM benchmark)
    SELECT query_id, CAST(max(budget) AS BIGINT) AS budget, count(*) AS n_chunks, CAST(max(used) AS BIGINT) AS used FROM run JOIN b USING (query_id) WHERE used <= budget AND budget > 0 GROUP BY query_id""",
)
def r10(spark, sf):
    n = token_count(F.col("text")).cast("long")
    budgets = D.queries(spark, sf).select("query_id", R.chunk_budget(6000, 500, 5 * n, n).alias("budget"))
    hits = D.fused(spark, sf).join(D.docs(spark, sf), "doc_id").join(budgets, "query_id")
    kept = R.within_budget(hits, token_count(F.col("text")), F.col("budget"))
    return kept.groupBy("query_id").agg(F.max("budget").alias("budget"), F.count(F.lit(1)).alias("n_chunks"), F.max("used_tokens").alias("used"))


@query(
    "R11_context_blocks",
    f"""WITH {S.FUSED}, l AS (SELECT query_id, rank, '{{"id":' || rank || ',"doc_id":' || doc_id || ',"channels":"' || channels || '"}}' AS line FROM fused)
    SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS block, CAST(sum({S.token_count("line")}) AS BIGINT) AS tokens FROM
      (SELECT *, sum({S.token_count("line")}) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM l) WHERE used <= 300 GROUP BY query_id""",
)
def r11(spark, sf):
    items = D.fused(spark, sf).withColumn("channels", F.concat_ws(",", "channels"))
    return R.context_blocks(items, ["doc_id", "channels"], 300)


_RELEVANCE = "(doc_id * 7919 + query_id * 104729) % 1000 / 1000.0"


@query(
    "R12_rerank_join",
    f"""WITH {S.FUSED} SELECT query_id, doc_id, CAST(({_RELEVANCE}) AS DOUBLE) AS rerank_score,
      row_number() OVER (PARTITION BY query_id ORDER BY CAST(({_RELEVANCE}) AS DOUBLE) DESC, rank) AS rank FROM fused WHERE (doc_id + query_id) % 7 <> 0""",
)
def r12(spark, sf):
    from pyspark.sql import Window as W

    hits = D.fused(spark, sf)
    score = F.when((F.col("doc_id") + F.col("query_id")) % 7 != 0, F.expr(_RELEVANCE).cast("double"))
    scores = hits.select("query_id", (F.col("rank") - 1).alias("index"), score.alias("relevance"))
    joined = R.rerank_join(hits, scores)
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return joined.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "rerank_score", "rank")


@query(
    "R13_time_weight",
    """SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 1.0::DOUBLE WHEN event_id % 13 = 0 THEN 0.1::DOUBLE
       ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, pow(0.5::DOUBLE, (1735689600 - epoch(ts)) / 7776000.0::DOUBLE))) END, 6) AS time_weight FROM events""",
)
def r13(spark, sf):
    e = read(spark, sf, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    created = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, 5.0).otherwise(sec)
    return e.select("event_id", F.round(R.time_weight(created, 1735689600.0), 6).alias("time_weight"))


@query(
    "R14_post_rerank",
    f"""WITH {S.FUSED}, s AS (SELECT query_id, doc_id, rank, CASE WHEN (doc_id + query_id) % 7 <> 0 THEN CAST(({_RELEVANCE}) AS DOUBLE) END AS rs FROM fused),
    t AS (SELECT s.*, {S.token_count("text")} AS cost, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rs, 1.0) DESC, rank) AS fr FROM s JOIN documents USING (doc_id) WHERE coalesce(rs, 1.0) >= 0.5),
    u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY fr ROWS UNBOUNDED PRECEDING) AS used FROM t WHERE fr <= 20)
    SELECT query_id, doc_id, fr AS final_rank, CAST(used AS BIGINT) AS used_tokens FROM u WHERE used <= 3000""",
)
def r14(spark, sf):
    score = F.when((F.col("doc_id") + F.col("query_id")) % 7 != 0, F.expr(_RELEVANCE).cast("double"))
    hits = D.fused(spark, sf).withColumn("rerank_score", score).join(D.docs(spark, sf), "doc_id")
    return R.post_rerank(hits, token_count(F.col("text")), 0.5, 20, 3000).select("query_id", "doc_id", "final_rank", "used_tokens")


_ADMITTED = f"""{S.FUSED}, adm AS (SELECT *, 1 / (1 + exp(-(0.5::DOUBLE * coalesce(vector_score, 0) + 0.5::DOUBLE * coalesce(keyword_score, 0) - 0.22::DOUBLE) / 0.08::DOUBLE)) AS a FROM fused)"""


@query("R15_admission", f"WITH {_ADMITTED} SELECT query_id, doc_id, round(a, 6) AS admission_score FROM adm")
def r15(spark, sf):
    return _r(R.admit(D.fused(spark, sf), "hybrid", 0.5), "query_id", "doc_id", "admission_score")


@query("R16_threshold", f"WITH {_ADMITTED} SELECT query_id, doc_id, round(a, 6) AS admission_score FROM adm WHERE a >= 0.9")
def r16(spark, sf):
    admitted = R.admit(D.fused(spark, sf).withColumn("score", F.col("rrf_score")), "hybrid", 0.5)
    return _r(R.by_threshold(admitted, 0.9), "query_id", "doc_id", "admission_score")


_HYPOTHESIS = "text || ' ' || reverse(text)"


@query(
    "R20_tree_fusion",
    f"""WITH {S.DENSE}, {S.sparse("hvec", "benchmark", "item_id", f"({_HYPOTHESIS})")},
    hyp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
      (SELECT hvec.id AS query_id, dvec.id AS doc_id, sum(dvec.w * hvec.w) AS score FROM dvec JOIN hvec USING (slot) GROUP BY ALL) WHERE score >= 0.15) WHERE rank <= 40)
    SELECT query_id, doc_id, round(0.65::DOUBLE * coalesce(h.score, 0) + 0.35::DOUBLE * coalesce(d.score, 0), 6) AS ranking_score, round(d.score, 6) AS query_cosine
    FROM hyp h FULL JOIN dense d USING (query_id, doc_id)""",
)
def r20(spark, sf):
    docs = V.hashed_embedding(D.docs(spark, sf), "doc_id")
    guess = D.queries(spark, sf).withColumn("text", F.expr(_HYPOTHESIS))
    hyde = V.sparse_hits(docs, V.hashed_embedding(guess, "query_id"), R.DENSE_TOP)
    tree = R.tree_scores(hyde, D.dense_hits(spark, sf))
    return tree.select("query_id", "doc_id", F.round("ranking_score", 6).alias("ranking_score"), F.round("query_cosine", 6).alias("query_cosine"))


_CITED = f"""{S.KEYWORD}, cites AS (SELECT query_id, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_id,
  source || '/' || doc_id || '.txt' AS name, doc_id, lang, substr(trim(text), 1, 240) AS excerpt FROM keyword JOIN documents USING (doc_id) WHERE rank <= 10 AND trim(text) <> '')"""


def _citations(spark, sf):
    d = read(spark, sf, "documents")
    named = d.withColumn("name", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")))
    return R.citations(D.keyword_hits(spark, sf, 10).join(named, "doc_id"))


@query("R25_citations", f"WITH {_CITED} SELECT query_id, citation_id, name, doc_id, excerpt FROM cites")
def r25(spark, sf):
    return _citations(spark, sf)


@query(
    "R26_validate_citations",
    f"""WITH {_CITED}, ans AS (SELECT item_id AS query_id, unnest(['C1', 'C3', 'C' || (item_id % 10 + 2), 'C77']) AS citation_id FROM benchmark)
    SELECT DISTINCT query_id, citation_id, doc_id FROM cites JOIN ans USING (query_id, citation_id) WHERE lang = 'en'""",
)
def r26(spark, sf):
    answer = F.concat(F.lit("a [C1] b [C3] c [C"), (F.col("query_id") % 10 + 2).cast("string"), F.lit("] d [C77] [C1]"))
    answers = D.queries(spark, sf).select("query_id", answer.alias("answer"), F.lit("en").alias("kb_id"))
    known = _citations(spark, sf).join(D.docs(spark, sf).select("doc_id", "kb_id"), "doc_id").withColumn("version_id", F.lit(None).cast("string"))
    return R.validate_citations(answers, known)


@query(
    "V9_validate_index",
    """SELECT count(*) AS rows, count(DISTINCT len(embedding)) AS dimensions, count(CASE WHEN label IS NULL THEN 1 END) AS unowned, CAST(0 AS BIGINT) AS missing,
       1.0::DOUBLE AS lowest_cosine, true AS passed FROM embeddings""",
)
def v9(spark, sf):
    v = D.vectors(spark, sf).withColumnRenamed("label", "owner_id")
    scaled = v.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2.0)))
    return V.validate_index(v, v.select("doc_id"), scaled).withColumn("lowest_cosine", F.round("lowest_cosine", 6))


@query(
    "U3_token_overlap",
    f"""WITH {S.KEYWORD}, p AS (SELECT query_id, doc_id, list_distinct({S.tokens("b.text")}) AS q, {S.tokens("d.text")} AS t FROM keyword JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id))
    SELECT query_id, doc_id, round(len(list_intersect(q, t)) / len(q)::DOUBLE, 6) AS relevance FROM p""",
)
def u3(spark, sf):
    from kgspark.hooks import token_overlap

    q = D.queries(spark, sf).withColumnRenamed("text", "q")
    hits = D.keyword_hits(spark, sf).select("query_id", "doc_id").join(q, "query_id").join(D.docs(spark, sf), "doc_id")
    return hits.select("query_id", "doc_id", F.round(token_overlap(F.col("q"), F.col("text")), 6).alias("relevance"))
