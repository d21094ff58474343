"""Conversations, memories, integrity checks and evaluation."""

from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import conversation as C
from kgspark.operators import evaluation as E
from kgspark.operators import integrity as I
from kgspark.plans import domain as D
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read

_c = F.col

_ROUNDS = f"""
 m AS (SELECT conv_id, turn, role, {S.strip("text")} AS t FROM conversations WHERE role IN ('user', 'assistant') AND {S.strip("text")} <> ''),
 r AS (SELECT *, CASE WHEN role = 'user' OR lag(role) OVER w IS DISTINCT FROM 'user' THEN 1 ELSE 0 END AS op FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 n AS (SELECT *, sum(op) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS round FROM r),
 k AS (SELECT *, round > max(round) OVER (PARTITION BY conv_id) - 2 AS recent FROM n)"""


def _rounds(spark, sf):
    return C.window_and_older(C.rounds(read(spark, sf, "conversations")), 2)


@query("P11_rounds", f"WITH {_ROUNDS} SELECT conv_id, turn, CAST(round AS BIGINT) AS round FROM n")
def p11(spark, sf):
    return _rounds(spark, sf).select("conv_id", "turn", "round")


@query(
    "P12_summarize",
    f"""WITH {_ROUNDS}, o AS (SELECT conv_id, count(DISTINCT CASE WHEN NOT recent THEN round END) AS older_rounds, CAST(coalesce(sum(CASE WHEN NOT recent THEN len(t) END), 0) AS BIGINT) AS older_chars FROM k GROUP BY ALL),
    c AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS covered FROM o)
    SELECT conv_id, older_rounds, older_chars, older_rounds > 0 AND covered <> older_rounds AND (older_rounds >= 5 OR older_chars >= 2000 OR covered = 0) AS summarize FROM c""",
)
def p12(spark, sf):
    conv = read(spark, sf, "conversations")
    done = conv.filter("conv_id % 3 = 0").select("conv_id", F.lit(1).alias("covered_rounds")).distinct()
    return C.should_summarize(_rounds(spark, sf), done).drop("covered_rounds")


@query(
    "T14_standalone_query",
    f"""WITH u AS (SELECT conv_id, turn, text AS raw, CASE WHEN turn % 4 = 2 THEN '它 ' || text ELSE text END AS q FROM conversations WHERE role = 'user'),
    p AS (SELECT conv_id, turn, {S.squash("q")} AS q, {S.squash("coalesce(lag(raw) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS topic FROM u)
    SELECT conv_id, turn, md5(CASE WHEN {S.contains_any("q", X.ANAPHORA_WORDS)} AND topic <> '' AND NOT contains(q, topic) THEN topic || '。' || q ELSE q END) AS h FROM p""",
)
def t14(spark, sf):
    rows = C.last_topics(read(spark, sf, "conversations"))
    asked = F.when(_c("turn") % 4 == 2, F.concat(F.lit("它 "), "text")).otherwise(_c("text"))
    return rows.select("conv_id", "turn", F.md5(X.standalone_query(asked, _c("topic"))).alias("h"))


_TERMS = "list_distinct(regexp_extract_all(lower({}), '[一-鿿]|[a-z0-9_]+'))"
_MEMORY = f"""
 mm AS (SELECT conv_id * 1000 + turn AS memory_id, conv_id % 7 AS owner_id, CASE WHEN turn < 2 THEN 'global' ELSE 'kb' END AS scope, conv_id % 2 AS kb, turn, unnest({_TERMS.format("text")}) AS term FROM conversations WHERE role = 'assistant' AND turn % 5 <> 4),
 qq AS (SELECT item_id AS request_id, item_id % 7 AS owner_id, item_id % 2 AS kb, {_TERMS.format("text")} AS q FROM benchmark),
 qt AS (SELECT request_id, owner_id, kb, len(q) AS n, unnest(q) AS term FROM qq),
 sc AS (SELECT request_id, memory_id, least(1.0::DOUBLE, count(*) / greatest(1, least(max(n), 6))::DOUBLE) AS score, max(turn) AS u FROM mm JOIN qt USING (owner_id, term) WHERE scope = 'global' OR mm.kb = qt.kb GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, u DESC, memory_id) AS rank FROM sc WHERE score >= 0.2)"""


def _memories(spark, sf):
    conv = read(spark, sf, "conversations").filter("role = 'assistant'")
    memories = conv.select(
        (_c("conv_id") * 1000 + _c("turn")).alias("memory_id"), (_c("conv_id") % 7).alias("owner_id"),
        F.when(_c("turn") < 2, "global").otherwise("kb").alias("scope"), (_c("conv_id") % 2).alias("kb_id"),
        (_c("turn") % 5 != 4).alias("enabled"), F.lit(None).cast("timestamp").alias("expires_at"), _c("turn").alias("updated_at"), "text",
    )
    asked = D.queries(spark, sf).select(_c("query_id").alias("request_id"), (_c("query_id") % 7).alias("owner_id"), (_c("query_id") % 2).alias("kb_id"), "text")
    return C.retrieve_memories(memories, asked, F.current_timestamp(), 5)


@query("P13_memories", f"WITH {_MEMORY} SELECT request_id, memory_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5")
def p13(spark, sf):
    return _memories(spark, sf).select("request_id", "memory_id", "score", "rank")


@query("P13_memory_budget")
def p13_budget(spark, sf):
    return C.memory_budget(_memories(spark, sf), X.token_count(_c("text")), 150)


@query(
    "P14_feedback",
    """WITH f AS (SELECT user_id AS message_id, CAST(event_id % 3 AS INT) AS owner_id, CASE WHEN event_type = 'error' THEN 'negative' ELSE 'positive' END AS rating, props AS reason, event_id AS position FROM events)
    SELECT message_id, owner_id, rating, CASE WHEN rating = 'negative' THEN reason ELSE '' END AS reason FROM f QUALIFY row_number() OVER (PARTITION BY message_id, owner_id ORDER BY position DESC) = 1""",
)
def p14(spark, sf):
    return C.feedback(_feedback(spark, sf)).drop("position")


def _feedback(spark, sf):
    rating = F.when(_c("event_type") == "error", "negative").otherwise("positive")
    return read(spark, sf, "events").select(
        _c("user_id").alias("message_id"), (_c("event_id") % 3).cast("int").alias("owner_id"), rating.alias("rating"), _c("props").alias("reason"), _c("event_id").alias("position")
    )


@query(
    "P14_offline_candidates",
    """SELECT user_id AS message_id, CAST(event_id % 3 AS INT) AS owner_id, '{"rating":"negative","position":' || event_id || '}' AS payload FROM events WHERE event_type = 'error'""",
)
def p14_offline(spark, sf):
    return C.offline_candidates(_feedback(spark, sf), ["rating", "position"])


# ---- integrity --------------------------------------------------------------------------


@query(
    "I1_check_references",
    """SELECT 'chunk_source' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0
    UNION ALL SELECT 'entity_source', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey * 11 NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'entity_name', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 7
    UNION ALL SELECT 'relation_source', concat(l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_orderkey + l_linenumber NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'relation_src', concat(l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'relation_tgt', concat(l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_suppkey * 30 NOT IN (SELECT p_partkey FROM part)""",
)
def i1(spark, sf):
    k = _c("o_orderkey")
    chunks = read(spark, sf, "orders").select(k.alias("chunk_id"), F.when((k % 50 == 0) & (k > 0), k - 1).otherwise(k).alias("source_id"))
    p = _c("p_partkey")
    entities = read(spark, sf, "part").select(p.alias("entity_id"), F.when(_c("p_size") == 7, p).alias("name"), (p * 11).alias("source_id"))
    relations = read(spark, sf, "lineitem").select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("relation_id"), _c("l_partkey").alias("src_entity_id"), (_c("l_suppkey") * 30).alias("tgt_entity_id"),
        (_c("l_orderkey") + _c("l_linenumber")).alias("source_id"),
    )
    return I.check_references(chunks, entities, relations)


@query(
    "I2_leftovers",
    """WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT 'edges' AS store, count(DISTINCT CASE WHEN l_orderkey IN (FROM r) THEN concat(l_partkey, '-', l_suppkey) END) AS leftovers, CAST(0 AS BIGINT) AS orphans, false AS passed FROM lineitem
    UNION ALL SELECT 'chunks', count(CASE WHEN lang = 'fr' OR (doc_id % 9 <> 0 AND doc_id IN (FROM r)) THEN 1 END), count(CASE WHEN lang <> 'fr' AND doc_id % 9 = 0 THEN 1 END), false FROM documents""",
)
def i2(spark, sf):
    purged = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(_c("o_orderkey").alias("chunk_id"))
    none = F.lit(None)
    edges = read(spark, sf, "lineitem").select(
        F.concat("l_partkey", F.lit("-"), "l_suppkey").alias("id"), none.cast("string").alias("kb_id"), none.cast("long").alias("doc_id"), _c("l_orderkey").alias("source_id")
    )
    fr = _c("lang") == "fr"
    bare = ~fr & (_c("doc_id") % 9 == 0)
    chunks = read(spark, sf, "documents").select(
        _c("doc_id").cast("string").alias("id"), F.when(fr, "fr").alias("kb_id"), F.when(~bare, _c("doc_id")).alias("doc_id"), none.cast("long").alias("source_id")
    )
    return I.leftovers({"edges": edges, "chunks": chunks}, purged.select(_c("chunk_id").alias("doc_id")), purged, "fr")


@query(
    "I3_document_consistency",
    """WITH e AS (SELECT DISTINCT o_custkey AS d, o_orderkey AS c FROM orders), ch AS (SELECT o_custkey AS d, o_orderkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 1 GROUP BY ALL),
    ve AS (SELECT o_custkey AS d, o_orderkey AS c, 1 AS n FROM orders WHERE o_orderkey % 13 <> 0),
    a AS (SELECT coalesce(e.d, ch.d) AS d, e.c IS NOT NULL AS ex, coalesce(ch.n, 0) AS cn, coalesce(ve.n, 0) AS vn FROM e FULL JOIN ch ON e.d = ch.d AND e.c = ch.c LEFT JOIN ve ON ve.d = e.d AND ve.c = e.c)
    SELECT d AS doc_id, count(CASE WHEN ex THEN 1 END) AS n_expected, count(CASE WHEN ex AND (cn = 0 OR vn = 0) THEN 1 END) AS missing, count(CASE WHEN cn > 1 OR vn > 1 THEN 1 END) AS repeated, count(CASE WHEN NOT ex THEN 1 END) AS surplus,
      count(CASE WHEN ex THEN 1 END) > 0 AND count(CASE WHEN (ex AND (cn = 0 OR vn = 0)) OR cn > 1 OR vn > 1 OR NOT ex THEN 1 END) = 0 AS passed FROM a GROUP BY d""",
)
def i3(spark, sf):
    o = read(spark, sf, "orders").select(_c("o_custkey").alias("doc_id"), _c("o_orderkey").alias("chunk_id"))
    li = read(spark, sf, "lineitem").filter("l_linenumber <= 1").select(_c("l_orderkey").alias("chunk_id"))
    return I.document_consistency(o, o.join(li, "chunk_id"), o.filter("chunk_id % 13 <> 0"))


def _removed(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(_c("o_orderkey").alias("chunk_id"))


@query(
    "I4_remove_documents",
    """WITH s AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, l_orderkey, o_orderpriority AS kb, o_orderstatus = 'F' AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT src, tgt, count(*) AS n_sources, count(DISTINCT kb) AS n_scopes FROM s WHERE NOT gone GROUP BY ALL""",
)
def i4(spark, sf):
    from kgspark.operators.graph_build import sources_of

    r = D.relation_records(spark, sf)
    key = ["src", "tgt"]
    scopes = read(spark, sf, "orders").select(_c("o_orderkey").alias("chunk_id"), _c("o_orderpriority").alias("kb_id"))
    elements, kept, tags = I.remove_documents(sources_of(r, key), D.edges(spark, sf), scopes, _removed(spark, sf), key)
    n = F.count(F.lit(1))
    return elements.select(*key).join(kept.groupBy(*key).agg(n.alias("n_sources")), key).join(tags.groupBy(*key).agg(n.alias("n_scopes")), key)


@query(
    "I4_cached_answers",
    """SELECT DISTINCT o_custkey AS entry_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def i4_cache(spark, sf):
    cited = read(spark, sf, "orders").select(_c("o_custkey").alias("entry_id"), _c("o_orderkey").alias("chunk_id"))
    return I.cached_answers(cited.select("entry_id").distinct(), cited, _removed(spark, sf))


@query(
    "I5_purge_scope",
    """SELECT 'documents' AS "table", count(*) AS dropped FROM documents WHERE lang = 'fr' UNION ALL SELECT 'pages', count(*) FROM pages WHERE contains(url, '/fr/')""",
)
def i5(spark, sf):
    tables = {
        "documents": read(spark, sf, "documents").withColumn("kb_id", _c("lang")),
        "pages": read(spark, sf, "pages").withColumn("kb_id", F.when(_c("url").contains("/fr/"), "fr")),
    }
    return I.purge_scope(tables, "fr")[1]


# ---- evaluation -------------------------------------------------------------------------

# Benchmark texts are the questions. Documents that contain a text's middle are expected.
_MARK = "substr(b.text, len(b.text) // 3 + 1, len(b.text) // 3)"
_EVAL = f"""{S.KEYWORD},
 ex AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, {_MARK})),
 qs AS (SELECT item_id AS query_id, item_id IN (SELECT query_id FROM ex) AS answerable, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS kb FROM benchmark),
 ht AS (SELECT query_id, doc_id, rank, lang FROM keyword JOIN documents USING (doc_id) WHERE score >= 0.75),
 pq AS (SELECT qs.query_id, answerable, min(CASE WHEN ex.doc_id IS NOT NULL AND place <= 5 THEN place END) AS best, coalesce(sum(CASE WHEN ex.doc_id IS NOT NULL AND place <= 5 THEN 1 / log2(place + 1) END), 0) AS dcg,
   count(ex.doc_id) AS found, count(ht.doc_id) AS returned, count(CASE WHEN lang <> kb THEN 1 END) AS leaks
   FROM qs LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ht) ht ON ht.query_id = qs.query_id LEFT JOIN ex ON ex.query_id = ht.query_id AND ex.doc_id = ht.doc_id GROUP BY ALL),
 ne AS (SELECT query_id, count(*) AS n FROM ex GROUP BY ALL),
 id AS (SELECT query_id, n, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 5) + 1) t(i)) AS ideal FROM ne),
 mq AS (SELECT pq.query_id, answerable, CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END AS recall_1, CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0.0 END AS recall_5, coalesce(1.0::DOUBLE / best, 0) AS mrr_5,
   coalesce(dcg / ideal, 0) AS ndcg_5, CASE WHEN found = n AND leaks = 0 THEN 1.0 ELSE 0.0 END AS complete, returned, leaks FROM pq LEFT JOIN id USING (query_id))"""


def _expected(spark, sf):
    """Texts meet documents on a shared window of words; ``contains`` then decides."""
    from kgspark.plans.search import containing

    b = D.queries(spark, sf)
    third = F.floor(F.length("text") / 3).cast("int")
    marks = b.select("query_id", _c("text").substr(third + 1, third).alias("mark"))
    return containing(D.docs(spark, sf).select("doc_id", "text"), marks).select("query_id", _c("doc_id").alias("unit_id"))


def _questions(spark, sf, expected):
    q = D.queries(spark, sf).select("query_id", F.when(_c("query_id") % 2 == 0, "en").otherwise("fr").alias("kb_id"), F.lit("").alias("owner_id"))
    known = expected.select("query_id").distinct().withColumn("_a", F.lit(True))
    return q.join(known, "query_id", "left").withColumn("answerable", _c("_a").isNotNull()).drop("_a")


def _scored(spark, sf):
    hits = D.keyword_hits(spark, sf).filter("score >= 0.75").join(D.docs(spark, sf).select("doc_id", "kb_id", "owner_id"), "doc_id")
    expected = _expected(spark, sf)
    return _questions(spark, sf, expected), expected, hits.withColumnRenamed("doc_id", "unit_id")


@query(
    "E1_question_metrics",
    f"""WITH {_EVAL} SELECT query_id, answerable, recall_1::DOUBLE AS recall_1, recall_5::DOUBLE AS recall_5, round(mrr_5, 6) AS mrr_5, round(ndcg_5, 6) AS ndcg_5, complete::DOUBLE AS complete, returned, leaks FROM mq""",
)
def e1(spark, sf):
    m = E.question_metrics(*_scored(spark, sf))
    return m.withColumn("mrr_5", F.round("mrr_5", 6)).withColumn("ndcg_5", F.round("ndcg_5", 6))


@query(
    "E1_metrics",
    f"""WITH {_EVAL}, a AS (SELECT count(*) AS count, avg(CASE WHEN answerable THEN recall_1 END) AS r1, avg(CASE WHEN answerable THEN recall_5 END) AS r5, avg(CASE WHEN answerable THEN mrr_5 END) AS m5, avg(CASE WHEN answerable THEN ndcg_5 END) AS n5,
      avg(CASE WHEN answerable THEN complete END) AS co, count(CASE WHEN returned = 0 THEN 1 END) AS si, count(CASE WHEN returned = 0 AND NOT answerable THEN 1 END) AS ri, count(CASE WHEN NOT answerable THEN 1 END) AS no, CAST(sum(leaks) AS BIGINT) AS leaks FROM mq),
    b AS (SELECT *, CASE WHEN si = 0 THEN 1.0::DOUBLE ELSE ri / si::DOUBLE END AS p, CASE WHEN no = 0 THEN 1.0::DOUBLE ELSE ri / no::DOUBLE END AS r FROM a)
    SELECT count, round(r1::DOUBLE, 4) AS recall_1, round(r5::DOUBLE, 4) AS recall_5, round(m5, 4) AS mrr_5, round(n5, 4) AS ndcg_5, round(co::DOUBLE, 4) AS citation_accuracy, leaks, round(p, 4) AS no_answer_precision, round(r, 4) AS no_answer_recall,
      CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE round(2 * p * r / (p + r), 4) END AS no_answer_f1, CASE WHEN no = 0 THEN 0.0::DOUBLE ELSE round((no - ri) / no::DOUBLE, 4) END AS false_return_rate FROM b""",
)
def e1_metrics(spark, sf):
    return E.metrics(E.question_metrics(*_scored(spark, sf)))


@query(
    "E2_latency_summary",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS count, round(min(value), 4) AS min, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1 THEN value END), 4) AS p50,
      round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1 THEN value END), 4) AS p95, round(max(value), 4) AS max FROM o GROUP BY event_type""",
)
def e2(spark, sf):
    return E.latency_summary(read(spark, sf, "events"), ["event_type"], "value", 1.0)


_OBSERVED = f"""{_EVAL},
 sc AS (SELECT bm25.query_id, doc_id, score / (score + 4.0::DOUBLE) AS s, ex.doc_id IS NOT NULL AS good FROM bm25 LEFT JOIN ex USING (query_id, doc_id)),
 bs AS (SELECT query_id, max(CASE WHEN good THEN s END) AS p, max(CASE WHEN NOT good THEN s END) AS n, max(s) AS a FROM sc GROUP BY ALL),
 ob AS (SELECT query_id, 'positive' AS label, p AS score FROM qs JOIN bs USING (query_id) WHERE answerable AND p IS NOT NULL UNION ALL SELECT query_id, 'hard_negative', coalesce(n, 0) FROM qs LEFT JOIN bs USING (query_id) WHERE answerable
   UNION ALL SELECT query_id, 'irrelevant', coalesce(a, 0) FROM qs LEFT JOIN bs USING (query_id) WHERE NOT answerable)"""


def _observed(spark, sf):
    from kgspark.operators.lexical import bm25_scores, calibrate_bm25

    scores = bm25_scores(D.docs(spark, sf).select("doc_id", "text"), D.queries(spark, sf))
    scores = scores.select("query_id", _c("doc_id").alias("unit_id"), calibrate_bm25(_c("score")).alias("score"))
    expected = _expected(spark, sf)
    return E.observations(scores, expected, _questions(spark, sf, expected))


@query("E3_observations", f"WITH {_OBSERVED} SELECT query_id, label, round(score, 6) AS score FROM ob")
def e3(spark, sf):
    return _observed(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "E4_fit_floor",
    f"""WITH {_OBSERVED}, g AS (SELECT query_id % 4 AS part, coalesce(min(CASE WHEN label = 'positive' AND score > 0 THEN score END), min(CASE WHEN label = 'positive' THEN score END)) AS lo, max(CASE WHEN label <> 'positive' THEN score END) AS hi FROM ob GROUP BY ALL)
    SELECT part, CASE WHEN lo IS NULL THEN 0.25::DOUBLE WHEN hi IS NOT NULL AND lo > hi THEN round((lo + hi) / 2, 4) ELSE round(greatest(0.0::DOUBLE, lo - 0.01::DOUBLE), 4) END AS floor FROM g""",
)
def e4(spark, sf):
    return E.fit_floor(_observed(spark, sf).withColumn("part", _c("query_id") % 4), ["part"])


@query(
    "E6_quality_gate",
    """WITH m AS (SELECT unnest(['mix', 'vector', 'graph']) AS mode, 0 AS x), o AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'mix' WHEN 1 THEN 'vector' ELSE 'graph' END AS mode, avg(l_discount) AS r0, avg(l_tax) AS r1, avg(l_tax) AS f0, avg(l_discount) AS f1, CAST(sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS lk FROM lineitem GROUP BY ALL)
    SELECT mode, concat_ws(',', CASE WHEN lk > 0 THEN 'leaks' END, CASE WHEN mode = 'mix' AND r1 + 0.01 < r0 THEN 'recall' END, CASE WHEN mode = 'mix' AND f1 > f0 THEN 'false_returns' END) AS failures FROM o""",
)
def e6(spark, sf):
    li = read(spark, sf, "lineitem")
    k = _c("l_linenumber") % 3
    g = li.groupBy(F.when(k == 0, "mix").when(k == 1, "vector").otherwise("graph").alias("mode"))
    leaks = F.sum(F.when(_c("l_discount") > 0.09, 1).otherwise(0)).alias("leaks")
    off = g.agg(F.avg("l_discount").alias("recall_5"), F.avg("l_tax").alias("false_return_rate"), F.lit(0).cast("long").alias("leaks"))
    on = g.agg(F.avg("l_tax").alias("recall_5"), F.avg("l_discount").alias("false_return_rate"), leaks)
    return E.quality_gate(off, on).select("mode", F.concat_ws(",", "failures").alias("failures"))
