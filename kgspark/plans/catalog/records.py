"""Storage, versions, facts and scoping on documents, events and orders."""

from pyspark.sql import functions as F

from kgspark.functions.patterns import SPACE_CHARS as _SPACES
from kgspark.operators import chunking as C
from kgspark.operators import scoping as P
from kgspark.operators import versioning as D2
from kgspark.operators.scale import use_all_cores
from kgspark.plans import domain as D
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read
from kgspark.sources import storage as ST

_c = F.col


@query(
    "S2_enqueue",
    f"""WITH c AS (SELECT doc_id, {S.strip("text")} AS t, source || '/' || doc_id AS p FROM documents),
    f AS (SELECT 'doc-' || md5(t) AS doc_key, t, p FROM c QUALIFY row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id) = 1)
    SELECT doc_key, CASE WHEN len(t) <= 250 THEN t ELSE substr(t, 1, 250) || '...' END AS content_summary, CAST(len(t) AS INT) AS content_length, p AS file_path FROM f
    WHERE doc_key NOT IN (SELECT 'doc-' || md5({S.strip("text")}) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def s2(spark, sf):
    d = use_all_cores(read(spark, sf, "documents"))
    arrivals = d.select(_c("doc_id").alias("position"), "text", F.concat_ws("/", "source", "doc_id").alias("file_path"))
    toxic = read(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    stored = d.join(toxic, "doc_id", "left_semi").select(F.concat(F.lit("doc-"), F.md5(F.btrim("text", F.lit(_SPACES)))).alias("doc_key"))
    return ST.enqueue(arrivals, stored).select("doc_key", "content_summary", "content_length", "file_path")





@query(
    "S3_register_uploads",
    """WITH u AS (SELECT doc_id AS position, doc_id, source AS owner_id, lang AS kb_id, 'f' || (n_chars % 20) AS name, md5(text) AS h FROM documents),
    a AS (SELECT *, first_value(doc_id) OVER w AS f FROM u WINDOW w AS (PARTITION BY owner_id, kb_id, h ORDER BY position)), k AS (SELECT * FROM a WHERE doc_id = f),
    v AS (SELECT position, doc_id, first_value(doc_id) OVER o AS document_id, lag(doc_id) OVER o AS previous_doc_id, row_number() OVER (PARTITION BY kb_id, name ORDER BY position) AS version, CAST(NULL AS BIGINT) AS duplicate_of
      FROM k WINDOW o AS (PARTITION BY owner_id, kb_id, name ORDER BY position))
    SELECT * FROM v UNION ALL SELECT position, doc_id, NULL, NULL, NULL, f FROM a WHERE doc_id <> f""",
)
def s3(spark, sf):
    d = read(spark, sf, "documents")
    name = F.concat(F.lit("f"), _c("n_chars") % 20)
    return ST.register_uploads(d.select(
        _c("doc_id").alias("position"), "doc_id", _c("source").alias("owner_id"), _c("lang").alias("kb_id"), name.alias("name"), F.md5("text").alias("content_hash")
    ), segment=100)


@query(
    "S4_insert_chunks",
    """WITH p AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))),
    o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, i DESC) = 1)
    SELECT 'chunk-' || md5(t) AS chunk_id, doc_id, CAST(i AS INT) AS chunk_order_index FROM o WHERE md5(t) NOT IN (SELECT md5(text) FROM benchmark)""",
)
def s4(spark, sf):
    docs = D.docs(spark, sf).select("doc_id", F.split("text", "\n", -1).alias("chunks"))
    toxic = read(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    have = read(spark, sf, "benchmark").select(F.concat(F.lit("chunk-"), F.md5("text")).alias("chunk_id"))
    return ST.insert_chunks(docs, toxic, have).select("chunk_id", "doc_id", "chunk_order_index")


@query(
    "S5_insert_graph",
    """WITH c AS (SELECT o_orderkey AS source_id, 'chunk-' || md5(o_orderpriority || o_orderkey) AS chunk_id FROM orders WHERE o_orderstatus <> 'P'),
    e AS (SELECT 'S' || s_suppkey AS name, 'org' AS entity_type, s_suppkey AS k FROM supplier),
    n AS (SELECT name, entity_type, coalesce(chunk_id, 'UNKNOWN') AS source_id FROM e LEFT JOIN c ON source_id = k),
    r AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, coalesce(chunk_id, 'UNKNOWN') AS s FROM lineitem LEFT JOIN c ON source_id = l_orderkey)
    SELECT name, entity_type, source_id FROM n UNION ALL SELECT src, 'UNKNOWN', min(s) FROM r GROUP BY src""",
)
def s5(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    chunks = o.select(_c("o_orderkey").alias("source_id"), F.concat("o_orderpriority", "o_orderkey").alias("content"))
    s = read(spark, sf, "supplier")
    entities = s.select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.lit("org").alias("entity_type"), _c("s_name").alias("description"), _c("s_suppkey").alias("source_id"))
    relations = D.relation_records(spark, sf).select("src", "tgt", "description", "keywords", "weight", _c("chunk_id").alias("source_id"))
    return ST.insert_graph(chunks, entities, relations)[1].select("name", "entity_type", "source_id")


@query(
    "S6_upsert",
    """WITH s AS (SELECT o_orderkey AS k, o_totalprice AS value, o_orderkey AS ct FROM orders WHERE o_orderstatus = 'O'),
    c AS (SELECT l_orderkey AS k, arg_max(l_extendedprice, l_linenumber * 10000000.0 + l_extendedprice) AS v, arg_max(l_linenumber, l_linenumber * 10000000.0 + l_extendedprice) AS u, arg_min(l_linenumber, l_linenumber * 10000000.0 + l_extendedprice) AS m FROM lineitem GROUP BY ALL)
    SELECT coalesce(s.k, c.k) AS k, coalesce(v, value) AS value, coalesce(ct, m) AS create_time, coalesce(u, ct) AS update_time FROM s FULL JOIN c ON s.k = c.k""",
)
def s6(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus = 'O'")
    k = _c("o_orderkey")
    stored = o.select(k.alias("k"), _c("o_totalprice").alias("value"), k.alias("create_time"), k.alias("update_time"))
    li = read(spark, sf, "lineitem")
    changes = li.select(_c("l_orderkey").alias("k"), _c("l_extendedprice").alias("value"), _c("l_linenumber").cast("long").alias("at"), (_c("l_linenumber") * 10000000.0 + _c("l_extendedprice")).alias("o"))
    return ST.upsert(stored, changes, "k", "o")


@query(
    "S7_merge_attributes",
    """WITH a AS (SELECT p_partkey AS name, p_type AS entity_type, CASE WHEN p_size > 25 THEN p_brand END AS kb_id FROM part WHERE p_partkey % 3 <> 0),
    b AS (SELECT p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'NEW' END AS entity_type, 'kb-new' AS kb_id FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(a.name, b.name) AS name, coalesce(b.entity_type, a.entity_type) AS entity_type, coalesce(a.kb_id, b.kb_id) AS kb_id FROM a FULL JOIN b ON a.name = b.name""",
)
def s7(spark, sf):
    p = read(spark, sf, "part")
    a = p.filter("p_partkey % 3 <> 0").select(_c("p_partkey").alias("name"), _c("p_type").alias("entity_type"), F.when(_c("p_size") > 25, _c("p_brand")).alias("kb_id"))
    b = p.filter("p_partkey % 2 = 0").select(_c("p_partkey").alias("name"), F.when(_c("p_size") % 2 == 0, "NEW").alias("entity_type"), F.lit("kb-new").alias("kb_id"))
    return ST.merge_attributes(a, b, ["name"])


@query("S8_get_by_ids", "SELECT item_id AS ordinal, item_id * 37 AS doc_id, source FROM benchmark LEFT JOIN documents ON doc_id = item_id * 37")
def s8(spark, sf):
    wanted = read(spark, sf, "benchmark").select(_c("item_id").alias("ordinal"), (_c("item_id") * 37).alias("doc_id"))
    return ST.get_by_ids(wanted, read(spark, sf, "documents").select("doc_id", "source"), "doc_id")


@query("S9_filter_keys", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM documents)")
def s9(spark, sf):
    return ST.filter_keys(read(spark, sf, "lineitem").select(_c("l_partkey").alias("k")), read(spark, sf, "documents").select(_c("doc_id").alias("k")), "k")


@query("S10_delete_by_ids", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def s10(spark, sf):
    gone = read(spark, sf, "labels").filter("quality = 0")
    return ST.delete_by_ids(read(spark, sf, "documents").select("doc_id", "source"), gone, "doc_id")


@query(
    "S11_export_relations",
    """WITH e AS (SELECT 'P' || l_partkey AS a, 'S' || l_suppkey AS b, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
       SELECT a AS src, b AS tgt, weight FROM e UNION ALL SELECT b, a, weight FROM e""",
)
def s11(spark, sf):
    return ST.export_relations(D.edges(spark, sf).select("src", "tgt", "weight"))


_JSONL = "CASE WHEN event_id % 9 = 0 THEN 'broken ' || props ELSE '{\"context\": \"' || event_type || ' ' || CAST(user_id AS STRING) || '\"}' END"


@query("S12_unique_contexts", "SELECT DISTINCT event_type || ' ' || user_id AS context FROM events WHERE event_id % 9 <> 0")
def s12(spark, sf):
    return ST.unique_contexts(read(spark, sf, "events").select(F.expr(_JSONL).alias("value")))


@query("S13_chunk_search", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the in') OR contains(lower(source), 'the in')")
def s13(spark, sf):
    return ST.search(read(spark, sf, "documents"), ["text", "source"], " The in ").select("doc_id", "n_chars")


# ---- versions ---------------------------------------------------------------------------

_PIECES = f"""
 pc AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS pos FROM
   (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS l FROM documents))"""


def _exploded(docs, pieces):
    """An outer explode: of an inner one Spark infers a filter that computes the pieces again."""
    return docs.select("doc_id", F.posexplode_outer(pieces).alias("pos", "content")).filter("pos IS NOT NULL")


def _old(spark, sf):
    return _exploded(D.docs(spark, sf), C.delimiter_pieces(_c("text"), "\n", 0, 0))


def _new(spark, sf):
    """The next version: every fifth piece is gone, every seventh has more text."""
    kept = D.docs(spark, sf).withColumn("_p", C.delimiter_pieces(_c("text"), "\n", 0, 0))
    marked = F.transform("_p", lambda p, i: F.when(i % 5 != 4, F.when(i % 7 == 3, F.concat(p, F.lit(" revised 42"))).otherwise(p)))
    return _exploded(kept, F.array_compact(marked))


_NEW = """
 nw AS (SELECT doc_id, CASE WHEN pos % 7 = 3 THEN content || ' revised 42' ELSE content END AS content, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM pc WHERE pos % 5 <> 4)"""


@query(
    "D1_decorate",
    f"""WITH {_PIECES}, s AS (SELECT doc_id, pos, {S.squash("content")} AS b FROM pc)
    SELECT doc_id, CAST(pos AS INT) AS pos, sha256(b) AS content_hash, 'index:' || (pos + 1) AS anchor, 'schunk-' || substr(sha256(concat_ws(chr(10), doc_id, 'content', b)), 1, 24) AS stable_chunk_id FROM s""",
)
def d1(spark, sf):
    return D2.decorate(_old(spark, sf)).drop("content")


@query(
    "D1_structure_hash",
    f"""WITH {_PIECES} SELECT doc_id, sha256(string_agg(concat_ws('|', 't' || pos, len(content)), chr(10) ORDER BY pos)) AS structure_hash FROM pc GROUP BY doc_id""",
)
def d1_structure(spark, sf):
    units = _old(spark, sf).withColumn("unit", F.concat(F.lit("t"), "pos")).withColumn("n", F.length("content"))
    return D2.structure_hash(units, ["unit", "n"], "pos")


_EXACT = f"""{_PIECES}, {_NEW},
 o AS (SELECT doc_id, pos, {S.squash("content")} AS h FROM pc), n AS (SELECT doc_id, pos, {S.squash("content")} AS h FROM nw),
 sm AS (SELECT o.doc_id, o.pos AS old_pos, n.pos AS new_pos FROM o JOIN n ON o.doc_id = n.doc_id AND o.pos = n.pos AND o.h = n.h),
 o1 AS (SELECT doc_id, h, max(pos) AS old_pos FROM o GROUP BY ALL HAVING count(*) = 1), n1 AS (SELECT doc_id, h, max(pos) AS new_pos FROM n GROUP BY ALL HAVING count(*) = 1),
 uq AS (SELECT doc_id, old_pos, new_pos FROM o1 JOIN n1 USING (doc_id, h) WHERE (doc_id, old_pos) NOT IN (SELECT (doc_id, old_pos) FROM sm) AND (doc_id, new_pos) NOT IN (SELECT (doc_id, new_pos) FROM sm))"""


@query("D2_exact_matches", f"WITH {_EXACT} SELECT doc_id, CAST(old_pos AS INT) AS old_pos, CAST(new_pos AS INT) AS new_pos FROM sm UNION ALL SELECT * FROM uq")
def d2_exact(spark, sf):
    return D2.compare_exact(D2.decorate(_old(spark, sf)), D2.decorate(_new(spark, sf)), ["doc_id"])[0]


@query("D2_compare_versions")
def d2(spark, sf):
    return D2.compare(D2.decorate(_old(spark, sf)), D2.decorate(_new(spark, sf)))


@query("D3_change_summary")
def d3(spark, sf):
    return D2.change_summary(D2.compare(D2.decorate(_old(spark, sf)), D2.decorate(_new(spark, sf))), ["doc_id"])


_LINES = f"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, {S.squash("l")} AS line FROM
   (SELECT doc_id, unnest(string_split(replace(text, '%s', '%s'), chr(10))) AS l FROM documents)) WHERE line <> '' GROUP BY ALL"""


@query(
    "D4_line_diffs",
    f"""WITH o AS ({_LINES % (" the ", " the ")}), n AS ({_LINES % (" the ", " 12 the ")}),
    d AS (SELECT doc_id, line, coalesce(n.n, 0) - coalesce(o.n, 0) AS more FROM o FULL JOIN n USING (doc_id, line))
    SELECT doc_id, CASE WHEN more > 0 THEN '新增' ELSE '删除' END AS kind, line, abs(more) AS times,
      CASE WHEN regexp_matches(line, '[0-9]') THEN '高' ELSE '中' END AS severity FROM d WHERE more <> 0""",
)
def d4(spark, sf):
    old = D.docs(spark, sf).select("doc_id", "text")
    return D2.line_changes(old, old.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" 12 the "))), ["doc_id"])


_QA = "SELECT conv_id, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role, turn FROM conversations"


@query(
    "D5_qa_differences",
    f"""WITH q AS ({_QA}), p AS (SELECT conv_id, regexp_replace(question, '{S.P.WS}+', '', 'g') AS q, answer, turn FROM q WHERE role = 'user' AND answer IS NOT NULL),
    o AS (SELECT conv_id, q, max(answer) AS a FROM p WHERE turn % 4 = 0 OR turn < 3 GROUP BY ALL), n AS (SELECT conv_id, q, max(CASE WHEN turn = 2 THEN answer || '!' ELSE answer END) AS a FROM p WHERE turn % 4 = 2 OR turn < 3 GROUP BY ALL)
    SELECT conv_id, md5(q) AS q, CASE WHEN o.a IS NULL THEN 'only_new' WHEN n.a IS NULL THEN 'only_old' ELSE 'different' END AS state FROM o FULL JOIN n USING (conv_id, q) WHERE o.a IS DISTINCT FROM n.a""",
)
def d5(spark, sf):
    conv = read(spark, sf, "conversations")
    ask = conv.filter("role = 'user'").select("conv_id", "turn", _c("text").alias("question"))
    reply = conv.select("conv_id", (_c("turn") - 1).alias("turn"), _c("text").alias("answer"))
    p = ask.join(reply, ["conv_id", "turn"])
    old = p.filter("turn % 4 = 0 OR turn < 3")
    new = p.filter("turn % 4 = 2 OR turn < 3").withColumn("answer", F.when(_c("turn") == 2, F.concat("answer", F.lit("!"))).otherwise(_c("answer")))
    return D2.qa_differences(old, new, ["conv_id"]).select("conv_id", F.md5("q").alias("q"), "state")


@query(
    "D6_fact_differences",
    """WITH a AS (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS INT) % 5 AS v FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS INT) % 5 AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16')
    SELECT *, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)""",
)
def d6(spark, sf):
    e = read(spark, sf, "events").withColumn("v", F.floor("value").cast("int") % 5)
    part = lambda cond: e.filter(cond).select("user_id", "event_type", "v").distinct()
    return D2.fact_differences(part("ts < TIMESTAMP_NTZ'2024-01-16'"), part("ts >= TIMESTAMP_NTZ'2024-01-16'"))


@query(
    "D7_publish",
    """WITH v AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'draft' END AS status FROM orders), p AS (SELECT document_id, max(version_id) AS n FROM v WHERE document_id % 2 = 0 GROUP BY ALL)
    SELECT document_id, version_id, CASE WHEN version_id = n THEN 'published' WHEN n IS NOT NULL AND status = 'published' THEN 'superseded' ELSE status END AS status FROM v LEFT JOIN p USING (document_id)""",
)
def d7(spark, sf):
    v = _versions(spark, sf)
    return D2.publish(v, v.filter("document_id % 2 = 0").groupBy("document_id").agg(F.max("version_id").alias("version_id")))


def _versions(spark, sf):
    status = F.when(_c("o_orderstatus") == "F", "published").otherwise("draft")
    return read(spark, sf, "orders").select(_c("o_custkey").alias("document_id"), _c("o_orderkey").alias("version_id"), status.alias("status"))


FACTS = """
 ft AS (SELECT user_id, event_type, event_id AS fact_id, ts AS valid_at, CAST(floor(value) AS INT) % 3 AS value FROM events),
 st AS (SELECT *, value IS DISTINCT FROM lag(value) OVER w AS start FROM ft WINDOW w AS (PARTITION BY user_id, event_type ORDER BY valid_at, fact_id)),
 iv AS (SELECT *, min(CASE WHEN start THEN (valid_at, fact_id) END) OVER (PARTITION BY user_id, event_type ORDER BY valid_at, fact_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM st)"""


def facts(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select("user_id", "event_type", _c("event_id").alias("fact_id"), _c("ts").alias("valid_at"), (F.floor("value").cast("int") % 3).alias("value"))
    return D2.activate_facts(rows, ["user_id", "event_type"], F.date_trunc("day", _c("valid_at")))


@query(
    "D8_activate_facts",
    f"WITH {FACTS} SELECT user_id, event_type, fact_id, epoch_us(nx[1]) AS invalid_us, nx[2] AS superseded_by, CASE WHEN nx IS NULL THEN 'active' ELSE 'superseded' END AS status FROM iv",
)
def d8(spark, sf):
    f = facts(spark, sf)
    return f.select("user_id", "event_type", "fact_id", F.unix_micros(_c("invalid_at").cast("timestamp")).alias("invalid_us"), "superseded_by", "status")


@query(
    "D9_facts_valid_at",
    f"WITH {FACTS} SELECT user_id, event_type, fact_id, CAST(value AS INT) AS value FROM iv WHERE valid_at <= TIMESTAMP '2024-01-20' AND (nx IS NULL OR nx[1] > TIMESTAMP '2024-01-20')",
)
def d9(spark, sf):
    moment = F.expr("TIMESTAMP_NTZ'2024-01-20'")
    return D2.valid_at(facts(spark, sf), moment).select("user_id", "event_type", "fact_id", "value")


@query(
    "D9_still_active",
    """SELECT event_id FROM events WHERE event_id % 4 = 0 OR (event_id % 4 = 1 AND ts > TIMESTAMP '2024-01-20')""",
)
def d9_active(spark, sf):
    e = read(spark, sf, "events")
    end = F.when(_c("event_id") % 4 == 0, "").when(_c("event_id") % 4 == 1, _c("ts").cast("string")).otherwise("soon")
    return D2.still_active(e.withColumn("invalid_at", end), F.expr("TIMESTAMP'2024-01-20'")).select("event_id")


@query(
    "D10_latest_versions",
    "SELECT o_orderkey AS version_id, o_custkey AS document_id FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderkey DESC LIMIT 200",
)
def d10(spark, sf):
    v = _versions(spark, sf).join(read(spark, sf, "customer").select(_c("c_custkey").alias("document_id")), "document_id")
    return D2.latest(v.select("version_id", "document_id"), "version_id", 500)


_STATE = """SELECT lang, count(*) AS n, {} FROM (SELECT lang, sha256('+' || concat_ws(':', doc_id, n_chars, md5(text))) AS h FROM documents {}) GROUP BY lang""".format(
    ", ".join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT) % 1152921504606846976 AS h{k + 1}" for k in range(4)), "{}"
)
_PRINT = f"SELECT lang, substr(sha256(concat_ws('-', n, h1, h2, h3, h4)), 1, 16) AS fingerprint FROM ({_STATE})"


@query("D11_kb_fingerprint", _PRINT.format(""))
def d11(spark, sf):
    d = read(spark, sf, "documents")
    return D2.fingerprint(d, ["lang"], F.concat_ws(":", "doc_id", "n_chars", F.md5("text")))


@query("D11_fingerprint_update", _PRINT.format("WHERE doc_id % 3 <> 0"))
def d11_update(spark, sf):
    """The fingerprint of two thirds of the documents, from the state of others by adding and removing."""
    d = read(spark, sf, "documents")
    state = lambda rows: D2.multiset_state(rows, ["lang"], F.concat_ws(":", "doc_id", "n_chars", F.md5("text")))
    third = _c("doc_id") % 3
    return D2.state_fingerprint(
        D2.changed_state(state(d.where(third != 1)), state(d.where(third == 1)), state(d.where(third == 0)), ["lang"]), ["lang"]
    )


@query(
    "D11_corpus_revision",
    f"""WITH {_PIECES} SELECT doc_id, substr(sha256(string_agg('chunk-' || md5(content), chr(10) ORDER BY md5(content))), 1, 16) AS revision FROM pc GROUP BY doc_id""",
)
def d11_revision(spark, sf):
    return D2.corpus_revision(_old(spark, sf).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content"))))


# ---- scoping and status -----------------------------------------------------------------

_RECORDS = """SELECT doc_id AS id, doc_id % 211 AS doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '<SEP>fr' WHEN 1 THEN lang ELSE '' END AS kb_id, source || '/' || 'f' || (n_chars % 30) || '.txt' AS file_path FROM documents"""
_INDEX = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE lang END AS kb_id, CASE doc_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' ELSE 'ready' END AS status, doc_id % 10 = 7 AS deleted FROM documents JOIN labels USING (doc_id)"""


@query(
    "P1_visible",
    f"""WITH r AS ({_RECORDS}), i AS ({_INDEX}), b AS (SELECT DISTINCT 'f' || (n_chars % 30) || '.txt' AS f FROM documents WHERE lang = 'fr' AND n_chars % 30 < 12)
    SELECT id FROM r LEFT JOIN i ON i.doc_id = r.doc_id WHERE NOT coalesce(deleted OR status IN ('failed', 'queued'), false)
      AND CASE WHEN r.kb_id <> '' THEN list_contains(string_split(r.kb_id, '<SEP>'), 'fr') WHEN i.doc_id IS NOT NULL THEN i.kb_id = 'fr' AND NOT deleted
          ELSE regexp_extract(file_path, '[^/]*$') IN (SELECT f FROM b) END""",
)
def p1(spark, sf):
    d = read(spark, sf, "documents")
    kb = F.when(_c("doc_id") % 4 == 0, F.concat("lang", F.lit("<SEP>fr"))).when(_c("doc_id") % 4 == 1, _c("lang")).otherwise("")
    name = F.concat(F.lit("f"), _c("n_chars") % 30, F.lit(".txt"))
    records = d.select(_c("doc_id").alias("id"), (_c("doc_id") % 211).alias("doc_id"), kb.alias("kb_id"), F.concat("source", F.lit("/"), name).alias("file_path"))
    k = _c("doc_id")
    status = F.when(k % 6 == 0, "failed").when(k % 6 == 1, "queued").otherwise("ready")
    index = d.join(read(spark, sf, "labels").select("doc_id"), "doc_id").select(
        "doc_id", F.when(k % 3 == 0, "fr").otherwise(_c("lang")).alias("kb_id"), status.alias("status"), (k % 10 == 7).alias("deleted")
    )
    bindings = d.filter("lang = 'fr' AND n_chars % 30 < 12").select(name.alias("file_name"), F.lit("fr").alias("kb_id")).distinct()
    return P.visible(records, "fr", index, bindings, "id").select("id")


_STATUS = "CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'processed' END"


def _status_docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.expr(_STATUS).alias("status"), _c("source").alias("track_id"), "n_chars")


@query(
    "P2_status_counts",
    f"""WITH s AS (SELECT {_STATUS} AS status FROM documents) SELECT n.status, count(s.status) AS n FROM (SELECT unnest(['pending', 'processing', 'processed', 'failed']) AS status) n LEFT JOIN s USING (status) GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM s""",
)
def p2(spark, sf):
    return P.status_counts(_status_docs(spark, sf))


@query("P3_docs_by_status", f"SELECT doc_id FROM documents WHERE {_STATUS} = 'pending' AND source = 'src1'")
def p3(spark, sf):
    return _status_docs(spark, sf).filter("status = 'pending' AND track_id = 'src1'").select("doc_id")


@query("P4_page", "SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def p4(spark, sf):
    return ST.page(read(spark, sf, "documents").select("doc_id", "n_chars"), [_c("n_chars").desc(), _c("doc_id")], 3, 50)


@query(
    "P5_repair_statuses",
    """WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'processed' END AS status FROM documents), h AS (SELECT doc_id FROM documents WHERE lang = 'en')
    SELECT doc_id, CASE WHEN doc_id IN (FROM h) AND status IN ('processing', 'failed') THEN 'pending' ELSE status END AS status FROM s WHERE doc_id IN (FROM h) OR status NOT IN ('pending', 'processing')""",
)
def p5(spark, sf):
    k = _c("doc_id") % 5
    status = F.when(k == 0, "pending").when(k == 1, "processing").when(k == 2, "failed").otherwise("processed")
    d = read(spark, sf, "documents")
    return P.repair_statuses(d.select("doc_id", status.alias("status")), d.filter("lang = 'en'").select("doc_id"))


_JOBS = """SELECT event_id AS job_id, user_id * 7 AS doc_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'succeeded' ELSE 'running' END AS job_status,
  CASE event_type WHEN 'view' THEN 'embedding' WHEN 'signup' THEN '' ELSE 'chunking' END AS stage, CAST(floor(value) AS INT) AS progress FROM events"""


def _jobs(spark, sf):
    e = read(spark, sf, "events")
    t = _c("event_type")
    return e.select(
        _c("event_id").alias("job_id"), (_c("user_id") * 7).alias("doc_id"), _c("ts").alias("created_at"),
        F.when(t == "error", "failed").when(t == "click", "succeeded").otherwise("running").alias("job_status"),
        F.when(t == "view", "embedding").when(t == "signup", "").otherwise("chunking").alias("stage"), F.floor("value").cast("int").alias("progress"),
    )


@query(
    "P6_document_list",
    f"""WITH j AS ({_JOBS}), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, job_id DESC) = 1),
    i AS (SELECT doc_id, 'doc ' || doc_id AS dn, CASE WHEN doc_id % 2 = 0 THEN 'queued' ELSE '' END AS st FROM labels WHERE toxic = 0),
    d AS (SELECT doc_id, source AS name FROM documents WHERE lang = 'en'),
    a AS (SELECT coalesce(d.doc_id, i.doc_id) AS doc_id, name, dn, st, i.doc_id IS NOT NULL AS ix, d.doc_id IS NOT NULL AS dc FROM d FULL JOIN i ON d.doc_id = i.doc_id),
    s AS (SELECT a.*, job_id, progress, CASE WHEN NOT ix THEN 'ready' WHEN job_status = 'succeeded' THEN 'ready' WHEN job_status = 'failed' THEN 'failed' WHEN stage <> '' THEN stage ELSE coalesce(nullif(st, ''), 'queued') END AS status FROM a LEFT JOIN l USING (doc_id))
    SELECT doc_id, coalesce(dn, name) AS name, status, CASE WHEN status = 'ready' THEN 100 ELSE coalesce(progress, 0) END AS progress, coalesce(CAST(job_id AS VARCHAR), '') AS job_id FROM s""",
)
def p6(spark, sf):
    docs = read(spark, sf, "documents").filter("lang = 'en'").select("doc_id", _c("source").alias("name"))
    index = read(spark, sf, "labels").filter("toxic = 0").select(
        "doc_id", F.concat(F.lit("doc "), "doc_id").alias("display_name"), F.when(_c("doc_id") % 2 == 0, "queued").otherwise("").alias("status"), F.lit(False).alias("deleted")
    )
    jobs = _jobs(spark, sf).withColumn("job_id", _c("job_id").cast("string"))
    jobs = jobs.withColumn("created_at", F.struct("created_at", _c("job_id").cast("long").alias("j")))
    return P.document_list(docs, index, jobs)


@query(
    "P7_latest_jobs",
    f"WITH j AS ({_JOBS}) SELECT doc_id, job_id, job_status FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, job_id DESC) = 1",
)
def p7(spark, sf):
    return P.latest_jobs(_jobs(spark, sf), ["doc_id"]).select("doc_id", "job_id", "job_status")


@query("P7_expired_jobs", "SELECT event_id AS job_id FROM events WHERE event_type NOT IN ('error', 'click') AND event_id % 3 <> 0 AND ts <= TIMESTAMP '2024-01-10'")
def p7_expired(spark, sf):
    j = _jobs(spark, sf).withColumn("lease_until", F.when(_c("job_id") % 3 != 0, _c("created_at")))
    return P.expired_jobs(j, F.expr("TIMESTAMP_NTZ'2024-01-10'")).select("job_id")


@query("P8_audit_list", "SELECT doc_id, CASE WHEN quality = 1 THEN 'passed' WHEN quality = 0 THEN 'rejected' ELSE 'open' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def p8(spark, sf):
    decisions = read(spark, sf, "labels").select(_c("doc_id").alias("item_id"), F.when(_c("quality") == 1, "passed").otherwise("rejected").alias("decision"))
    items = read(spark, sf, "documents").select(_c("doc_id").alias("item_id"))
    return P.audit_list(items, decisions, "open").select(_c("item_id").alias("doc_id"), "status")


@query("P9_qa_search", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'than')")
def p9(spark, sf):
    return ST.search(read(spark, sf, "conversations").filter("role = 'user'"), ["text"], "THAN").select("conv_id", "turn")


@query(
    "P10_conversation_list",
    "SELECT conv_id, arg_min(text, turn) AS title, conv_id % 5 = 0 AS is_pinned, max(turn) AS last_message_at FROM conversations GROUP BY conv_id HAVING contains(arg_min(text, turn), 'th')",
)
def p10(spark, sf):
    conv = read(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.max("turn").alias("last_message_at"))
    return P.conversation_list(conv.withColumn("is_pinned", _c("conv_id") % 5 == 0), "th")
