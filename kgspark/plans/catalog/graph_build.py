"""Graph construction from extraction text and from order lines."""

from pyspark.sql import functions as F

from kgspark.functions.patterns import SQL as P
from kgspark.operators import graph_build as G
from kgspark.operators import graph_edit as X
from kgspark.operators.scale import cut_lineage, discard, written
from kgspark.plans import domain as D
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read

_ORDER = ", ".join(D.LINE_ORDER)


def _repaired(x):
    return (
        f"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<\\|#\\|*?#\\|>', '<|#|>', 'g'), "
        "'<\\|+>', '<|#|>', 'g'), '<\\|?#\\|?>', '<|#|>', 'g'), '<[^|]#\\|>', '<|#|>', 'g'), '<\\|#\\| ', '<|#|> ', 'g'), '||#||', '<|#|>')"
    )


def _short(x):
    return f"CASE WHEN len({x}) < 6 AND regexp_matches({x}, '^[0-9.]+$') AND contains({x}, '.') THEN '' ELSE {x} END"


PARSED = f"""
 pl AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey),
 ex AS (SELECT l_orderkey AS chunk_id, 0 AS pass, string_agg({D.FIRST_PASS}, chr(10) ORDER BY {_ORDER}) || chr(10) || '<|COMPLETE|>' AS result,
   CAST(epoch(min(l_shipdate)) AS BIGINT) AS ts FROM pl GROUP BY l_orderkey
   UNION ALL SELECT l_orderkey, 1, string_agg({D.SECOND_PASS}, chr(10) ORDER BY {_ORDER}) || chr(10) || '<|COMPLETE|>',
   CAST(epoch(min(l_shipdate)) AS BIGINT) FROM pl WHERE l_linenumber % 3 = 0 GROUP BY l_orderkey),
 rl AS (SELECT chunk_id, pass, ts, list_filter(list_transform(regexp_split_to_array(result, '\\n|<\\|COMPLETE\\|>'), lambda x: trim(x)), lambda x: x <> '') AS l FROM ex),
 rc AS (SELECT chunk_id, pass, ts, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS pos FROM rl),
 fl AS MATERIALIZED (SELECT chunk_id, pass, ts, pos, list_filter(list_transform(string_split({_repaired("r")}, '<|#|>'), lambda x: trim(x)), lambda x: x <> '') AS f FROM rc),
 ent AS MATERIALIZED (SELECT chunk_id, pass, ts, pos, f[2] AS name, upper(substr(f[3], 1, 1)) || lower(substr(f[3], 2)) AS entity_type, f[4] AS description FROM fl
   WHERE len(f) = 4 AND contains(f[1], 'entity')),
 rel AS (SELECT chunk_id, pass, ts, pos, f[2] AS src, f[3] AS tgt, f[4] AS keywords, {_short("f[5]")} AS description,
   CASE WHEN regexp_matches(f[5], '{G.FLOAT}') THEN CAST(f[5] AS DOUBLE) ELSE 1.0::DOUBLE END AS weight FROM fl WHERE len(f) = 5 AND contains(f[1], 'relation'))"""

BEST = (
    PARSED
    + """,
 e1 AS (SELECT chunk_id, name, pass, arg_min(description, pos) AS d FROM ent GROUP BY ALL),
 eb AS (SELECT chunk_id, name, pass FROM e1 QUALIFY row_number() OVER (PARTITION BY chunk_id, name ORDER BY len(d) DESC, pass) = 1),
 be AS (SELECT ent.* FROM ent JOIN eb USING (chunk_id, name, pass))"""
)


def _records(spark, sf):
    return G.parse_records(D.extractions(spark, sf))


def _parsed(spark, sf):
    """Parsing is the costly step, and its records feed several merges: all are written out once."""
    records = written(_records(spark, sf))
    parsed = written(G.best_pass(G.entity_records(records), ["name"])), written(G.relation_records(records))
    discard(records)
    return parsed


def _best(spark, sf):
    return G.best_pass(G.entity_records(_records(spark, sf)), ["name"])


def _entities(spark, sf):
    return written(_best(spark, sf))


def _relations(spark, sf):
    return G.relation_records(_records(spark, sf))


@query(
    "G1_parse_records",
    f"WITH {PARSED} SELECT chunk_id, pass, CAST(pos AS INT) AS pos, CAST(len(f) AS INT) AS n_fields, md5(array_to_string(f, '|')) AS fields_hash FROM fl",
)
def g1(spark, sf):
    r = _records(spark, sf)
    return r.select("chunk_id", "pass", "pos", F.size("fields").alias("n_fields"), F.md5(F.array_join("fields", "|")).alias("fields_hash"))


@query("G2_entity_records", f"WITH {PARSED} SELECT chunk_id, pass, CAST(pos AS INT) AS pos, name, entity_type, description FROM ent")
def g2(spark, sf):
    return G.entity_records(_records(spark, sf)).select("chunk_id", "pass", "pos", "name", "entity_type", "description")


@query("G3_relation_records", f"WITH {PARSED} SELECT chunk_id, pass, CAST(pos AS INT) AS pos, src, tgt, keywords, description, weight FROM rel")
def g3(spark, sf):
    return _relations(spark, sf).select("chunk_id", "pass", "pos", "src", "tgt", "keywords", "description", "weight")


@query("G4_best_pass", f"WITH {BEST} SELECT chunk_id, name, pass, CAST(pos AS INT) AS pos FROM be")
def g4(spark, sf):
    return _best(spark, sf).select("chunk_id", "name", "pass", "pos")


_NODES = """,
 vt AS (SELECT name, entity_type, count(*) AS n, min((ts, chunk_id, pos)) AS seen FROM be GROUP BY ALL),
 ty AS (SELECT name, entity_type FROM vt QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, seen) = 1)"""


@query(
    "G5_merge_entities",
    f"""WITH {BEST}{_NODES}, ag AS (SELECT name, count(*) AS n_records, count(DISTINCT chunk_id) AS n_sources, count(DISTINCT description) AS n_texts, min(ts) AS created_at FROM be GROUP BY name)
    SELECT name, entity_type, n_records, n_sources, n_texts, created_at FROM ty JOIN ag USING (name)""",
)
def g5(spark, sf):
    e = _entities(spark, sf)
    sources = G.sources_of(e, ["name"]).groupBy("name").agg(F.count(F.lit(1)).alias("n_sources"))
    texts = G.texts_of(e, ["name"]).groupBy("name").agg(F.count(F.lit(1)).alias("n_texts"))
    return G.merge_entities(e).join(sources, "name").join(texts, "name").select(
        "name", "entity_type", "n_records", "n_sources", "n_texts", "created_at"
    )


@query(
    "G5_entity_texts",
    f"""WITH {BEST}, tx AS (SELECT name, description, min((ts, chunk_id, pos)) AS seen FROM be GROUP BY ALL)
    SELECT name, description, row_number() OVER (PARTITION BY name ORDER BY seen[1], len(description) DESC, seen) AS ordinal FROM tx""",
)
def g5_texts(spark, sf):
    return G.ordered_texts(G.texts_of(_entities(spark, sf), ["name"]), ["name"]).select("name", "description", "ordinal")


_EDGES = """,
 er AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, weight, keywords, chunk_id FROM rel),
 kw AS (SELECT DISTINCT src, tgt, trim(unnest(string_split(keywords, ','))) AS k FROM er),
 kj AS (SELECT src, tgt, string_agg(k, ',' ORDER BY k) AS keywords FROM kw WHERE k <> '' GROUP BY ALL),
 ed AS (SELECT src, tgt, sum(weight) AS weight, count(*) AS n_records FROM er GROUP BY ALL)"""


@query("G6_merge_relations", f"WITH {PARSED}{_EDGES} SELECT src, tgt, round(weight, 6) AS weight, n_records, keywords FROM ed JOIN kj USING (src, tgt)")
def g6(spark, sf):
    merged = G.merge_relations(_relations(spark, sf))
    return merged.select("src", "tgt", F.round("weight", 6).alias("weight"), "n_records", "keywords")


@query(
    "G6_missing_endpoints",
    f"""WITH {BEST} SELECT DISTINCT name, 'UNKNOWN' AS entity_type FROM (SELECT src AS name FROM rel UNION SELECT tgt FROM rel) WHERE name NOT IN (SELECT name FROM be WHERE pass = 0)""",
)
def g6_missing(spark, sf):
    entities, relations = _parsed(spark, sf)
    return G.missing_endpoints(relations, G.merge_entities(entities.filter("pass = 0")))


@query(
    "G7_document_index",
    f"""WITH {BEST}, al AS (SELECT name, chunk_id FROM be UNION SELECT src, chunk_id FROM rel WHERE src NOT IN (SELECT name FROM be)
      UNION SELECT tgt, chunk_id FROM rel WHERE tgt NOT IN (SELECT name FROM be)),
    ne AS (SELECT o_custkey AS doc_id, count(DISTINCT name) AS n_entities FROM al JOIN orders ON o_orderkey = chunk_id GROUP BY ALL),
    nr AS (SELECT o_custkey AS doc_id, count(DISTINCT (least(src, tgt), greatest(src, tgt))) AS n_relations FROM rel JOIN orders ON o_orderkey = chunk_id GROUP BY ALL)
    SELECT doc_id, n_entities, n_relations FROM ne JOIN nr USING (doc_id)""",
)
def g7(spark, sf):
    graph = G.build_graph(*_parsed(spark, sf))
    owner = read(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
    entities, relations = G.document_index(graph, owner)
    n = F.count(F.lit(1))
    return entities.groupBy("doc_id").agg(n.alias("n_entities")).join(relations.groupBy("doc_id").agg(n.alias("n_relations")), "doc_id")


@query("G8_summaries")
def g8(spark, sf):
    r = D.relation_records(spark, sf)
    lots = r.select(F.col("tgt").alias("name"), "chunk_id", "pos", "created_at", F.concat_ws(" ", "description", "src", "weight").alias("description"))
    return G.summarise(G.texts_of(lots, ["name"]), ["name"], _shorten, group_tokens=400)


def _shorten(texts):
    """Stand-in for a model: the first word of every fragment."""
    return " ".join(t.split(" ")[0] for t in texts)


@query(
    "G9_bounded_paths",
)
def g9(spark, sf):
    li = read(spark, sf, "lineitem")
    path = F.concat(F.lit("orders/"), "l_orderkey", F.lit("/"), F.repeat(F.lit("x"), (F.col("l_linenumber") * 9).cast("int")), F.lit(".txt"))
    paths = li.select(F.col("l_suppkey").alias("name"), path.alias("path"), F.col("l_orderkey").alias("position"))
    return G.bounded_paths(paths, ["name"]).select("name", "n_paths", F.md5("file_path").alias("path_hash"))


@query(
    "G10_backfill_index",
    """SELECT o_custkey AS doc_id, 'S' || l_suppkey AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       UNION SELECT o_custkey, 'P' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def g10(spark, sf):
    r = D.relation_records(spark, sf)
    both = r.withColumn("name", F.explode(F.array("src", "tgt")))
    graph = G.Graph(None, None, G.sources_of(both, ["name"]), G.sources_of(r, ["src", "tgt"]), None, None)
    owner = read(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
    return G.document_index(graph, owner)[0]


_CLAIMS = f"""
 tk AS (SELECT doc_id, text, {S.tokens("text")} AS t FROM documents),
 cl AS (SELECT doc_id, text, t[1] AS src, t[len(t)] AS tgt, coalesce(t[3], '') AS keywords, 'about ' || doc_id AS description FROM tk WHERE len(t) >= 2)"""


@query(
    "G11_grounded",
    f"""WITH {_CLAIMS} SELECT doc_id, src, tgt FROM cl WHERE contains(text, src) AND contains(text, tgt) AND src <> '' AND tgt <> ''
      AND ((keywords <> '' AND contains(text, keywords)) OR contains(text, description))""",
)
def g11(spark, sf):
    from kgspark.functions.text import computed_once, tokens

    docs = D.docs(spark, sf)
    t = computed_once(docs, ["doc_id"], t=tokens(F.col("text"))).filter(F.size("t") >= 2)
    claims = t.select(
        "doc_id", F.get("t", F.lit(0)).alias("src"), F.element_at("t", -1).alias("tgt"),
        F.coalesce(F.get("t", F.lit(2)), F.lit("")).alias("keywords"), F.concat(F.lit("about "), "doc_id").alias("description"),
    )
    return G.grounded(cut_lineage(claims), docs).select("doc_id", "src", "tgt")  # claims are read twice


@query(
    "G12_merge_evidence",
    """WITH o AS (SELECT DISTINCT l_suppkey AS name, l_orderkey AS source_id FROM lineitem WHERE l_linestatus = 'O'),
    f AS (SELECT l_suppkey AS name, l_orderkey AS source_id, min(l_partkey) AS doc_id FROM lineitem WHERE l_linestatus <> 'O' GROUP BY ALL)
    SELECT name, source_id, source_id AS doc_id FROM o UNION ALL SELECT name, source_id, doc_id FROM f ANTI JOIN o USING (name, source_id)""",
)
def g12(spark, sf):
    li = read(spark, sf, "lineitem")
    key = [F.col("l_suppkey").alias("name"), F.col("l_orderkey").alias("source_id")]
    old = li.filter("l_linestatus = 'O'").select(*key, F.col("l_orderkey").alias("doc_id")).distinct()
    new = li.filter("l_linestatus <> 'O'").select(*key, F.col("l_partkey").alias("doc_id"))
    return G.merge_evidence(old, new, ["name"])


@query(
    "G13_supersede",
    """WITH e AS (SELECT user_id AS src, event_type AS relation_type, CAST(floor(value) AS INT) % 5 AS tgt, event_id FROM events),
    t AS (SELECT src, relation_type, tgt, min(event_id) AS f, max(event_id) AS l FROM e GROUP BY ALL),
    c AS (SELECT t.*, (SELECT max(e.event_id) FROM e WHERE e.src = t.src AND e.relation_type = t.relation_type AND e.tgt <> t.tgt AND e.event_id > t.f) AS closer FROM t)
    SELECT src, relation_type, CAST(tgt AS INT) AS tgt, l AS relation_id, CASE WHEN closer IS NULL THEN 'active' ELSE 'superseded' END AS status, closer AS superseded_by FROM c""",
)
def g13(spark, sf):
    e = read(spark, sf, "events").select(
        F.col("user_id").alias("src"), F.col("event_type").alias("relation_type"), (F.floor("value").cast("int") % 5).alias("tgt"),
        F.col("event_id").alias("position"), F.col("event_id").alias("relation_id"),
    )
    return G.supersede(e)


@query(
    "G13_closed_edges",
    """WITH e AS (SELECT user_id AS src, event_type AS relation_type, CAST(floor(value) AS INT) % 5 AS tgt, event_id, ts FROM events),
    t AS (SELECT src, relation_type, tgt, min(event_id) AS f, max(event_id) AS l FROM e GROUP BY ALL),
    c AS (SELECT t.*, (SELECT max(e.event_id) FROM e WHERE e.src = t.src AND e.relation_type = t.relation_type AND e.tgt <> t.tgt AND e.event_id > t.f) AS closer FROM t)
    SELECT c.src, c.relation_type, CAST(c.tgt AS INT) AS tgt, l AS relation_id, CASE WHEN closer IS NULL THEN 'active' ELSE 'superseded' END AS status, closer AS superseded_by,
      CAST(floor(epoch(ts)) AS BIGINT) AS invalid_at FROM c LEFT JOIN e ON e.event_id = closer""",
)
def g13_closed(spark, sf):
    """The second half of the events comes on top of the first."""
    e = read(spark, sf, "events").select(
        F.col("user_id").alias("src"), F.col("event_type").alias("relation_type"), (F.floor("value").cast("int") % 5).alias("tgt"),
        F.col("event_id").alias("position"), F.col("event_id").alias("relation_id"), F.col("ts").cast("timestamp").cast("long").alias("at"),
    )
    middle = e.agg(F.max("position")).first()[0] // 2
    return X.supersede_onto(e.filter(F.col("position") <= middle), e.filter(F.col("position") > middle))


@query(
    "G14_merge_nodes",
    """WITH n AS (SELECT 'P' || p_partkey AS name, p_partkey AS position, p_type, p_brand, p_retailprice FROM part),
    m AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'M ' || p_name ELSE 'P' || p_partkey END AS target, part.* FROM part)
    SELECT target AS name, arg_min(p_type, p_partkey) AS p_type, arg_max(p_brand, p_partkey) AS p_brand, max(p_retailprice) AS p_retailprice, count(*) AS n_merged FROM m GROUP BY target""",
)
def g14(spark, sf):
    p = read(spark, sf, "part")
    name = F.concat(F.lit("P"), "p_partkey")
    nodes = p.select(name.alias("name"), F.col("p_partkey").alias("position"), "p_type", "p_brand", "p_retailprice")
    return G.merge_nodes(nodes, _mapping(spark, sf), {"p_type": "keep_first", "p_brand": "keep_last", "p_retailprice": "max"})


def _mapping(spark, sf):
    p = read(spark, sf, "part").filter("p_partkey % 4 = 0")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("source"), F.concat(F.lit("M "), "p_name").alias("target"))


@query(
    "G14_rewire_edges",
    """WITH e AS (SELECT 'P' || l_partkey AS p, 'S' || l_suppkey AS s, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
    m AS (SELECT 'P' || p_partkey AS source, 'M ' || p_name AS target FROM part WHERE p_partkey % 4 = 0)
    SELECT least(coalesce(target, p), s) AS src, greatest(coalesce(target, p), s) AS tgt, max(weight) AS weight, count(*) AS n_merged FROM e LEFT JOIN m ON source = p GROUP BY ALL""",
)
def g14_edges(spark, sf):
    return G.rewire_edges(D.edges(spark, sf).select("src", "tgt", "weight"), _mapping(spark, sf))


#: Chains of five parts; at every twentieth the chain runs back into itself.
_CHAINS = """
 m AS (SELECT 'P' || p_partkey AS source, 'P' || CASE WHEN p_partkey % 20 = 0 THEN p_partkey - 3 ELSE p_partkey + 1 END AS target FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 20 = 0),
 walk AS (SELECT source, target, 1 AS n FROM m UNION ALL SELECT w.source, m.target, n + 1 FROM walk w JOIN m ON m.source = w.target WHERE n < 30),
 ends AS (SELECT source, arg_max(target, n) AS target, max(n) >= 30 AS cyclic FROM walk GROUP BY source),
 done AS (SELECT e.source, CASE WHEN cyclic THEN m.target ELSE e.target END AS target, cyclic FROM ends e JOIN m USING (source))"""


def _chains(spark, sf):
    k = F.col("p_partkey")
    onward = F.when(k % 20 == 0, k - 3).otherwise(k + 1)
    return read(spark, sf, "part").filter("p_partkey % 5 <> 0 OR p_partkey % 20 = 0").select(F.concat(F.lit("P"), k).alias("source"), F.concat(F.lit("P"), onward).alias("target"))


@query("G14_resolved_chains", f"WITH RECURSIVE {_CHAINS} SELECT source, target, cyclic FROM done")
def g14_chains(spark, sf):
    return X.resolve_merges(_chains(spark, sf))


_STRATEGIES = {"p_type": "concatenate", "p_brand": "join_unique", "p_size": "keep_last", "p_retailprice": "max"}


def _merged_chains(spark, sf):
    p = read(spark, sf, "part")
    nodes = p.select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_partkey").alias("position"), *_STRATEGIES)
    edges = D.edges(spark, sf).select("src", "tgt", "weight", F.col("src").alias("position"))
    return X.merge_graph(nodes, edges, _chains(spark, sf), _STRATEGIES, {"weight": "max"})


_ENDS = f"{_CHAINS}, to_ AS (SELECT source, target FROM done WHERE NOT cyclic)"


@query(
    "G14_merged_chains",
    f"""WITH RECURSIVE {_ENDS}, n AS (SELECT coalesce(target, 'P' || p_partkey) AS name, part.* FROM part LEFT JOIN to_ ON source = 'P' || p_partkey)
    SELECT name, string_agg(p_type, chr(10) || chr(10) ORDER BY p_partkey) AS p_type, array_to_string(list_sort(list(DISTINCT p_brand)), '<SEP>') AS p_brand,
      arg_max(p_size, p_partkey) AS p_size, max(p_retailprice) AS p_retailprice, count(*) AS n_merged FROM n GROUP BY name""",
)
def g14_merged(spark, sf):
    return _merged_chains(spark, sf)[0]


@query(
    "G14_moved_edges",
    f"""WITH RECURSIVE {_ENDS}, e AS (SELECT 'P' || l_partkey AS p, 'S' || l_suppkey AS s, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
    SELECT coalesce(target, p) AS src, s AS tgt, max(weight) AS weight, count(*) AS n_merged FROM e LEFT JOIN to_ ON source = p GROUP BY ALL""",
)
def g14_moved(spark, sf):
    return _merged_chains(spark, sf)[1]


def _changes(spark, sf):
    """Rename every 10th part, retype every 15th, and try some parts that do not exist."""
    p = read(spark, sf, "part").filter("p_partkey % 5 = 0").select("p_partkey")
    k = F.col("p_partkey")
    name = F.concat(F.lit("P"), F.when(k % 35 == 0, k + 1000000).otherwise(k))
    new = F.when(k % 20 == 0, F.concat(F.lit("P"), k + 1)).when(k % 10 == 0, F.concat(F.lit("N"), k))
    return p.select(
        name.alias("name"), new.alias("new_name"), F.when(k % 15 == 0, "EDITED").alias("entity_type"), F.lit(None).cast("string").alias("description")
    )


_EDITS = """
 n AS (SELECT 'P' || p_partkey AS name, p_type AS entity_type, p_name AS description FROM part),
 c AS (SELECT 'P' || CASE WHEN p_partkey % 35 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS name,
   CASE WHEN p_partkey % 20 = 0 THEN 'P' || (p_partkey + 1) WHEN p_partkey % 10 = 0 THEN 'N' || p_partkey END AS new_name,
   CASE WHEN p_partkey % 15 = 0 THEN 'EDITED' END AS entity_type FROM part WHERE p_partkey % 5 = 0),
 k AS (SELECT *, CASE WHEN name NOT IN (SELECT name FROM n) THEN 'missing' WHEN new_name IN (SELECT name FROM n) THEN 'taken' END AS reason FROM c)"""


def _part_nodes(spark, sf):
    return read(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"))


@query(
    "G15_edit_nodes",
    f"""WITH {_EDITS} SELECT coalesce(g.new_name, n.name) AS name, coalesce(g.entity_type, n.entity_type) AS entity_type, n.description FROM n LEFT JOIN (SELECT * FROM k WHERE reason IS NULL) g USING (name)""",
)
def g15(spark, sf):
    return G.edit_nodes(_part_nodes(spark, sf), _changes(spark, sf))[0]


@query("G15_rejected_edits", f"WITH {_EDITS} SELECT name, new_name, reason FROM k WHERE reason IS NOT NULL")
def g15_rejected(spark, sf):
    return G.edit_nodes(_part_nodes(spark, sf), _changes(spark, sf))[1].select("name", "new_name", "reason")


@query(
    "G15_create_relations",
    """SELECT 'P' || ps.p AS src, 'S' || ps.s AS tgt FROM (SELECT p_partkey AS p, p_partkey % (SELECT count(*) FROM supplier) AS s FROM part) ps
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p AND l_suppkey = s)""",
)
def g15_create(spark, sf):
    n = read(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    wanted = read(spark, sf, "part").select("p_partkey").crossJoin(F.broadcast(n)).select(  # one row
        F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("S"), (F.col("p_partkey") % F.col("n"))).alias("tgt")
    )
    return G.create_elements(wanted, D.edges(spark, sf), ["src", "tgt"])[0]


@query(
    "G15_edited_edges",
    f"""WITH {_EDITS}, r AS (SELECT name, new_name FROM k WHERE reason IS NULL AND new_name IS NOT NULL)
    SELECT coalesce(new_name, 'P' || l_partkey) AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem LEFT JOIN r ON name = 'P' || l_partkey GROUP BY ALL""",
)
def g15_edges(spark, sf):
    """Edges follow the parts that are renamed."""
    return X.edit_graph(_part_nodes(spark, sf), D.edges(spark, sf).select("src", "tgt", "weight"), _changes(spark, sf))[1]


@query(
    "G15_edited_relations",
    """WITH e AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey)
    SELECT src, tgt, CASE WHEN l_suppkey % 3 = 0 THEN -weight ELSE weight END AS weight FROM e""",
)
def g15_relations(spark, sf):
    e = D.edges(spark, sf).select("src", "tgt", "weight")
    third = e.filter("CAST(substring(tgt, 2) AS INT) % 3 = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), (-F.col("weight")).alias("weight"))
    return X.edit_relations(e, third)[0]


@query(
    "G15_checked_relations",
    """WITH n AS (SELECT count(*) AS n FROM supplier), w AS (SELECT p_partkey AS p, p_partkey % n + CASE WHEN p_partkey % 7 = 0 THEN 1000000 ELSE 0 END AS s FROM part, n)
    SELECT 'P' || p AS src, 'S' || s AS tgt, CASE WHEN p NOT IN (SELECT l_partkey FROM lineitem) OR s NOT IN (SELECT l_suppkey FROM lineitem) THEN 'missing end'
      WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p AND l_suppkey = s) THEN 'exists' ELSE 'created' END AS reason FROM w""",
)
def g15_checked(spark, sf):
    n = read(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("p_partkey")
    wanted = read(spark, sf, "part").crossJoin(F.broadcast(n)).select(  # one row
        F.concat(F.lit("S"), k % F.col("n") + F.when(k % 7 == 0, 1000000).otherwise(0)).alias("tgt"), F.concat(F.lit("P"), k).alias("src")
    )
    created, rejected = X.create_relations(wanted, D.edges(spark, sf), D.nodes(spark, sf))
    return created.withColumn("reason", F.lit("created")).unionByName(rejected)


@query(
    "G16_delete_nodes",
    """SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem
       WHERE l_suppkey % 4 <> 0 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY ALL""",
)
def g16(spark, sf):
    gone = read(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("name"))
    gone = gone.unionByName(read(spark, sf, "part").filter("p_size < 10").select(F.concat(F.lit("P"), "p_partkey").alias("name")))
    return G.delete_nodes(D.nodes(spark, sf), D.edges(spark, sf), gone)[1].select("src", "tgt", "weight")


@query(
    "G16_delete_edges",
    """SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0""",
)
def g16_edges(spark, sf):
    pairs = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("tgt"))
    return G.delete_edges(D.edges(spark, sf), pairs).select("src", "tgt", "weight")


def _removed(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"))


@query(
    "G17_deletion_impact",
    """WITH s AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, l_orderkey FROM lineitem),
    j AS (SELECT src, tgt, count(*) AS n, count(o_orderkey) AS lost FROM s LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT src, tgt, CASE WHEN lost = n THEN 'delete' WHEN lost > 0 THEN 'rebuild' ELSE 'keep' END AS action, n - lost AS remaining FROM j""",
)
def g17(spark, sf):
    return G.deletion_impact(G.sources_of(D.relation_records(spark, sf), ["src", "tgt"]), _removed(spark, sf), ["src", "tgt"])


@query(
    "G18_rebuild_edges",
    """WITH k AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, l_quantity, l_returnflag, l_linestatus, o_orderstatus = 'F' AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    w AS (SELECT src, tgt FROM k GROUP BY ALL HAVING bool_or(gone) AND NOT bool_and(gone)),
    r AS (SELECT k.* FROM k JOIN w USING (src, tgt) WHERE NOT gone),
    x AS (SELECT DISTINCT src, tgt, unnest([l_returnflag, l_linestatus]) AS word FROM r)
    SELECT src, tgt, sum(l_quantity) AS weight, count(*) AS n_records, (SELECT string_agg(word, ',' ORDER BY word) FROM x WHERE x.src = r.src AND x.tgt = r.tgt) AS keywords FROM r GROUP BY src, tgt""",
)
def g18(spark, sf):
    r = D.relation_records(spark, sf)
    both = r.withColumn("name", F.explode(F.array("src", "tgt"))).withColumn("entity_type", F.substring("name", 1, 1))
    graph = G.build_graph(both, r)
    return G.rebuild(both, r, graph, _removed(spark, sf)).edges


@query(
    "G18_rebuild_nodes",
    """WITH k AS (SELECT unnest(['P' || l_partkey, 'S' || l_suppkey]) AS name, l_orderkey, o_orderstatus = 'F' AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    w AS (SELECT name FROM k GROUP BY ALL HAVING bool_or(gone) AND NOT bool_and(gone))
    SELECT name, substr(name, 1, 1) AS entity_type, count(*) AS n_records FROM k JOIN w USING (name) WHERE NOT gone GROUP BY name""",
)
def g18_nodes(spark, sf):
    r = D.relation_records(spark, sf)
    both = r.withColumn("name", F.explode(F.array("src", "tgt"))).withColumn("entity_type", F.substring("name", 1, 1))
    graph = G.build_graph(both, r)
    return G.rebuild(both, r, graph, _removed(spark, sf)).nodes.select("name", "entity_type", "n_records")
