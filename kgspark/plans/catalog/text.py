"""Text functions over the whole documents, pages and part names."""

from pyspark.sql import functions as F

from kgspark.functions import ids, text as X
from kgspark.functions.patterns import SQL as P
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read


@query(
    "T1_tokenize",
    f"""
    WITH t AS (SELECT doc_id, {S.tokens("text")} AS toks FROM documents)
    SELECT doc_id, CAST(len(toks) AS INT) AS n_tokens, md5(array_to_string(toks, ' ')) AS token_hash FROM t
    """,
)
def t1(spark, sf):
    toks = read(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return toks.select(
        "doc_id", F.size("t").alias("n_tokens"), F.md5(F.concat_ws(" ", "t")).alias("token_hash")
    )


@query(
    "T4_calibrate",
    """
    SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50.0 - 0.5)) AS cosine,
           CASE WHEN value <= 0 THEN 0.0::DOUBLE ELSE value / (value + 4.0) END AS bm25,
           CASE WHEN value <= 0 THEN 0.0::DOUBLE WHEN value <= 1.0 THEN value
                ELSE value / (value + 4.0) END AS relevance
    FROM events
    """,
)
def t4(spark, sf):
    from kgspark.operators import lexical as L

    v = F.col("value")
    return read(spark, sf, "events").select(
        "event_id",
        L.calibrate_cosine(v / 50.0 - 0.5).alias("cosine"),
        L.calibrate_bm25(v).alias("bm25"),
        L.absolute_relevance(v).alias("relevance"),
    )


@query("T5_sanitize")
def t5(spark, sf):
    pages = read(spark, sf, "pages")
    return pages.select("page_id", F.md5(X.sanitize(F.col("html"))).alias("clean_hash"))


# Names in several spellings, one per part and form.
_FORMS = ("{}", '"{}"', "《{}》", "<br>{} 中 文", "“{}”零 件", "（{}）", "１２{}", "'{}'")


def _spelled():
    cases = " ".join(f"WHEN {i} THEN '" + f.replace("'", "''").format("' || p_name || '") + "'" for i, f in enumerate(_FORMS))
    return f"CASE p_partkey % {len(_FORMS)} {cases} END"


_H = P.HAN
_A = r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"


@query(
    "T6_normalize_names",
    f"""
    WITH s AS (SELECT p_partkey, translate(regexp_replace({_spelled()}, '(?i)<br>|</p>', '', 'g'), '１２（）', '12()') AS n FROM part),
    g AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(n, '({_H})\\s+({_H})', '\\1\\2', 'g'),
            '({_H})\\s+({_A})', '\\1\\2', 'g'), '({_A})\\s+({_H})', '\\1\\2', 'g') AS n FROM s),
    q AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '^"([^"]*)"$', '\\1'),
            '^''([^'']*)''$', '\\1'), '^“([^“”]*)”$', '\\1'), '^《([^《》]*)》$', '\\1') AS n FROM g)
    SELECT p_partkey, trim(translate(n, '“”', '')) AS name FROM q
    """,
)
def t6(spark, sf):
    return read(spark, sf, "part").select(
        "p_partkey", X.normalize_name(F.expr(_spelled()), inner_quotes=True).alias("name")
    )


@query(
    "T7_multi_marker_split",
    f"""
    WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\. |, |\\n'),
               lambda p: {S.strip("p")}), lambda p: p <> '') AS parts FROM documents)
    SELECT doc_id, CAST(len(parts) AS INT) AS n_parts, md5(array_to_string(parts, '|')) AS parts_hash FROM t
    """,
)
def t7(spark, sf):
    parts = X.split_markers(F.col("text"), r"\. |, |\n")
    return read(spark, sf, "documents").select(
        "doc_id", F.size(parts).alias("n_parts"), F.md5(F.concat_ws("|", parts)).alias("parts_hash")
    )


_DAMAGED = ("<|#|>", "<|##|>", "<||>", "<|#>", "<#|>", "<X#|>", "<|#| ", "||#||")
_DAMAGE_CASE = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DAMAGED)) + " ELSE '<|#|>' END"
_DAMAGED_RECORD = (
    f"'entity' || {_DAMAGE_CASE} || 'Part ' || CAST(l_partkey AS STRING) || {_DAMAGE_CASE} || 'item' || "
    f"{_DAMAGE_CASE} || 'supplied by ' || CAST(l_suppkey AS STRING)"
)


@query(
    "T8_repair_delimiters",
    f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, {_DAMAGED_RECORD} AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber,
      replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r,
        '<\\|#\\|*?#\\|>', '<|#|>', 'g'), '<\\|+>', '<|#|>', 'g'), '<\\|?#\\|?>', '<|#|>', 'g'),
        '<[^|]#\\|>', '<|#|>', 'g'), '<\\|#\\| ', '<|#|> ', 'g'), '||#||', '<|#|>') AS record FROM r
    """,
)
def t8(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.repair_delimiters(F.expr(_DAMAGED_RECORD)).alias("record")
    )


_PRIVATE = (
    "text || ' tel 13' || lpad(CAST(doc_id AS STRING), 9, '5') || ' id ' || lpad(CAST(doc_id AS STRING), 17, '2') || 'X'"
)


@query(
    "T9_redact",
    f"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_PRIVATE}, '{P.EMAIL}', '[邮箱]', 'g'),
           '{P.PHONE}', '[手机号]', 'g'), '{P.ID_NUMBER}', '[证件号]', 'g')) AS redacted_hash FROM documents
    """,
)
def t9(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", F.md5(X.redact(F.expr(_PRIVATE))).alias("redacted_hash")
    )


_THOUGHT = (
    "CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think> ' || role WHEN 1 THEN text || '</think>' || role ELSE text END"
)


@query(
    "T10_drop_think",
    f"""
    SELECT conv_id, turn, md5({S.strip(f"regexp_replace({_THOUGHT}, '^(?:<think>.*?</think>|.*</think>)', '', 's')")}) AS h
    FROM conversations
    """,
)
def t10(spark, sf):
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(X.drop_think(F.expr(_THOUGHT))).alias("h")
    )


_REPLY = (
    "CASE event_id % 3 WHEN 0 THEN '<think>x</think> Sure: ' || props || ' done' WHEN 1 THEN props ELSE 'no json ' || event_type END"
)


@query(
    "T11_embedded_json",
    f"""
    SELECT event_id, coalesce(TRY_CAST(json_extract_string(
             nullif(regexp_extract({_REPLY}, '\\{{.*\\}}'), ''), '$.k') AS INT), -1) AS k FROM events
    """,
)
def t11(spark, sf):
    parsed = X.embedded_json(F.expr(_REPLY), "k INT")
    return read(spark, sf, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


_ASKED = (
    "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' 和 ' || role || ' 的区别'"
    " WHEN 2 THEN '这个 怎么办 ' || text ELSE 'INV-' || CAST(conv_id AS STRING) || ' ' || text END"
)


def _route_sql(x):
    t = S.squash(x)
    named = f"({S.contains_any(t, X.NAME_WORDS)} AND regexp_matches({t}, '{P.CJK}{{2,4}}'))"
    return (
        f"CASE WHEN regexp_matches({t}, '{P.EXACT_QUERY}') OR {named} THEN 'exact'"
        f" WHEN {S.contains_any(t, X.COMPARE_WORDS)} THEN 'subquestions'"
        f" WHEN {S.contains_any(t, X.VAGUE_WORDS)} AND NOT {S.contains_any(t, X.CONCEPT_WORDS)} THEN 'rewrite'"
        " ELSE 'factual' END"
    )


@query(
    "T12_query_route",
    f"""
    WITH q AS (SELECT conv_id, turn, {_ASKED} AS q FROM conversations),
    r AS (SELECT *, {_route_sql("q")} AS route FROM q)
    SELECT conv_id, turn, route, route = 'subquestions' OR {S.contains_any("q", X.GRAPH_WORDS)} AS needs_graph,
           {S.contains_any("q", X.CONCEPT_WORDS)} AS is_concept FROM r
    """,
)
def t12(spark, sf):
    q = F.col("q")
    asked = read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_ASKED).alias("q"))
    return asked.select(
        "conv_id", "turn", X.query_route(q).alias("route"), X.needs_graph(q).alias("needs_graph"),
        X.contains_any(q, X.CONCEPT_WORDS).alias("is_concept"),
    )


@query(
    "T13_subquestions",
    f"""
    WITH q AS (SELECT conv_id, turn, {_ASKED} AS q FROM conversations),
    p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(q, '[和与及、]|以及|相比|比较'), lambda p: {S.strip("p")}),
          lambda p: p <> '') AS parts FROM q),
    c AS (SELECT conv_id, turn, list_transform(CASE WHEN len(parts) >= 2 THEN parts ELSE [q || ' 的直接事实', q || ' 的关系或影响'] END,
          lambda p: {S.squash("p")}) AS parts FROM p)
    SELECT conv_id, turn, md5(array_to_string(list_filter(parts, lambda p, i: list_position(parts, p) = i)[1:4], '|')) AS h FROM c
    """,
)
def t13(spark, sf):
    asked = read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_ASKED).alias("q"))
    return asked.select("conv_id", "turn", F.md5(F.concat_ws("|", X.subquestions(F.col("q")))).alias("h"))


@query(
    "T15_numerals_changed",
    """
    SELECT event_id, list_sort(list_distinct(regexp_extract_all(props, '[0-9]+(?:\\.[0-9]+)?'))) <>
      list_sort(list_distinct(regexp_extract_all(props || ' ' || CAST(event_id % 5 AS VARCHAR), '[0-9]+(?:\\.[0-9]+)?'))) AS changed
    FROM events
    """,
)
def t15(spark, sf):
    other = F.concat("props", F.lit(" "), (F.col("event_id") % 5).cast("string"))
    return read(spark, sf, "events").select(
        "event_id", X.numerals_changed(F.col("props"), other).alias("changed")
    )


_LABELS = "p_type || '；' || p_brand || ', ' || p_type || '<SEP>' || p_name"


@query(
    "T16_relation_labels",
    f"""
    WITH l AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(replace({_LABELS}, '<SEP>', '；'), '[；;，,]'),
      lambda p: {S.squash("p")}), lambda p: p <> '') AS l FROM part)
    SELECT p_partkey, array_to_string(list_filter(l, lambda p, i: list_position(l, p) = i), '|') AS labels FROM l
    """,
)
def t16(spark, sf):
    return read(spark, sf, "part").select(
        "p_partkey", F.concat_ws("|", X.relation_labels(F.expr(_LABELS))).alias("labels")
    )


_VALUES = "p_brand || '<SEP> ' || p_type || '<SEP><SEP>' || p_brand || '<SEP>' || p_name"


@query(
    "T17_split_values",
    f"""
    WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split({_VALUES}, '<SEP>'), lambda p: {S.strip("p")}),
      lambda p: p <> '') AS l FROM part)
    SELECT p_partkey, array_to_string(list_filter(l, lambda p, i: list_position(l, p) = i), '|') AS vals FROM l
    """,
)
def t17(spark, sf):
    return read(spark, sf, "part").select(
        "p_partkey", F.concat_ws("|", X.split_values(F.expr(_VALUES))).alias("vals")
    )


@query(
    "T18_clip",
    f"""
    WITH t AS (SELECT doc_id, {S.squash("text")} AS t FROM documents)
    SELECT doc_id, CASE WHEN len(t) <= 500 THEN t ELSE substr(t, 1, 500) || '…' END AS clipped FROM t
    """,
)
def t18(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.clip(F.col("text")).alias("clipped"))


@query(
    "C1_html_text",
    """
    SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'g'),
           '(?s)<[^>]+>', chr(10), 'g')) AS text_hash FROM pages
    """,
)
def c1(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("text_hash"))


@query(
    "C18_token_count",
    f"""SELECT doc_id, CAST({S.token_count("text")} AS INT) AS n_tokens FROM documents""",
)
def c18(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query(
    "ID_rules",
    f"""
    SELECT doc_id, 'doc-' || md5(text) AS doc_key, CAST(doc_id AS VARCHAR) || '-c' || lpad(CAST(n_chars % 97 + 1 AS VARCHAR), 4, '0') AS chunk_key,
      'ent-' || substr(sha256(concat_ws(chr(10), lang, lower({S.squash("source")}), lower({S.squash("text")}), '')), 1, 24) AS entity_key,
      'rel-' || substr(sha256(concat_ws(chr(10), lang, source, lower({S.squash("text")}), lang)), 1, 24) AS relation_key,
      substr(sha256(text), 1, 16) AS version_key,
      'schunk-' || substr(sha256(concat_ws(chr(10), CAST(doc_id AS VARCHAR), 'content', {S.squash("text")})), 1, 24) AS stable_key,
      md5(concat(lang, source, CAST(doc_id AS VARCHAR))) AS request_key
    FROM documents
    """,
)
def id_rules(spark, sf):
    d, c = read(spark, sf, "documents"), F.col
    return d.select(
        "doc_id",
        ids.content_id("doc-", c("text")).alias("doc_key"),
        ids.scoped_chunk_id(c("doc_id"), (c("n_chars") % 97 + 1).cast("int")).alias("chunk_key"),
        ids.scoped_entity_id(c("lang"), c("source"), c("text")).alias("entity_key"),
        ids.scoped_relation_id(c("lang"), c("source"), c("text"), c("lang")).alias("relation_key"),
        ids.version_id(c("text")).alias("version_key"),
        ids.stable_chunk_id(c("doc_id"), F.lit("index:1"), c("text")).alias("stable_key"),
        ids.request_hash(c("lang"), c("source"), c("doc_id")).alias("request_key"),
    )
