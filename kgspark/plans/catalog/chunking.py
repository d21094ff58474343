"""Parsing and chunking over the whole documents and pages."""

from pyspark.sql import functions as F

from kgspark.functions.patterns import SQL as P
from kgspark.functions import text as X
from kgspark.operators import chunking as C
from kgspark.plans import domain as D
from kgspark.plans import sqlparts as S
from kgspark.plans.registry import query, read

_PARAGRAPHS = "replace(text, '. ', '.' || chr(10) || chr(10))"


def _paragraphs(spark, sf):
    return D.docs(spark, sf).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))


def _markdown(spark, sf):
    """Documents with headings: lines that begin with certain letters become headings."""
    t = F.col("text")
    for letters, mark in (("[AE]", "#"), ("[TO]", "##"), ("[IL]", "###")):
        t = F.regexp_replace(t, f"(?m)^({letters})", f"{mark} $1")
    return _paragraphs(spark, sf).withColumn("text", t)


def _tables(spark, sf):
    """Documents with every 'the …' sentence part as a small table."""
    t = F.regexp_replace("text", r"\. ([A-Z][^.\n]*)\.", ". <table><tr><td>k</td><td>v</td></tr><tr><td>$1</td><td>x</td></tr></table> ")
    return D.docs(spark, sf).withColumn("text", t)


def _hashed(df, *names):
    return df.select("doc_id", *names, F.md5("content").alias("content_hash"))


_LINES = rf"""
 ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM
   (SELECT doc_id, regexp_split_to_array({_PARAGRAPHS}, '\r\n|[\n\x0b\x0c\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents)),
 isl AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{P.NOT_WS}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS g FROM ln),
 un AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(no)) AS u, min(no) AS line_start, max(no) AS line_end,
   {S.strip("string_agg(line, chr(10) ORDER BY no)")} AS content FROM isl WHERE regexp_matches(line, '{P.NOT_WS}') GROUP BY doc_id, g)"""


@query(
    "C2_text_units",
    f"""WITH {_LINES} SELECT doc_id, 't' || lpad(CAST(u AS VARCHAR), CAST(greatest(4, len(CAST(u AS VARCHAR))) AS INT), '0') AS unit_id, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end,
    md5(content) AS content_hash FROM un""",
)
def c2(spark, sf):
    return _hashed(C.text_units(_paragraphs(spark, sf)), "unit_id", "line_start", "line_end")


_MD_SQL = _PARAGRAPHS
for _letters, _mark in (("[AE]", "#"), ("[TO]", "##"), ("[IL]", "###")):
    _MD_SQL = f"regexp_replace({_MD_SQL}, '(?m)^({_letters})', '{_mark} \\1', 'g')"

_HEADED = rf"""
 ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM
   (SELECT doc_id, regexp_split_to_array({_MD_SQL}, '\r\n|[\n\x0b\x0c\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents)),
 hd AS (SELECT *, len(regexp_extract(line, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$', 1)) AS lv, {S.strip("regexp_extract(line, '^(#{1,6})[ \t]+(.+?)[ \t]*$', 2)")} AS title FROM ln),
 st AS (SELECT *, {", ".join(f"max(CASE WHEN lv = {k} THEN no END) OVER w AS n{k}, arg_max(title, no) FILTER (lv = {k}) OVER w AS t{k}" for k in (1, 2, 3))},
   sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER w AS section,
   sum(CASE WHEN lv > 0 OR NOT regexp_matches(line, '{P.NOT_WS}') THEN 1 ELSE 0 END) OVER w AS b
   FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
 pt AS (SELECT *, concat_ws(' / ', t1, CASE WHEN n2 > coalesce(n1, 0) THEN t2 END, CASE WHEN n3 > coalesce(n1, 0) AND n3 > coalesce(n2, 0) THEN t3 END) AS path,
   concat_ws(chr(10), '# ' || t1, CASE WHEN n2 > coalesce(n1, 0) THEN '## ' || t2 END, CASE WHEN n3 > coalesce(n1, 0) AND n3 > coalesce(n2, 0) THEN '### ' || t3 END) AS prefix,
   coalesce(t1, t2, t3, '') AS top FROM st)"""


@query(
    "C3_markdown_units",
    f"""WITH {_HEADED}, bl AS (SELECT doc_id, b, lv > 0 AS head, min(no) AS line_start, max(no) AS line_end, arg_min(path, no) AS path, max(title) AS title,
      {S.strip("string_agg(line, chr(10) ORDER BY no)")} AS body FROM pt WHERE regexp_matches(line, '{P.NOT_WS}') GROUP BY ALL),
    nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS VARCHAR) AS u FROM bl)
    SELECT doc_id, CASE WHEN head THEN 's' ELSE 't' END || lpad(u, CAST(greatest(4, len(u)) AS INT), '0') AS unit_id, path, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end,
      md5(CASE WHEN head THEN title ELSE body END) AS content_hash FROM nu""",
)
def c3(spark, sf):
    u = C.markdown_units(_markdown(spark, sf)).withColumn("path", F.array_join("section_path", " / "))
    return _hashed(u, "unit_id", "path", "line_start", "line_end")


_SECTIONS = f"""{_HEADED}, se AS (SELECT doc_id, section, arg_min(path, no) AS path, arg_min(prefix, no) AS prefix, max(CASE WHEN lv > 0 THEN {S.strip("line")} END) AS head,
      coalesce(string_agg(CASE WHEN lv = 0 THEN line END, chr(10) ORDER BY no), '') AS body FROM pt GROUP BY ALL),
    tx AS (SELECT doc_id, section, path, prefix, {S.strip("CASE WHEN head IS NULL THEN body WHEN regexp_matches(body, '" + P.NOT_WS + "') THEN head || chr(10) || chr(10) || regexp_replace(body, '^(" + P.WS + "*\\n)+', '') ELSE head END")} AS t FROM se),
    sx AS (SELECT * FROM tx WHERE t <> '' OR section > 0)"""


@query("C4_markdown_sections", f"WITH {_SECTIONS} SELECT doc_id, CAST(section AS BIGINT) AS section, path, md5(t) AS content_hash FROM sx")
def c4(spark, sf):
    s = C.markdown_sections(_markdown(spark, sf))
    return s.select("doc_id", "section", F.array_join("path.title", " / ").alias("path"), F.md5("text").alias("content_hash"))


_HEADED_PIECE = "CASE WHEN prefix = '' OR {0} = '' OR starts_with({0}, prefix) THEN {0} ELSE prefix || chr(10) || chr(10) || {0} END"


@query(
    "C5_hierarchical_chunks",
    f"""WITH {_SECTIONS},
    cx AS (SELECT doc_id, section, prefix, {_HEADED_PIECE.format("t")} AS parent, {S.visible("list_transform(" + S.guarded_split("t", C.SEPARATORS, 400, 50) + ", lambda y: " + S.strip("y") + ")")} AS l FROM sx),
    ux AS (SELECT doc_id, section, prefix, parent, l[1] AS first, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM cx),
    hx AS (SELECT doc_id, section, i, CASE WHEN parent <> '' THEN parent ELSE {_HEADED_PIECE.format("first")} END AS parent, {_HEADED_PIECE.format("piece")} AS content FROM ux)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, i) - 1 AS INT) AS chunk_order_index, CAST(len(regexp_extract_all(content, '{P.SPACED_WORD}')) AS INT) AS tokens,
      'parent-' || md5(parent) AS parent_id, md5(content) AS content_hash FROM hx""",
)
def c5(spark, sf):
    rows = C.hierarchical_chunks(_markdown(spark, sf), 400, 50)
    return _hashed(rows, "chunk_order_index", "tokens", "parent_id")


def _pieces_sql(pieces: str, source: str = "documents") -> str:
    return f"""SELECT doc_id, CAST(i - 1 AS INT) AS pos, md5(c) AS content_hash FROM
      (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {pieces} AS l FROM {source}))"""


@query("C6_pack_segments", _pieces_sql(S.pack("string_split(text, chr(10))", "chr(10)", 600)))
def c6(spark, sf):
    packed = C.pack(F.split("text", "\n", -1), "\n", 600)
    return D.docs(spark, sf).select("doc_id", F.posexplode(packed).alias("pos", "content")).transform(_hashed, "pos")


@query("C7_smart_split", _pieces_sql(S.smart_split("text", C.SEPARATORS, 300, 40), f"(SELECT doc_id, {_PARAGRAPHS} AS text FROM documents)"))
def c7(spark, sf):
    pieces = C.smart_split(F.col("text"), 300, 40)
    return _paragraphs(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


_TABLES_SQL = r"""(SELECT doc_id, regexp_replace(text, '\. ([A-Z][^.\n]*)\.',
  '. <table><tr><td>k</td><td>v</td></tr><tr><td>\1</td><td>x</td></tr></table> ', 'g') AS text FROM documents)"""


@query("C8_table_guarded_split", _pieces_sql(S.guarded_split("text", C.SEPARATORS, 300, 40), _TABLES_SQL))
def c8(spark, sf):
    pieces = C.table_guarded_split(F.col("text"), 300, 40)
    return _tables(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


def _windows_sql(count: str, text: str) -> str:
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all({text}, '{P.SPACED_WORD}') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, greatest({count}, 0))) AS i FROM t),
    p AS (SELECT doc_id, i, {S.strip("array_to_string(w[CAST(i * 100 + 1 AS INT):CAST(i * 100 + 120 AS INT)], '')")} AS content FROM s)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, md5(content) AS content_hash FROM p WHERE content <> ''"""


@query("C9_fixed_windows", _windows_sql("CAST(1 + ceil(greatest(len(w) - 120, 0) / 100.0) AS BIGINT)", S.strip("text")))
def c9(spark, sf):
    pieces = C.fixed_windows(F.col("text"), 120, 20)
    return D.docs(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


@query("C10_legacy_windows", _windows_sql("CAST(ceil(len(w) / 100.0) AS BIGINT)", "text"))
def c10(spark, sf):
    pieces = C.legacy_windows(F.col("text"), 120, 20)
    return D.docs(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


@query(
    "C11_delimiter_pieces",
    f"""WITH p AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM
      (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS l FROM documents))
    SELECT doc_id, CAST(i - 1 AS INT) AS pos, md5(c) AS content_hash FROM p""",
)
def c11(spark, sf):
    pieces = C.delimiter_pieces(F.col("text"), "\n", 0, 0)
    return D.docs(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


@query(
    "C12_ledger_rows",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS INT) AS pos,
      md5('表：lines' || chr(10) || 'order：' || l_orderkey || '；part：' || l_partkey || '；flag：' || l_returnflag) AS content_hash
    FROM (SELECT l_suppkey AS doc_id, * FROM lineitem)""",
)
def c12(spark, sf):
    """One CSV sheet per supplier and month, so that no text grows with a hot supplier."""
    li = read(spark, sf, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    line = F.concat_ws(",", "l_orderkey", "l_partkey", F.concat(F.lit('"'), "l_returnflag", F.lit('"')))
    row = F.struct("l_shipdate", "l_orderkey", "l_linenumber", line.alias("line"))
    sheets = li.groupBy("l_suppkey", "month").agg(F.array_sort(F.collect_list(row)).alias("r"))
    text = F.concat(F.lit("Sheet: lines\norder,part,flag\n"), F.array_join(F.col("r.line"), "\n"))
    named = sheets.select(F.struct("l_suppkey", "month").alias("doc"), text.alias("text"))
    rows = C.ledger_pieces(named, "doc")
    from kgspark.operators.scale import rank_in_groups

    flat = rows.select(F.col("doc.l_suppkey").alias("doc_id"), F.col("doc.month").alias("month"), "pos", "content")
    ranked = rank_in_groups(flat, ["doc_id"], [F.col("month"), F.col("pos")], F.col("month"), "rn")
    return ranked.select("doc_id", (F.col("rn") - 1).cast("int").alias("pos"), F.md5("content").alias("content_hash"))


@query(
    "C13_qa_pairs",
    f"""WITH r AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, {S.squash("text")} AS q, {S.strip("nt")} AS a FROM r WHERE role = 'user' AND nr = 'assistant')
    SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, md5('问题：' || q || chr(10) || '答案：' || a) AS content_hash FROM p WHERE q <> '' AND a <> ''""",
)
def c13(spark, sf):
    """One text per round, so that no conversation is gathered whole."""
    from kgspark.operators.conversation import rounds
    from kgspark.operators.scale import rank_in_groups

    label = F.when(F.col("role") == "user", "问题：").otherwise("答案：")
    line = F.struct("turn", F.concat(label, "text").alias("t"))
    numbered = rounds(read(spark, sf, "conversations"))
    texts = numbered.groupBy("conv_id", "round").agg(F.array_join(F.array_sort(F.collect_list(line))["t"], "\n").alias("text"))
    pieces = texts.select(F.col("conv_id").alias("doc_id"), "round", F.explode(C.qa_pieces(F.col("text"))).alias("content"))
    ranked = rank_in_groups(pieces, ["doc_id"], [F.col("round")], F.floor(F.col("round") / 1000), "rn")
    return _hashed(ranked.withColumn("pos", (F.col("rn") - 1).cast("int")), "pos")


@query("C14_clause_pieces")
def c14(spark, sf):
    """Laws made of the documents: every line an article, chapters before some of them."""
    t = F.regexp_replace("text", r"(?m)^([A-Z])", "第1条 $1")
    t = F.regexp_replace(t, r"(?m)^第1条 ([AT])", "第2章 $1\n第3条 $1")
    return C.clause_pieces(D.docs(spark, sf).withColumn("text", t)).transform(_hashed, "pos")


_KINDS = (
    "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '# head' || chr(10) || text WHEN 2 THEN '第1条 ' || text || ' 第二条 x' "
    "WHEN 3 THEN '问：' || lang || chr(10) || '答：' || source || chr(10) || 'Q: x' || chr(10) || 'A: y' ELSE text END"
)
_SUFFIX = "CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.docx' ELSE '.txt' END"


@query(
    "C15_strategy",
    f"""WITH k AS (SELECT doc_id, doc_id % 5 = 3 AS qa, {_KINDS} AS t, {_SUFFIX} AS s FROM documents)
    SELECT doc_id, CASE WHEN s = '.csv' THEN 'ledger' WHEN len(regexp_extract_all(t, '{P.ARTICLE}')) >= 2 THEN 'clause' WHEN qa THEN 'qa'
      WHEN len(regexp_extract_all(t, '{P.SPACED_WORD}')) <= 100 THEN 'one' WHEN s = '.docx' OR regexp_matches(t, '{P.HEADING}') THEN 'hierarchical'
      WHEN s = '.pdf' THEN 'pdf_table' ELSE 'recursive' END AS strategy FROM k""",
)
def c15(spark, sf):
    return D.docs(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id", C.strategy(F.expr(_KINDS), F.expr(_SUFFIX), 100).alias("strategy")
    )


@query("C16_sticky_tables", _pieces_sql(S.sticky_tables("text", 120), _TABLES_SQL))
def c16(spark, sf):
    pieces = C.sticky_tables(F.col("text"), 120)
    return _tables(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


_CHUNKS = f"""
 ct AS (SELECT doc_id, regexp_extract_all({S.strip("text")}, '{P.SPACED_WORD}') AS w FROM documents),
 cs AS (SELECT doc_id, w, unnest(range(0, CAST(1 + ceil(greatest(len(w) - 120, 0) / 100.0) AS BIGINT))) AS i FROM ct),
 chunk AS (SELECT doc_id, i AS pos, content FROM (SELECT doc_id, i, {S.strip("array_to_string(w[CAST(i * 100 + 1 AS INT):CAST(i * 100 + 120 AS INT)], '')")} AS content FROM cs) WHERE content <> '')"""


@query(
    "C17_parent_synthesis",
    f"""WITH {_CHUNKS}, p AS (SELECT doc_id, pos // 3 AS g, substr(string_agg(content, chr(10) || chr(10) ORDER BY pos), 1, 4000) AS parent FROM chunk GROUP BY ALL)
    SELECT doc_id, CAST(pos AS INT) AS chunk_order_index, 'chunk-' || md5(content) AS chunk_id, CAST(len(regexp_extract_all(content, '{P.SPACED_WORD}')) AS INT) AS tokens, 'parent-' || md5(parent) AS parent_id
    FROM chunk JOIN p ON p.doc_id = chunk.doc_id AND g = pos // 3""".replace("SELECT doc_id, CAST(pos", "SELECT chunk.doc_id, CAST(pos"),
)
def c17(spark, sf):
    rows = C.chunk_rows(D.docs(spark, sf), C.fixed_windows(F.col("text"), 120, 20))
    return rows.select("doc_id", "chunk_order_index", "chunk_id", "tokens", "parent_id")


_RWIN = f"""
 rt AS (SELECT doc_id, text, regexp_extract_all(text, '{P.PIECE}') AS w FROM documents),
 rs AS (SELECT doc_id, text, w, unnest(range(0, CAST(1 + ceil(greatest(len(w) - 250, 0) / 205.0) AS BIGINT))) AS i FROM rt WHERE len(w) > 0),
 rw AS (SELECT doc_id, text, w, i, array_to_string(w[CAST(i * 205 + 1 AS INT):CAST(i * 205 + 250 AS INT)], '') AS content FROM rs)"""


@query("C19_retrieval_windows", f"WITH {_RWIN} SELECT doc_id, CAST(i AS INT) AS pos, md5(content) AS content_hash FROM rw")
def c19(spark, sf):
    pieces = C.retrieval_windows(F.col("text"))
    return D.docs(spark, sf).select("doc_id", F.posexplode(pieces).alias("pos", "content")).transform(_hashed, "pos")


@query(
    "C20_split_oversized",
    f"""WITH {_RWIN} SELECT doc_id, doc_id || '-r' || lpad(CAST(i + 1 AS VARCHAR), CAST(greatest(2, len(CAST(i + 1 AS VARCHAR))) AS INT), '0') AS chunk_id, md5(content) AS content_hash FROM rw WHERE {S.token_count("text")} > 350 AND len(w) > 250
    UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), md5(text) FROM rt WHERE NOT ({S.token_count("text")} > 350 AND len(w) > 250)""",
)
def c20(spark, sf):
    docs = D.docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return _hashed(C.split_oversized(docs), "chunk_id")


@query(
    "C21_assign_parents",
    f"""WITH RECURSIVE {_HEADED}, bl AS (SELECT doc_id, b, lv > 0 AS head, min(no) AS line_start, arg_min(top, no) AS top,
      {S.strip("string_agg(line, chr(10) ORDER BY no)")} AS body FROM pt WHERE regexp_matches(line, '{P.NOT_WS}') GROUP BY ALL),
    nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS pos FROM bl),
    u AS (SELECT doc_id, pos, top, {S.token_count("body")} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM nu WHERE NOT head),
    g AS (SELECT doc_id, pos, top, r, n AS total, 1 AS no FROM u WHERE r = 1 UNION ALL
      SELECT doc_id, pos, top, r, CASE WHEN fresh THEN n ELSE before + n END, CASE WHEN fresh THEN no + 1 ELSE no END FROM
      (SELECT u.*, g.total AS before, g.no, g.total >= 1500 OR u.top <> g.top OR (g.total + u.n > 1500 AND g.total >= 800) AS fresh
       FROM g JOIN u ON u.doc_id = g.doc_id AND u.r = g.r + 1))
    SELECT doc_id, CAST(pos AS INT) AS pos, doc_id || '-p' || lpad(CAST(no AS VARCHAR), CAST(greatest(4, len(CAST(no AS VARCHAR))) AS INT), '0') AS parent_id FROM g""",
)
def c21(spark, sf):
    units = C.markdown_units(_markdown(spark, sf)).filter("unit_type = 'text'")
    pos = F.substring("unit_id", 2, 9).cast("int")
    rows = units.select("doc_id", pos.alias("pos"), F.element_at(F.concat("section_path", F.array(F.lit(""))), 1).alias("section_key"), "content")
    return C.assign_parents(rows).select("doc_id", "pos", "parent_id")


@query(
    "C22_index_text",
    f"""SELECT doc_id, md5(array_to_string(list_filter([source, CASE WHEN doc_id % 3 = 0 THEN lang || ' / ' || source ELSE '' END, {S.strip("text")}], lambda x: x <> ''), chr(10))) AS h FROM documents""",
)
def c22(spark, sf):
    d = read(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array(F.lit(" ")))
    return d.select("doc_id", F.md5(C.index_text(F.col("source"), path, F.col("text"))).alias("h"))


@query(
    "C23_bind_evidence",
    f"""WITH {_LINES.replace("documents", "pdocs", 0)}, pd AS (SELECT doc_id, {_PARAGRAPHS} AS text FROM documents),
    ct AS (SELECT doc_id, regexp_extract_all({S.strip("text")}, '{P.SPACED_WORD}') AS w FROM pd),
    cs AS (SELECT doc_id, w, unnest(range(0, CAST(1 + ceil(greatest(len(w) - 120, 0) / 100.0) AS BIGINT))) AS i FROM ct),
    pc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, content FROM (SELECT doc_id, i, {S.strip("array_to_string(w[CAST(i * 100 + 1 AS INT):CAST(i * 100 + 120 AS INT)], '')")} AS content FROM cs) WHERE content <> ''),
    hit AS (SELECT pc.doc_id, pos, pc.content, u FROM pc JOIN un ON un.doc_id = pc.doc_id AND len(un.content) >= 2 AND (contains(pc.content, un.content) OR contains(un.content, pc.content))),
    al AS (SELECT * FROM hit UNION ALL SELECT pc.doc_id, pos, pc.content, 1 FROM pc WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = pc.doc_id AND hit.pos = pc.pos)),
    nm AS (SELECT doc_id, doc_id || '-c' || lpad(CAST(pos AS VARCHAR), CAST(greatest(4, len(CAST(pos AS VARCHAR))) AS INT), '0') AS chunk_id, 't' || lpad(CAST(u AS VARCHAR), CAST(greatest(4, len(CAST(u AS VARCHAR))) AS INT), '0') AS unit_id, content FROM al)
    SELECT doc_id, chunk_id, unit_id, 'ev-' || substr(sha256(concat_ws(chr(10), doc_id, 'v1', chunk_id, unit_id)), 1, 16) AS evidence_id, md5(substr(content, 1, 240)) AS excerpt_hash FROM nm""",
)
def c23(spark, sf):
    docs = _paragraphs(spark, sf)
    units = C.text_units(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "content"))).alias("units"))
    bound = C.bind_evidence(
        docs.join(units, "doc_id"), C.fixed_windows(F.col("text"), 120, 20), F.col("units"), F.col("doc_id"), F.lit("v1")
    )
    return bound.select("doc_id", "chunk_id", "unit_id", "evidence_id", F.md5("excerpt").alias("excerpt_hash"))


@query(
    "C25_plain_text",
    f"""WITH {_LINES}, k AS (SELECT *, u % 3 = 1 AND EXISTS (SELECT 1 FROM un b WHERE b.doc_id = un.doc_id AND b.u = un.u + 1) AS inner_unit FROM un)
    SELECT doc_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY u)) AS text_hash FROM k WHERE NOT inner_unit GROUP BY doc_id""",
)
def c25(spark, sf):
    """Every third paragraph is the parent of the two after it."""
    u = F.substring("unit_id", 2, 9).cast("int")
    parent = F.when(u % 3 != 1, F.concat(F.lit("t"), F.format_string("%04d", u - F.when(u % 3 == 2, 1).otherwise(2))))
    units = C.text_units(_paragraphs(spark, sf)).withColumn("parent_unit_id", parent).withColumn("no", u)
    return C.plain_text(units, order="no").select("doc_id", F.md5("text").alias("text_hash"))
