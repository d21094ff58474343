"""Fragments shared by the SQL twins. Patterns come from the same constants as the Spark side."""

from kgspark.functions.patterns import SQL as P


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{P.EDGE_WS}', '', 'g')"


def squash(x: str) -> str:
    return strip(f"regexp_replace({x}, '{P.WS}+', ' ', 'g')")


def tokens(x: str) -> str:
    han = "regexp_replace(r, '[^\\x{4e00}-\\x{9fff}]', '', 'g')"
    grams = f"list_transform(range(1, greatest(len({han}), 2)), lambda i: substr({han}, i, 2))"
    return (
        f"flatten(list_transform(regexp_extract_all(lower({x}), '{P.TOKEN_RUN}'), "
        f"lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9_]') THEN [r] ELSE {grams} END))"
    )


def token_count(x: str) -> str:
    n = f"len(regexp_extract_all({x}, '{P.CJK}|{P.LATIN_WORD}'))"
    return f"(CASE WHEN {n} > 0 THEN {n} WHEN regexp_matches({x}, '{P.NOT_WS}') THEN 1 ELSE 0 END)"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_MARK, _CUT = "chr(57345)", "chr(57344)"  # private-use marks between segments and at cuts
_LAST = f"string_split(a, {_MARK})[-1]"


def _segments(parts: str, fits: str, sep: str) -> str:
    """Fold of a list into one string of marked segments; ``p`` joins the last one where ``fits``."""
    step = f"CASE WHEN {_LAST} = '' THEN a || p WHEN {fits} THEN a || {sep} || p ELSE a || {_MARK} || p END"
    return f"list_filter(string_split(list_reduce({parts}, lambda a, p: {step}, ''), {_MARK}), lambda f: f <> '')"


def pack(parts: str, sep: str, limit: int) -> str:
    return _segments(parts, f"len({_LAST}) + len({sep}) + len(p) <= {limit}", sep)


def visible(pieces: str) -> str:
    return f"list_filter({pieces}, lambda v: regexp_matches(v, '{P.NOT_WS}'))"


def smart_split(x: str, separators: tuple[str, ...], limit: int, overlap: int) -> str:
    pieces = f"[{x}]"
    for k, sep in enumerate(separators):
        quoted = "'" + sep.replace("\n", "' || chr(10) || '") + "'"
        finer = pack(f"string_split(s{k}, {quoted})", f"({quoted})", limit)
        pieces = f"flatten(list_transform({pieces}, lambda s{k}: CASE WHEN len(s{k}) <= {limit} THEN [s{k}] ELSE {finer} END))"
    step = limit - overlap
    windows = f"list_transform(range(0, CAST(ceil((len(h) - {limit}) / {step}.0) AS BIGINT) + 1), lambda i: substr(h, i * {step} + 1, {limit}))"
    return visible(f"flatten(list_transform({pieces}, lambda h: CASE WHEN len(h) <= {limit} THEN [h] ELSE {windows} END))")


def guarded_split(x: str, separators: tuple[str, ...], limit: int, overlap: int) -> str:
    marked = f"regexp_replace({x}, '(?s)(<table>.*?</table>)', {_CUT} || '\\1' || {_CUT}, 'g')"
    parts = visible(f"string_split({marked}, {_CUT})")
    whole = "starts_with(t, '<table>') AND ends_with(t, '</table>')"
    return f"flatten(list_transform({parts}, lambda t: CASE WHEN {whole} THEN [t] ELSE {smart_split('t', separators, limit, overlap)} END))"


def sticky_tables(x: str, limit: int) -> str:
    marked = f"regexp_replace({x}, '(?s)(<table>.*?</table>)', '\\1' || {_CUT}, 'g')"
    parts = visible(f"list_transform(string_split({marked}, {_CUT}), lambda t: {strip('t')})")
    words = lambda y: f"len(regexp_extract_all({y}, '{P.SPACED_WORD}'))"
    return _segments(parts, f"{words(_LAST)} + {words('p')} <= {limit}", "chr(10) || chr(10)")


BM25 = f"""
 dtok AS (SELECT doc_id, {tokens("text")} AS toks FROM documents),
 dlen AS (SELECT doc_id, len(toks) AS dl FROM dtok),
 corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dlen),
 qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
 post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dtok)
          WHERE term IN (SELECT term FROM qterm) GROUP BY ALL),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
 bm25 AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
            / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
          FROM post JOIN qterm USING (term) JOIN dfs USING (term) JOIN dlen USING (doc_id) CROSS JOIN corpus GROUP BY ALL)"""

KEYWORD = (
    BM25
    + """,
 keyword AS (SELECT query_id, doc_id, score AS raw_score, score / (score + 4.0::DOUBLE) AS score, rank FROM
   (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25) WHERE rank <= 30)"""
)


def sparse(name: str, source: str, id_col: str, text: str = "text") -> str:
    return f"""
 {name}_n AS (SELECT id, slot, count(*)::DOUBLE AS n FROM (SELECT id, ('0x' || right(sha256(t), 4))::INT % 16384 AS slot
   FROM (SELECT {id_col} AS id, unnest({tokens(text)}) AS t FROM {source})) GROUP BY ALL),
 {name} AS (SELECT id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_n)"""


DENSE = (
    sparse("dvec", "documents", "doc_id")
    + ","
    + sparse("qvec", "benchmark", "item_id")
    + """,
 cosines AS (SELECT qvec.id AS query_id, dvec.id AS doc_id, sum(dvec.w * qvec.w) AS score FROM dvec JOIN qvec USING (slot) GROUP BY ALL),
 dense AS (SELECT query_id, doc_id, score, rank FROM
   (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cosines WHERE score >= 0.15)
   WHERE rank <= 40)"""
)

FUSED = (
    KEYWORD
    + ","
    + DENSE
    + """,
 chan AS (SELECT query_id, doc_id, rank, 'bm25' AS channel, CAST(NULL AS DOUBLE) AS v, score AS k FROM keyword
          UNION ALL SELECT query_id, doc_id, rank, 'dense', score, NULL FROM dense),
 rrf AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, max(v) AS vector_score, max(k) AS keyword_score,
         string_agg(channel, ',' ORDER BY channel) AS channels FROM chan GROUP BY ALL),
 fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM rrf) WHERE rank <= 60)"""
)
