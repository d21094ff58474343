"""SQL twins of the registered queries that SQL can express, over the same tables.

They take the plain way: all windows as strings, all pairs that share a shingle, all spans of a text.
"""

from __future__ import annotations

from kgspark.llm import decontamination, secret_scan, sharding

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS l FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 34], ' ')) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35)),
 rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM rep),
 words AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM w),
 marked AS (SELECT doc_id, word, pos, g.pos IS NOT NULL AS out FROM words LEFT JOIN gone g USING (doc_id, pos)),
 edges AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
 done AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, count(*) FILTER (opens) AS n_intervals,
   string_agg(word, ' ' ORDER BY pos) FILTER (NOT out) AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  CAST(coalesce(n_intervals, 0) AS INTEGER) AS n_intervals FROM documents LEFT JOIN done USING (doc_id)
"""

DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS l FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
   ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END AS s FROM w),
 sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (na + nb - c)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, y FROM reach r JOIN links ON r.b = x),
 comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
"""


def _items() -> str:
    size, threshold = decontamination.SIZE, decontamination.THRESHOLD
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    runs = f"unnest(list_transform(range(1, len(l) - {size - 2}), lambda i: array_to_string(l[i:i + {size - 1}], ' '))) AS run, unnest(range(0, len(l) - {size - 1})) AS p"
    return f"""
WITH d AS (SELECT doc_id, len(l) AS n, {runs} FROM (SELECT doc_id, {words} AS l FROM documents) WHERE len(l) >= {size}),
 i AS (SELECT item_id, len(l) AS k, {runs} FROM (SELECT item_id, {words} AS l FROM benchmark) WHERE len(l) >= {size}),
 win AS (SELECT DISTINCT doc_id, k, greatest(0, least(d.p - i.p, n - k)) AS start FROM d JOIN i USING (run)),
 held AS (SELECT doc_id, k, start, run, count(*) AS c FROM win JOIN d USING (doc_id) WHERE p BETWEEN start AND start + k - {size} GROUP BY ALL),
 size AS (SELECT doc_id, k, start, sum(c) AS here FROM held GROUP BY ALL),
 counts AS (SELECT item_id, k, run, count(*) AS m FROM i GROUP BY ALL),
 met AS (SELECT doc_id, item_id, k, start, sum(least(c, m)) AS met FROM held JOIN counts USING (k, run) GROUP BY ALL),
 alike AS (SELECT doc_id, item_id, start, met / (here + k - {size - 1} - met) AS similarity FROM met JOIN size USING (doc_id, k, start))
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(similarity AS DOUBLE) AS similarity FROM alike WHERE similarity >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def _secrets() -> str:
    found, ends = [], []
    for order, (kind, (pattern, group, least, role, weak)) in enumerate(secret_scan.KINDS.items()):
        whole = rf"([\s\S]*?)({pattern}|\z)".replace("'", "''")
        counted = 2 + group if group else 2
        lists = ", ".join(f"unnest(regexp_extract_all(t, '{whole}', {g})) AS {n}" for g, n in ((1, "b"), (2, "m"), (counted, "c")))
        found.append(f"""{kind} AS (SELECT doc_id, b, m, c, row_number() OVER (PARTITION BY doc_id) AS no FROM (SELECT doc_id, {lists} FROM t WHERE regexp_matches(t, '{pattern.replace("'", "''")}'))),
 {kind}_at AS (SELECT doc_id, sum(len(b) + len(m)) OVER (PARTITION BY doc_id ORDER BY no) AS e, len(m) AS size, len(c) AS n FROM {kind})""")
        ends.append(f"SELECT doc_id, '{kind}' AS kind, {order} AS place, '{role}' AS role, {weak} AS weak, e - size AS s, e FROM {kind}_at WHERE size > 0 AND n >= {least}")
    needs = " OR ".join(
        f"(role = '{role}' AND len(list_filter({sorted(need)}, lambda x: NOT list_contains(roles, x))) = 0)" for role, sets in secret_scan.NEEDS.items() for need in sets
    )
    base = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) FILTER (NOT weak), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(found)},
 parts AS ({" UNION ALL ".join(ends)}),
 near AS (SELECT a.doc_id, a.kind, a.place, a.role, a.s, a.e, list(DISTINCT b.role) AS roles FROM parts a JOIN parts b
   ON a.doc_id = b.doc_id AND a.weak AND a.role <> b.role AND greatest(b.s - a.e, a.s - b.e) <= {secret_scan.SCOPE} GROUP BY ALL),
 spans AS (SELECT doc_id, kind, place, s, e, weak FROM parts WHERE NOT weak UNION ALL SELECT doc_id, kind, place, s, e, true FROM near WHERE {needs}),
 sums AS (SELECT doc_id, {counts}, {base} AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN sums USING (doc_id)
"""


def shards(count: int) -> str:
    bits, dims = sharding.BITS, 3
    steps, last = [], "grid"
    for no, step in enumerate(sharding.hilbert_steps(dims, bits)):
        steps.append(f"h{no} AS (SELECT c0, c1, c2, {', '.join(f'{e} AS {n}' for n, e in step)} FROM {last})")
        last = f"h{no}"

    def scale(column: str, name: str) -> str:
        return f"""{name} AS (SELECT {column}, CAST(floor(coalesce(sum(n) OVER (ORDER BY coalesce({column}, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} / sum(n) OVER ()) AS INTEGER) AS {name}
   FROM (SELECT {column}, count(*) AS n FROM documents GROUP BY {column}))"""

    crc = f"""tab AS (SELECT list(list_reduce([CAST(k AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS tab FROM range(256) r(k)),
 hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 raw AS (SELECT doc_id, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM hx),
 crc AS (SELECT doc_id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || b, lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) AS text_crc32 FROM raw, tab)"""
    return f"""
WITH grid AS (SELECT CAST(id & 15 AS INTEGER) AS c0, CAST((id >> 4) & 15 AS INTEGER) AS c1, CAST((id >> 8) & 15 AS INTEGER) AS c2,
   CAST(id & 15 AS INTEGER) AS x0, CAST((id >> 4) & 15 AS INTEGER) AS x1, CAST((id >> 8) & 15 AS INTEGER) AS x2 FROM range({1 << (bits * dims)}) r(id)),
 {", ".join(steps)}, curve AS (SELECT c0, c1, c2, {sharding.curve_index(dims, bits)} AS curve FROM {last}),
 {scale("source", "k0")}, {scale("lang", "k1")}, {crc},
 placed AS (SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, k0.k0 AS a, k1.k1 AS b
   FROM documents d JOIN k0 ON d.source IS NOT DISTINCT FROM k0.source JOIN k1 ON d.lang IS NOT DISTINCT FROM k1.lang),
 ranked AS (SELECT p.doc_id, size, text_crc32, curve, row_number() OVER (ORDER BY curve, p.doc_id, text_crc32) - 1 AS no, count(*) OVER () AS n
   FROM placed p JOIN crc USING (doc_id) JOIN curve ON c0 = a AND c1 = b AND c2 = least(greatest(len(bin(size)) - 4, 0), {(1 << bits) - 1}))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(no * {count} // n AS INTEGER) AS shard,
  no - ((no * {count} // n) * n + {count - 1}) // {count} AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve FROM ranked
"""


ITEMS = _items()
SECRETS = _secrets()


def _digests() -> str:
    from kgspark.llm import digests as d

    quarter = d.BUCKETS // 4
    codes = "list_transform(c, lambda x: (x > q1)::INT + (x > q2)::INT + (x > q3)::INT)"
    packed = f"list_transform(range({quarter}), lambda i: k[4 * i + 1] + 4 * k[4 * i + 2] + 16 * k[4 * i + 3] + 64 * k[4 * i + 4])"

    def hexed(value: str) -> str:
        return f"right('0' || lower(to_hex({value})), 2)"

    def likeness(a: str, b: str) -> str:
        steps = f"list_sum(list_transform(list_zip({a}.k, {b}.k), lambda z: CASE abs(z[1] - z[2]) WHEN 3 THEN 6 ELSE abs(z[1] - z[2]) END))"
        head = f"least({d.LENGTH_STEP} * abs({a}.l - {b}.l), {d.LENGTH_MOST}) + {d.RATIO_STEP} * (abs({a}.r1 - {b}.r1) + abs({a}.r2 - {b}.r2))"
        return f"1 - least({steps} + {head}, {d.MOST}) / {float(d.MOST)}"

    return f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS no, count(*) OVER () AS n FROM documents),
 e AS (SELECT a.doc_id, a.no, b.no AS after, a.t, a.t[:length(a.t) - length(a.t) // 4] || b.t[:length(a.t) // 4] AS new FROM o a JOIN o b ON b.no = a.no % a.n + 1),
 every AS (SELECT no, 0 AS kind, t FROM e UNION ALL SELECT no, 1, new FROM e),
 bytes AS (SELECT no, kind, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM every),
 triples AS (SELECT no, kind, unnest(list_transform(range(1, len(b) - 1), lambda i: (((b[i] + 256 * b[i + 1] + 65536 * b[i + 2]) * {d.MULTIPLIER}) % 4294967296) >> 24)) AS bucket FROM bytes),
 met AS (SELECT no, kind, bucket, count(*) AS c FROM triples GROUP BY ALL),
 counts AS (SELECT f.no, f.kind, list(coalesce(c, 0) ORDER BY f.bucket) AS c
   FROM (SELECT no, kind, bucket FROM every, range({d.BUCKETS}) r(bucket)) f LEFT JOIN met USING (no, kind, bucket) GROUP BY ALL),
 cuts AS (SELECT no, kind, c, list_sort(c) AS s, s[{quarter}] AS q1, s[{2 * quarter}] AS q2, s[{3 * quarter}] AS q3, len(b) AS size FROM counts JOIN bytes USING (no, kind)),
 prints AS (SELECT no, kind, {codes} AS k, least(16 * q1 // greatest(q3, 1), 15) AS r1, least(16 * q2 // greatest(q3, 1), 15) AS r2,
   CASE WHEN size = 0 THEN 0 ELSE 1 + 4 * (length(bin(size)) - 1) + (((size << 2) >> (length(bin(size)) - 1)) & 3) END AS l FROM cuts),
 named AS (SELECT *, {hexed('l')} || {hexed('16 * r1 + r2')} || array_to_string(list_transform({packed}, lambda x: {hexed('x')}), '') AS print FROM prints)
SELECT e.doc_id, length(t) AS n_chars, sha256(new) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
  {likeness('a', 'b')} AS near_edited, {likeness('a', 'x')} AS near_next
FROM e JOIN named a ON a.no = e.no AND a.kind = 0 JOIN named b ON b.no = e.no AND b.kind = 1 JOIN named x ON x.no = e.after AND x.kind = 0
"""


DIGESTS = _digests()


def _resampled() -> str:
    from kgspark.llm import importance as i

    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) || list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])"
    byte = "list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    ratio = f"(t + 1) * (all_s + {i.BUCKETS}) / ((s + 1) * (all_t + {i.BUCKETS}))"
    noise = "floor(-1000 * ln(-ln((CAST('0x' || left(sha256('" + i.SEED + ":' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))"
    return f"""
WITH tab AS (SELECT list(list_reduce([CAST(k AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {i.POLYNOMIAL}) ELSE c >> 1 END) ORDER BY k) AS tab FROM range(256) r(k)),
 w AS (SELECT doc_id, row_number() OVER () AS no, {words} AS l FROM documents UNION ALL SELECT NULL, NULL, {words} FROM benchmark),
 f AS (SELECT no, unnest({runs}) AS x FROM w),
 crc AS (SELECT x, xor(list_reduce([CAST(4294967295 AS BIGINT)] || {byte}, lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % {i.BUCKETS} AS bucket
   FROM (SELECT DISTINCT x FROM f), tab),
 n AS (SELECT bucket, CAST(count(*) FILTER (no IS NOT NULL) AS DOUBLE) AS s, CAST(count(*) FILTER (no IS NULL) AS DOUBLE) AS t FROM f JOIN crc USING (x) GROUP BY bucket),
 gain AS (SELECT bucket, CAST(floor(1000 * ln({ratio})) AS BIGINT) AS g FROM n, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n)),
 sums AS (SELECT no, count(*) AS n_features, sum(g) AS weight FROM f JOIN crc USING (x) JOIN gain USING (bucket) WHERE no IS NOT NULL GROUP BY no),
 scored AS (SELECT doc_id, len(l) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
   CAST(coalesce(weight, 0) + {noise} AS BIGINT) AS score FROM w LEFT JOIN sums USING (no) WHERE w.no IS NOT NULL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {i.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (n_words >= {i.LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {i.LEAST_WORDS} AND r <= {i.PER_CENT} * n // 100 THEN r END AS rank FROM ranked
"""


RESAMPLED = _resampled()


def _audit() -> str:
    from kgspark.llm import divergence as d

    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

    def share(n: str, size: str) -> str:
        return f"1 + ({d.UNIT} * CAST({n} + {d.SMOOTH} AS HUGEINT)) // ({size} + {d.SMOOTH} * v)"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {terms} AS l FROM documents),
 words AS (SELECT no, lang, source, unnest(l) AS term FROM docs),
 kept AS (SELECT lang, term, count(*) AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= {d.LEAST_DOCS}),
 langs AS (SELECT lang, count(*) AS v, sum(all_n) AS all_size FROM kept GROUP BY lang),
 groups AS (SELECT DISTINCT lang, source FROM docs),
 counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
 dense AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "size")} AS p, {share("all_n", "all_size")} AS q
   FROM sizes s JOIN kept k ON s.lang = k.lang JOIN langs g ON s.lang = g.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
 met AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
 every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {d.TOP_TERMS}
"""


AUDIT = _audit()
