"""Secrets in texts: plain patterns, and credentials whose parts stand apart.

Three base kinds are reported wherever they match. Weak signs (an account name, a short secret, the
address of a service) mean little alone; they are parts of one credential when complementary parts
stand within a scope of each other, and are reported only then. Parts are put into bins as wide as the
scope and joined on text and bin, so a part meets only what is near it.

Everything is DataFrame functions. A text that no quick test hits takes no further work; matching texts
are scanned once per distinct text, whatever the number of copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import cut_lineage

SCOPE = 256  # code points between the parts of one credential
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""

#: kind: (pattern, group whose length counts, least length, role, weak). Base kinds come first; fixed values.
KINDS = {
    "assign": (rf"((?i:password|passwd|secret|token|api_?key)){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 2, 8, "secret", False),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "identifier", False),
    "hex": (r"[0-9a-f]{32,}", 0, 32, "secret", False),
    "account": (
        rf"((?i:access_?key_?id|client_?id|key_?id|user_?name|user|login|account)){_ASSIGNED}([A-Za-z0-9@._+-]+)",
        2, 3, "identifier", True,
    ),
    "weak_secret": (rf"((?i:pass|pwd|pin|auth|credentials?|private_?key|secret_?key)){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 2, 4, "secret", True),
    "endpoint": (r"((?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp))://([A-Za-z0-9@:._/-]+)", 2, 4, "endpoint", True),
}
BASE = [k for k, v in KINDS.items() if not v[4]]
#: What must stand in scope of a weak part: all roles of one of these sets.
NEEDS = {"identifier": [{"secret"}], "secret": [{"identifier"}], "endpoint": [{"identifier", "secret"}]}
MASK = "[SECRET]"


def _quick(text: Column) -> Column:
    """May hold a base match, or parts that could link."""
    found = {k: text.rlike(v[0]) for k, v in KINDS.items()}
    linked = (found["account"] | found["access"]) & found["weak_secret"]
    return reduce(lambda a, b: a | b, [found[k] for k in BASE]) | linked


def _matches(text: Column, kind: str) -> Column:
    """Matches of one kind in order: lengths of the text since the match before, of the match, of what counts.

    The pattern takes in what stands before a match, so lengths add up to positions; the last, empty
    match takes the rest of the text, which keeps the scan linear.
    """
    pattern, group, _, _, _ = KINDS[kind]
    whole = F.lit(rf"([\s\S]*?)({pattern}|\z)")
    counted = F.lit(2 + group if group else 2)
    parts = [F.regexp_extract_all(text, whole, g) for g in (F.lit(1), F.lit(2), counted)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("before", "match", "counted"))])
    sized = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), F.length(z["before"]).cast("long").alias("before"),
        F.length(z["match"]).cast("long").alias("size"), F.length(z["counted"]).alias("counted"),
    ))
    return F.when(text.rlike(pattern), sized).otherwise(F.array().cast("array<struct<kind:string,no:int,before:bigint,size:bigint,counted:int>>"))


def find_parts(texts: DataFrame) -> DataFrame:
    """All matches in distinct texts (``key, text``): key, kind, role, weak, start, end in code points."""
    found = texts.select("key", F.explode(F.concat(*[_matches(F.col("text"), k) for k in KINDS])).alias("m")).select("key", "m.*")
    upto = W.partitionBy("key", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("before") + F.col("size")).over(upto))
    found = found.withColumn("start", F.col("end") - F.col("size"))
    enough = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("counted") >= v[2]) for k, v in KINDS.items()])
    role = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[3])])
    return found.where((F.col("size") > 0) & enough).select(
        "key", "kind", role[F.col("kind")].alias("role"), (~F.col("kind").isin(BASE)).alias("weak"), "start", "end"
    )


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base matches, and weak ones whose complement is in scope.

    A bin holds a bounded number of parts, so the join on text and bin grows with the text alone.
    """
    def bins(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    weak = parts.where("weak").select("key", "kind", "role", "start", "end", bins(F.col("start") - scope, F.col("end") + scope).alias("bin"))
    near = parts.select(
        "key", F.col("role").alias("with"), F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"),
        bins(F.col("start"), F.col("end")).alias("bin"),
    )
    gap = F.greatest(F.col("s2") - F.col("end"), F.col("start") - F.col("e2"))
    met = weak.join(near, ["key", "bin"]).where((F.col("role") != F.col("with")) & (gap <= scope))
    met = met.groupBy("key", "kind", "role", "start", "end").agg(F.collect_set("with").alias("roles"))  # three roles at most
    complete = reduce(lambda a, b: a | b, [
        (F.col("role") == role) & (F.size(F.array_except(F.array(*[F.lit(x) for x in sorted(need)]), F.col("roles"))) == 0)
        for role, needs in NEEDS.items() for need in needs
    ])
    names = ["key", "kind", "start", "end"]
    return parts.where("NOT weak").select(*names, F.lit(True).alias("base")).unionByName(
        met.where(complete).select(*names, F.lit(False).alias("base"))
    )


def keyed(df: DataFrame) -> DataFrame:
    """Adds ``key``, the hash of texts that need a scan; NULL for all others."""
    text = F.coalesce("text", F.lit(""))
    return df.withColumn("key", F.when(_quick(text), F.sha2(text, 256)))


def text_spans(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of each distinct text of ``df`` that has any: key, spans (sorted structs)."""
    texts = keyed(df.select("text")).where(F.col("key").isNotNull()).groupBy("key").agg(F.first("text").alias("text"))
    spans = link_parts(cut_lineage(find_parts(texts)), scope)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    row = F.struct("start", order[F.col("kind")].alias("order"), "end", "kind", "base")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("spans"))


def scan(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``df``: doc_id and ``spans``, an array of start, order, end, kind, base.

    Positions are code points, ends exclusive; spans are sorted by start, then kind in the order of KINDS.
    NULL and empty texts have none, repeated rows have the same spans each, an empty table gives no rows,
    and other columns are ignored.
    """
    docs = keyed(df.select("doc_id", "text")).drop("text")
    # Texts that need no scan find nothing; with a key of their own they do not meet in one task.
    docs = docs.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.col("doc_id").cast("string"))))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,base:boolean>>")
    return docs.join(text_spans(df, scope), "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``df`` with every span of its texts replaced by MASK; ``n_chars``, if there, follows the new text.

    Texts without spans pass unchanged and are not shuffled.
    """
    docs = keyed(df)
    spans = text_spans(df, scope).select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.end")
    before = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    spans = spans.withColumn("_new", apart.cast("int"))
    upto = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    merged = spans.withColumn("_no", F.sum("_new").over(upto)).groupBy("key", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    after = F.coalesce(F.lag("end").over(W.partitionBy("key").orderBy("start")), F.lit(0))
    merged = merged.withColumn("after", after)
    holes = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "after", "end"))).alias("_holes"))
    dirty = docs.where(F.col("key").isNotNull()).join(holes, "key", "left")
    kept = F.transform("_holes", lambda h: F.concat(F.substring("text", (h["after"] + 1).cast("int"), (h["start"] - h["after"]).cast("int")), F.lit(MASK)))
    rest = F.expr("substring(text, CAST(element_at(_holes, -1).end + 1 AS INT))")
    text = F.when(F.col("_holes").isNull(), F.col("text")).otherwise(F.concat(F.concat_ws("", kept), rest))
    dirty = dirty.withColumn("text", text)
    if "n_chars" in df.columns:
        dirty = dirty.withColumn("n_chars", F.when(F.col("_holes").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return docs.where(F.col("key").isNull()).select(df.columns).unionByName(dirty.select(df.columns))
