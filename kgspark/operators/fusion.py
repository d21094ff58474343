"""Fusing channels, admission, token budgets, context and citations.

Hit tables carry (query_id, doc_id, rank, score, vector_score, keyword_score, …); ``doc_id`` is
the id of whatever is retrieved. Lists per query are bounded by the channels' top-k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import token_count

from .lexical import absolute_relevance, by_score, calibrate_cosine
from .scale import top_per_key

# Fixed values of staged retrieval.
DENSE_TOP, BM25_TOP, GRAPH_TOP = 40, 30, 20
RRF_K, RRF_CAP, RERANK_POOL = 60, 60, 40
DEFAULT_TEMPERATURE = 0.08
RATIOS = (0.0, 0.25, 0.5, 0.75, 1.0)
HALF_LIFE_DAYS = 90
BUFFER_TOKENS = 100
EXCERPT = 240
REFUSAL = "当前资料中没有找到足够依据"

# Calibrated floors (profile, mode, ratio, floor, temperature, signal).
PROFILES = (
    ("ci", "vector", None, 0.25, 0.08, "vector"),
    ("ci", "keyword", None, 0.15, 0.06, "keyword"),
    ("ci", "hybrid", 0.0, 0.15, 0.08, "blend"),
    ("ci", "hybrid", 0.25, 0.18, 0.08, "blend"),
    ("ci", "hybrid", 0.5, 0.22, 0.08, "blend"),
    ("ci", "hybrid", 0.75, 0.24, 0.08, "blend"),
    ("ci", "hybrid", 1.0, 0.25, 0.08, "blend"),
    ("ci", "mix", None, 0.25, 0.08, "vector"),
    ("ci", "tree", None, 0.25, 0.08, "vector"),
    ("ci", "graph", None, 0.25, 0.08, "max"),
    ("ci", "rerank", None, 0.05, 0.05, "rerank"),
)


def stamp(hits: DataFrame, channel: str, variant: str = "v0") -> DataFrame:
    """Mark a ranked list with its channel and query variant."""
    return hits.withColumn("channel", F.lit(channel)).withColumn("variant", F.lit(variant))


def union_channels(*channels: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)


def weighted_fuse(vector: DataFrame, keyword: DataFrame, ratio: float) -> DataFrame:
    """ratio·vector + (1−ratio)·keyword over the full outer join of both lists."""
    ratio = min(1.0, max(0.0, float(ratio)))
    v = vector.select("query_id", "doc_id", F.col("vector_score").alias("_v"))
    k = keyword.select("query_id", "doc_id", F.col("keyword_score").alias("_k"))
    both = v.join(k, ["query_id", "doc_id"], "full_outer")
    source = F.when(F.col("_v").isNull(), "keyword").when(F.col("_k").isNull(), "vector").otherwise("hybrid")
    scored = both.select(
        "query_id", "doc_id", source.alias("source"),
        F.coalesce("_v", F.lit(0.0)).alias("vector_score"), F.coalesce("_k", F.lit(0.0)).alias("keyword_score"),
    )
    return scored.withColumn("score", ratio * F.col("vector_score") + (1 - ratio) * F.col("keyword_score"))


def reciprocal_rank(hits: DataFrame, limit: int = RRF_CAP) -> DataFrame:
    """Reciprocal-rank fusion of stamped channels; every signal keeps its best value."""
    fused = hits.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf_score"),
        F.max("vector_score").alias("vector_score"),
        F.max("keyword_score").alias("keyword_score"),
        F.array_sort(F.collect_list("channel")).alias("channels"),
    )
    return top_per_key(fused, ["query_id"], by_score("rrf_score", "doc_id"), limit)


def best_per_document(hits: DataFrame, position: str) -> DataFrame:
    """Union of lists with one row per document: highest score, earliest list on a tie."""
    order = [F.round("score", 9).desc(), F.col(position).asc()]
    return top_per_key(hits, ["query_id", "doc_id"], order, 1, "_first").drop("_first")


def blend(hits: DataFrame, ratio: float) -> DataFrame:
    """Best value per signal over all channels, then one blended ranking score."""
    best = hits.groupBy("query_id", "doc_id").agg(
        F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score")
    )
    mixed = ratio * F.coalesce("vector_score", F.lit(0.0)) + (1 - ratio) * F.coalesce("keyword_score", F.lit(0.0))
    return best.withColumn("ranking_score", mixed)


def round_robin(lists: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Merge lists in turn (list_no, pos), keeping the first sight of every id."""
    turn = [F.col("pos").asc(), F.col("list_no").asc()]
    first = top_per_key(lists, [*keys, *id_cols], turn, 1, "_first").drop("_first")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*turn)))


def owner_chunks(owners: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Chunks of ranked owners: (query_id, owner_pos, chunk_pos, chunk_id) in, one owner each out.

    Every chunk stays with its earliest owner; inside an owner the chunks shared by more owners
    come first. ``exclude`` (query_id, chunk_id) are chunks already taken elsewhere.
    """
    if exclude is not None:
        owners = owners.join(exclude.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    place = F.struct("owner_pos", "chunk_pos")
    kept = owners.groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(place).alias("_at")
    )
    return kept.select("query_id", "chunk_id", "occurrences", "_at.owner_pos", "_at.chunk_pos")


def weighted_polling(chunks: DataFrame, owners: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Linear quotas from ``most`` to ``least`` over the ranked owners, leftovers to the earliest.

    ``chunks`` from ``owner_chunks``; ``owners`` (query_id, owner_pos) are 0-based without gaps.
    """
    count = owners.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("n") == 1, F.lit(float(most))).otherwise(
        most - F.col("owner_pos") / (F.col("n") - 1) * (most - least)
    )
    quotas = owners.join(count, "query_id").withColumn("quota", F.bround(share, 0).cast("int"))
    order = [F.col("occurrences").desc(), F.col("chunk_pos").asc()]
    # No owner can receive more than all quotas together. This bound is a constant, so the long
    # lists of hubs are pruned before the shuffle.
    bound = most * (count.agg(F.max("n")).first()[0] or 0)
    ranked = top_per_key(chunks, ["query_id", "owner_pos"], order, bound, "pos").join(quotas, ["query_id", "owner_pos"])
    direct = ranked.filter(F.col("pos") <= F.col("quota"))
    used = direct.groupBy("query_id", "owner_pos").agg(F.count(F.lit(1)).alias("used"))
    spare = (
        quotas.join(used, ["query_id", "owner_pos"], "left")
        .groupBy("query_id")
        .agg(F.sum(F.col("quota") - F.coalesce("used", F.lit(0))).alias("spare"))
        # a single owner receives its quota and nothing more
        .join(count, "query_id").withColumn("spare", F.when(F.col("n") > 1, F.col("spare")).otherwise(0)).drop("n")
    )
    rest = ranked.filter(F.col("pos") > F.col("quota")).join(spare, "query_id")
    in_turn = W.partitionBy("query_id").orderBy("owner_pos", "pos")
    extra = rest.withColumn("_turn", F.row_number().over(in_turn)).filter(F.col("_turn") <= F.col("spare"))
    picked = direct.select("query_id", "owner_pos", "pos", "chunk_id", F.lit(0).alias("_round")).unionByName(
        extra.select("query_id", "owner_pos", "pos", "chunk_id", F.lit(1).alias("_round"))
    )
    final = W.partitionBy("query_id").orderBy("_round", "owner_pos", "pos")
    return picked.withColumn("rank", F.row_number().over(final)).drop("_round")


def within_budget(ranked: DataFrame, cost: Column, budget: Column | int, order: str = "rank") -> DataFrame:
    """Prefix of every query's list whose running token cost stays inside the budget."""
    upto = W.partitionBy("query_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    spent = ranked.withColumn("used_tokens", F.sum(cost).over(upto))
    return spent.filter((limit > 0) & (F.col("used_tokens") <= limit))


def chunk_budget(total: int, prompt: Column | int, graph: Column, query: Column) -> Column:
    return F.lit(total) - prompt - graph - query - BUFFER_TOKENS


def rerank_join(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach outside scores by list index; unknown indexes and missing scores drop out.

    ``hits`` (query_id, rank, …) are 1-based, ``scores`` (query_id, index, relevance) 0-based.
    """
    valid = scores.filter(F.col("relevance").isNotNull()).withColumn("rank", F.col("index") + 1)
    joined = hits.join(valid.select("query_id", "rank", "relevance"), ["query_id", "rank"])
    return joined.withColumn("rerank_score", F.col("relevance").cast("double")).drop("relevance")


def time_weight(created: Column, now: Column | float, half_life_days: int = HALF_LIFE_DAYS) -> Column:
    """Half-life decay in [0.1, 1]; unknown age counts 1, epochs up to 1e9 count 0.1."""
    at = F.lit(now) if isinstance(now, (int, float)) else now
    decay = F.pow(F.lit(0.5), (at - created) / float(half_life_days * 86400))
    return F.when(created.isNull(), 1.0).when(created <= 1e9, 0.1).otherwise(
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), decay))
    )


def admission_probability(raw: Column, floor: Column, temperature: Column) -> Column:
    scale = F.when(temperature > 0, temperature).otherwise(DEFAULT_TEMPERATURE)
    return 1.0 / (1.0 + F.exp(-(raw - floor) / scale))


def snap_ratio(ratio: float) -> float:
    value = min(1.0, max(0.0, float(ratio)))
    return min(RATIOS, key=lambda r: abs(r - value))


def signal(kind: Column, ratio: float = 0.5) -> Column:
    v, k, r = F.col("vector_score"), F.col("keyword_score"), F.col("rerank_score")
    mixed = F.when(
        v.isNotNull() | k.isNotNull(), ratio * F.coalesce(v, F.lit(0.0)) + (1 - ratio) * F.coalesce(k, F.lit(0.0))
    )
    return (
        F.when(kind == "rerank", r).when(kind == "keyword", k).when(kind == "blend", mixed)
        .when(kind == "max", F.greatest(v, k, r)).otherwise(v)
    )


def admit(hits: DataFrame, mode: str, ratio: float = 0.5, profile: str = "ci") -> DataFrame:
    """Add admission_score: a logistic around the calibrated floor of the mode."""
    rows = {(m, r): (f, t, s) for p, m, r, f, t, s in PROFILES if p == profile}

    def rule(m):
        return rows.get((m, snap_ratio(ratio) if m == "hybrid" else None)) or rows[("vector", None)]

    if "rerank_score" not in hits.columns:
        hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    plain, reranked = rule(mode), rule("rerank")
    is_reranked = F.col("rerank_score").isNotNull()

    def pick(i):
        return F.when(is_reranked, F.lit(reranked[i])).otherwise(F.lit(plain[i]))

    score = admission_probability(signal(pick(2), ratio), pick(0), pick(1))
    return hits.withColumn("admission_score", score)


def by_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Keep hits that are relevant enough. A hit that admission could not judge is dropped."""
    if threshold is None:
        return hits
    limit = min(1.0, max(0.0, float(threshold)))
    if limit <= 0:
        return hits
    if "admission_score" in hits.columns:
        return hits.filter(F.col("admission_score") >= max(0.5, limit))
    have = [F.col(c) for c in ("calibrated_score", "rerank_score") if c in hits.columns]
    return hits.filter(F.coalesce(*have, absolute_relevance(F.col("score"))) >= limit)


def post_rerank(chunks: DataFrame, cost: Column, min_score: float, top_k: int, budget: int) -> DataFrame:
    """Score filter (no score counts 1), top-k and token budget over a ranked list."""
    kept = chunks.filter((F.lit(min_score) <= 0) | (F.coalesce("rerank_score", F.lit(1.0)) >= min_score))
    order = [F.coalesce("rerank_score", F.lit(1.0)).desc(), F.col("rank").asc()]
    top = top_per_key(kept, ["query_id"], order, top_k, "final_rank")
    return within_budget(top, cost, budget, "final_rank")


def tree_scores(hypothetical: DataFrame, original: DataFrame) -> DataFrame:
    """Candidates from the hypothetical answer and the query; only the query's cosine scores them."""
    fused = weighted_fuse(
        hypothetical, original.withColumn("keyword_score", F.col("vector_score")), 0.65
    ).withColumnRenamed("score", "ranking_score")
    base = original.select("query_id", "doc_id", F.col("vector_score").alias("query_cosine"))
    return fused.select("query_id", "doc_id", "ranking_score").join(base, ["query_id", "doc_id"], "left")


def public_hits(hits: DataFrame) -> DataFrame:
    """Rows with full ownership only, scores rounded to four digits."""
    for name in ("owner_id", "kb_id", "doc_id"):
        hits = hits.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    shown = [c for c in hits.columns if c.endswith("score")]
    return hits.select(*[F.round(c, 4).alias(c) if c in shown else F.col(c) for c in hits.columns])


def citations(hits: DataFrame) -> DataFrame:
    """Number distinct (name, chunk) pairs C1, C2, … in hit order; (query_id, rank, name, doc_id, text)."""
    body = F.trim(F.coalesce(F.col("text"), F.lit("")))
    first = top_per_key(hits.filter(body != ""), ["query_id", "name", "doc_id"], [F.col("rank").asc()], 1, "_f")
    number = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return first.drop("_f").select(
        "query_id", F.concat(F.lit("C"), number).alias("citation_id"), "name", "doc_id",
        F.substring(body, 1, EXCERPT).alias("excerpt"),
    )


def validate_citations(answers: DataFrame, cites: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Citations an answer really uses and may use: (query_id, citation_id, doc_id).

    ``answers`` (query_id, kb_id, answer); ``cites`` (query_id, citation_id, doc_id, kb_id,
    version_id); ``live`` (doc_id, version_id) holds the current versions.
    """
    marks = answers.select(
        "query_id", F.col("kb_id").alias("_kb"),
        F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(C[0-9]+)\]"), F.lit(1)))).alias("citation_id"),
    )
    kept = marks.join(cites, ["query_id", "citation_id"]).filter(
        (F.col("_kb") == "") | F.col("kb_id").isNull() | (F.col("kb_id") == F.col("_kb"))
    )
    if live is not None:
        now = live.select("doc_id", F.col("version_id").alias("_live"))
        kept = kept.join(now, "doc_id").filter(F.col("version_id").isNull() | (F.col("version_id") == F.col("_live")))
    return kept.select("query_id", "citation_id", "doc_id")


def cleaned_answers(answers: DataFrame, kept: DataFrame) -> DataFrame:
    """Answers without forged markers; an answer with no valid citation becomes a refusal."""
    valid = kept.groupBy("query_id").agg(F.collect_set("citation_id").alias("_ok"))
    marks = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(C[0-9]+)\]"), F.lit(1)))
    joined = answers.join(valid, "query_id", "left").withColumn(
        "_bad", F.array_except(marks, F.coalesce("_ok", F.array().cast("array<string>")))
    )
    drop = F.aggregate(
        "_bad", F.col("answer"), lambda acc, m: F.replace(acc, F.concat(F.lit("["), m, F.lit("]")), F.lit(""))
    )
    text = F.trim(F.regexp_replace(drop, r"[ \t]{2,}", " "))
    answerable = F.col("_ok").isNotNull()
    final = F.when(answerable & (text != ""), text).otherwise(REFUSAL)
    return joined.select("query_id", final.alias("answer"), answerable.alias("answerable"))


def context_blocks(items: DataFrame, fields: list[str], budget: int) -> DataFrame:
    """Number a ranked list, cut it to the token budget and render one JSON line per item."""
    number = F.row_number().over(W.partitionBy("query_id").orderBy("rank")).alias("id")
    rows = items.select("query_id", "rank", number, *fields)
    lines = rows.withColumn("line", F.to_json(F.struct("id", *fields)))
    kept = within_budget(lines, token_count(F.col("line")), budget)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return kept.groupBy("query_id").agg(
        F.concat_ws("\n", F.transform(ordered, lambda r: r["line"])).alias("block"),
        F.sum(token_count(F.col("line"))).alias("tokens"),
    )


# ---- path bundles and parents -----------------------------------------------------------

BUNDLE_CHARS = 1800
FINAL_MIN, FINAL_MAX, PARENTS_MAX, PARENT_BUDGET, PER_DOCUMENT = 5, 8, 6, 4500, 3


def child_limit(top_k: int) -> int:
    limit = max(1, int(top_k or FINAL_MIN))
    return limit if limit < FINAL_MIN else min(FINAL_MAX, limit)


def path_bundles(hits: DataFrame) -> DataFrame:
    """Chunks under one path form a bundle: (query_id, bundle, path_id, members, content, raw_score).

    ``hits`` (query_id, rank, chunk_id, hop, path, content, raw_score); graph hits are at most a few
    dozen per query. A hit joins the first anchor (more hops first, then rank) whose path begins
    with the hit's path; hits without a path stand alone behind the others.
    """
    item = F.struct("rank", "chunk_id", "hop", F.coalesce("path", F.lit("")).alias("path"), "content", "raw_score")
    listed = hits.filter(F.col("chunk_id").isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_h"))
    anchors = F.array_sort(
        F.transform(
            F.filter("_h", lambda h: h["path"] != ""),
            lambda h: F.struct((-h["hop"]).alias("o"), h["rank"].alias("r"), h["path"].alias("p")),
        )
    )
    listed = listed.withColumn("_a", anchors)

    def place(h):
        fit = F.filter("_a", lambda a: F.startswith(a["p"], h["path"]))
        own = F.struct(F.lit(1).alias("late"), F.lit(0).alias("o"), h["rank"].alias("r"), h["chunk_id"].cast("string").alias("p"))
        first = F.get(fit, F.lit(0))
        return F.when(h["path"] == "", own).otherwise(
            F.struct(F.lit(0).alias("late"), first["o"].alias("o"), first["r"].alias("r"), first["p"].alias("p"))
        )

    placed = listed.select("query_id", F.explode(F.transform("_h", lambda h: F.struct(place(h).alias("b"), h.alias("h")))).alias("x"))
    bundles = placed.groupBy("query_id", "x.b").agg(
        F.array_sort(F.collect_list("x.h")).alias("members"), F.max(F.coalesce("x.h.raw_score", F.lit(0.0))).alias("raw_score")
    )
    text = F.array_join(F.transform("members", lambda m: F.substring(m["content"], 1, BUNDLE_CHARS)), "\n")
    number = F.row_number().over(W.partitionBy("query_id").orderBy("b"))
    return bundles.select(
        "query_id", number.alias("bundle"), F.col("b.p").alias("path_id"), "members", F.substring(text, 1, BUNDLE_CHARS).alias("content"), "raw_score"
    )


def expand_bundles(admitted: DataFrame) -> DataFrame:
    """Members of admitted bundles in bundle order, every chunk once."""
    rows = admitted.select("query_id", "bundle", "path_id", "admission_score", F.posexplode("members").alias("_i", "m"))
    order = [F.col("bundle").asc(), F.col("_i").asc()]
    rows = rows.select("query_id", "bundle", "_i", "path_id", "admission_score", "m.*").drop("rank")
    first = top_per_key(rows, ["query_id", "chunk_id"], order, 1, "_f")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).drop("_f", "_i")


def aggregate_parents(hits: DataFrame, max_children: int, max_parents: int = PARENTS_MAX, budget: int = PARENT_BUDGET) -> DataFrame:
    """Choose chunks so that few parents carry them: (query_id, rank, doc_id, parent_id).

    ``hits`` (query_id, rank, chunk_id, doc_id, parent_id, parent_tokens), at most RRF_CAP per
    query. A new parent must fit into the token budget (the first always does); one document gives
    at most three chunks when there are several.
    """
    parent = F.coalesce(F.nullif(F.col("parent_id").cast("string"), F.lit("")), F.col("chunk_id").cast("string"))
    item = F.struct("rank", parent.alias("p"), F.col("doc_id").cast("string").alias("d"), F.col("parent_tokens").cast("int").alias("n"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_h"), F.countDistinct("doc_id").alias("_docs"))

    def step(acc, h):
        known = F.array_contains(acc["parents"], h["p"])
        room = (F.size(acc["parents"]) < max_parents) & ((F.size(acc["parents"]) == 0) | (acc["used"] + h["n"] <= budget))
        opened = ~known & room
        parents = F.when(opened, F.concat(acc["parents"], F.array(h["p"]))).otherwise(acc["parents"])
        of_doc = F.size(F.filter(acc["docs"], lambda d: d == h["d"]))
        free = (F.size(acc["ranks"]) < max_children) & ((of_doc < PER_DOCUMENT) | (F.col("_docs") <= 1))
        take = (known | opened) & free
        return F.struct(
            parents.alias("parents"), (acc["used"] + F.when(opened, h["n"]).otherwise(0)).alias("used"),
            F.when(take, F.concat(acc["docs"], F.array(h["d"]))).otherwise(acc["docs"]).alias("docs"),
            F.when(take, F.concat(acc["ranks"], F.array(h["rank"]))).otherwise(acc["ranks"]).alias("ranks"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("parents"), F.lit(0).alias("used"),
        F.array().cast("array<string>").alias("docs"), F.array().cast("array<int>").alias("ranks"),
    )
    chosen = listed.select("query_id", F.explode(F.aggregate("_h", start, step, lambda a: a["ranks"])).alias("rank"))
    return hits.withColumn("parent_id", parent).join(chosen, ["query_id", "rank"]).select("query_id", "rank", "chunk_id", "doc_id", "parent_id")
