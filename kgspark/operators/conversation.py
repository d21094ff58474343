"""Conversation rounds, memories and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import strip

from .scale import previous_row, running_sum, top_per_key

# Fixed values.
WINDOW_ROUNDS = 5
SUMMARY_CHARS = 2000
VECTOR_PART, OVERLAP_PART, MEMORY_FLOOR, MEMORY_TERMS = 0.7, 0.3, 0.2, 6
MEMORY_TERM = "[一-鿿]|[a-z0-9_]+"
SEGMENT = 1024  # turns of one conversation that are ordered in one task


def rounds(messages: DataFrame) -> DataFrame:
    """Number the rounds: a user message opens one, an assistant right after it closes it.

    ``messages`` (conv_id, turn, role, text); (…, round). Long conversations are cut into segments.
    """
    rows = messages.filter(F.col("role").isin("user", "assistant")).withColumn("text", strip(F.col("text")))
    rows = rows.filter(F.col("text") != "")
    part, order = F.floor(F.col("turn") / SEGMENT), [F.col("turn")]
    rows = previous_row(rows, ["conv_id"], order, part, F.col("role"), "_before")
    opens = (F.col("role") == "user") | ~F.coalesce(F.col("_before") == "user", F.lit(False))
    return running_sum(rows, ["conv_id"], order, part, opens.cast("int"), "round").drop("_before")


def window_and_older(numbered: DataFrame, keep: int = WINDOW_ROUNDS) -> DataFrame:
    """Mark messages of the last rounds as recent."""
    last = numbered.groupBy("conv_id").agg(F.max("round").alias("_last"))
    return numbered.join(last, "conv_id").withColumn("recent", F.col("round") > F.col("_last") - keep).drop("_last")


def should_summarize(marked: DataFrame, summaries: DataFrame) -> DataFrame:
    """Which conversations need a new summary; ``summaries`` (conv_id, covered_rounds)."""
    older = marked.groupBy("conv_id").agg(
        F.countDistinct(F.when(~F.col("recent"), F.col("round"))).alias("older_rounds"),
        F.coalesce(F.sum(F.when(~F.col("recent"), F.length("text"))), F.lit(0)).alias("older_chars"),
    )
    rows = older.join(summaries, "conv_id", "left").withColumn("covered_rounds", F.coalesce("covered_rounds", F.lit(0)))
    n, done = F.col("older_rounds"), F.col("covered_rounds")
    need = (n > 0) & (done != n) & ((n >= WINDOW_ROUNDS) | (F.col("older_chars") >= SUMMARY_CHARS) | (done == 0))
    return rows.withColumn("summarize", need)


def last_topics(messages: DataFrame) -> DataFrame:
    """The user message before every user message of a conversation."""
    users = messages.filter("role = 'user'")
    part = F.floor(F.col("turn") / SEGMENT)
    return previous_row(users, ["conv_id"], [F.col("turn")], part, F.col("text"), "topic")


def memory_terms(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(MEMORY_TERM), F.lit(0)))


def retrieve_memories(memories: DataFrame, requests: DataFrame, moment: Column, top_k: int = 5) -> DataFrame:
    """Scored memories per request, before the token budget: (request_id, memory_id, score, rank, text).

    ``memories`` (memory_id, owner_id, scope, kb_id, enabled, expires_at, updated_at, text[, embedding]),
    ``requests`` (request_id, owner_id, kb_id, text[, embedding]). Terms meet by equi-join inside
    the owner; with embeddings the cosine takes part.
    """
    usable = memories.filter("enabled").filter(F.col("expires_at").isNull() | (F.col("expires_at") > moment))
    asked = requests.select("request_id", "owner_id", F.col("kb_id").alias("_kb"), memory_terms(F.col("text")).alias("_q"))
    terms = usable.select("memory_id", "owner_id", "scope", "kb_id", "updated_at", F.explode(memory_terms(F.col("text"))).alias("term"))
    wanted = asked.select("request_id", "owner_id", "_kb", F.size("_q").alias("_n"), F.explode("_q").alias("term"))
    common = terms.join(wanted, ["owner_id", "term"]).filter((F.col("scope") == "global") | (F.col("kb_id") == F.col("_kb")))
    overlap = F.least(F.lit(1.0), F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.first("_n"), F.lit(MEMORY_TERMS))))
    scored = common.groupBy("request_id", "memory_id").agg(overlap.alias("overlap"), F.max("updated_at").alias("updated_at"))
    if "embedding" in requests.columns:
        scored = _with_vectors(scored, usable, requests)
    else:
        scored = scored.withColumn("score", F.col("overlap"))
    fit = scored.filter(F.col("score") >= MEMORY_FLOOR).withColumn("score", F.round("score", 6))
    order = [F.col("score").desc(), F.col("updated_at").desc(), F.col("memory_id").asc()]
    return top_per_key(fit, ["request_id"], order, max(1, min(top_k, 10))).join(usable.select("memory_id", "text"), "memory_id")


def _with_vectors(scored: DataFrame, memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Let the cosine take part: exactly for memories with common terms, by search for the others.

    At most ten memories are wanted, so ten beyond those with common terms are enough.
    """
    from .vectors import cosine, nearest

    m = memories.select("memory_id", F.col("embedding").alias("_m"))
    q = requests.select("request_id", F.col("embedding").alias("_q"))
    close = F.greatest(F.lit(0.0), F.coalesce(cosine(F.col("_m"), F.col("_q")), F.lit(0.0)))
    with_terms = scored.join(m, "memory_id").join(q, "request_id").select(
        "request_id", "memory_id", (VECTOR_PART * close + OVERLAP_PART * F.col("overlap")).alias("score"), "updated_at"
    )
    sizes = scored.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    k = 10 + (sizes.agg(F.max("n")).first()[0] or 0)
    mine = F.concat_ws("|", "owner_id", F.when(F.col("scope") == "global", "g").otherwise(F.concat(F.lit("k|"), F.col("kb_id").cast("string"))))
    both = F.array(F.concat_ws("|", "owner_id", F.lit("g")), F.concat_ws("|", "owner_id", F.lit("k"), F.col("kb_id").cast("string")))
    near = nearest(
        memories.select(F.col("memory_id").alias("doc_id"), "embedding", mine.alias("_cell_id")),
        requests.select(F.col("request_id").alias("query_id"), "embedding", F.explode(both).alias("_cell_id")),
        k, MEMORY_FLOOR / VECTOR_PART, cell="_cell_id",
    ).select(F.col("query_id").alias("request_id"), F.col("doc_id").alias("memory_id"), (VECTOR_PART * F.col("score")).alias("score"))
    others = near.join(scored.select("request_id", "memory_id"), ["request_id", "memory_id"], "left_anti")
    return with_terms.unionByName(others.join(memories.select("memory_id", "updated_at"), "memory_id"))


def memory_budget(ranked: DataFrame, cost: Column, budget: int) -> DataFrame:
    """Take memories in rank order; one that does not fit is skipped, later ones may fit.

    At most ten memories per request come in, so the fold is small.
    """
    listed = ranked.withColumn("_n", cost).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "memory_id", "_n"))).alias("_m")
    )

    def step(acc, m):
        fits = (acc["n"] == 0) | (acc["used"] + m["_n"] <= budget)
        spent = F.when(acc["n"] == 0, F.least(m["_n"], F.lit(budget))).otherwise(m["_n"])
        return F.struct(
            (acc["used"] + F.when(fits, spent).otherwise(0)).alias("used"), (acc["n"] + fits.cast("int")).alias("n"),
            F.when(fits, F.concat(acc["out"], F.array(m))).otherwise(acc["out"]).alias("out"),
        )

    id_type = ranked.schema["memory_id"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<rank:int,memory_id:{id_type},_n:int>>")
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), empty.alias("out"))
    return listed.select("request_id", F.inline(F.aggregate("_m", start, step, lambda a: a["out"]))).drop("_n")


def feedback(events: DataFrame) -> DataFrame:
    """Last feedback per message and owner; (message_id, owner_id, rating, reason, …)."""
    rest = [c for c in events.columns if c not in ("message_id", "owner_id")]
    last = events.groupBy("message_id", "owner_id").agg(F.max_by(F.struct(*rest), "position").alias("_f"))
    rows = last.select("message_id", "owner_id", *[F.col(f"_f.{c}").alias(c) for c in rest])
    return rows.withColumn("reason", F.when(F.col("rating") == "negative", F.col("reason")).otherwise(""))


def offline_candidates(events: DataFrame, fields: list[str]) -> DataFrame:
    """Every negative feedback as a JSON payload for offline evaluation."""
    payload = F.to_json(F.struct(*fields))
    return events.filter("rating = 'negative'").select("message_id", "owner_id", payload.alias("payload"))
