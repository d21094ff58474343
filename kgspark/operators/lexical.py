"""BM25 retrieval for a batch of queries, and score calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import patterns as P
from kgspark.functions.text import bind, tokens

from .scale import top_per_key, written

MEETINGS = 4_000_000  # postings times queries that are added up in one task, about

# Fixed values of the ranking function and its calibration.
K1, B = 1.5, 0.75
KEYWORD_SCALE = 4.0


def calibrate_cosine(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def calibrate_bm25(col: Column) -> Column:
    return F.when(col <= 0, 0.0).otherwise(col / (col + KEYWORD_SCALE))


def absolute_relevance(col: Column) -> Column:
    """Scores of unknown origin: up to 1 they count as cosine, above as BM25."""
    return F.when(col <= 1.0, calibrate_cosine(col)).otherwise(calibrate_bm25(col))


def search_length(text: Column) -> Column:
    """Number of search tokens, without building the list where a count of words will do."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.when(lowered.rlike(P.CJK), F.size(tokens(text))).otherwise(F.regexp_count(lowered, F.lit("[a-z0-9_]+")))


def bm25_scores(docs: DataFrame, queries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Positive BM25 scores: (query_id, doc_id, *scope, score).

    ``docs`` (doc_id, text, *scope) and ``queries`` (query_id, text, *scope); with ``scope`` the
    corpus statistics are those of the scope and a query sees only its own scope. Only postings
    of query terms leave the scan, and a repeated query term counts as often as it is repeated.
    Texts stay where they are: the query side and the postings are written once, the query side is
    broadcast while its bytes allow, and what is shuffled are postings and partial sums.
    """
    scope = scope or []
    asked = (
        queries.select("query_id", *scope, F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", *scope, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    asked = written(asked)
    vocabulary = written(asked.select(*scope, "term").distinct())
    sized = docs.select("doc_id", *scope, tokens(F.col("text")).alias("_toks")).withColumn("dl", F.size("_toks"))
    # A document is one row, so its counts are complete in its task before anything is shuffled.
    postings = written(
        sized.select("doc_id", *scope, "dl", F.explode("_toks").alias("term"))
        .join(vocabulary, [*scope, "term"], "left_semi")
        .groupBy("doc_id", *scope, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    corpus = docs.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(search_length(F.col("text"))).alias("avgdl")
    )
    found = postings.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    stats = found.join(corpus, scope) if scope else found.crossJoin(corpus)  # corpus: one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = written(asked.join(stats.withColumn("idf", idf), [*scope, "term"]).select(
        "query_id", *scope, "term", "avgdl", (F.col("idf") * F.col("qtf")).alias("w")
    ))
    average = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    damped = F.col("tf") + K1 * (1 - B + B * F.col("dl") / average)
    part = F.col("w") * F.col("tf") * (K1 + 1) / damped
    # Postings of asked terms meet by document, so that no pair of query and document is shuffled. The number of
    # parts follows what they become once they have met the queries; a given number is never merged again.
    times = asked.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("_q"))
    meetings = found.join(times, [*scope, "term"]).agg(F.sum(F.col("df") * F.col("_q"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-meetings // MEETINGS))
    return (
        postings.repartition(parts, "doc_id").join(weights, [*scope, "term"])
        .groupBy("query_id", "doc_id", *scope)
        .agg(F.sum(part).alias("score"))
    )


def single_bm25(query: Column, text: Column) -> Column:
    """BM25 of one text that is a corpus by itself: all idf are equal, its length is the average."""
    idf = math.log(1 + 0.5 / 1.5)

    def scored(words: Column) -> Column:
        def add(total: Column, term: Column) -> Column:
            tf = F.size(F.filter(words, lambda w: w == term))
            return total + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1)).otherwise(0.0)

        return F.aggregate(tokens(query), F.lit(0.0), add)

    return bind(tokens(text), scored)


def by_score(score: str, id_col: str) -> list[Column]:
    """Best first; float noise below 1e-9 does not decide, the id does."""
    return [F.round(score, 9).desc(), F.col(id_col).asc()]


def keyword_hits(docs: DataFrame, queries: DataFrame, k: int, scope: list[str] | None = None) -> DataFrame:
    """Top ``k`` per query with raw and calibrated score: (query_id, doc_id, rank, …)."""
    scored = bm25_scores(docs, queries, scope).filter(F.col("score") > 0)
    top = top_per_key(scored, ["query_id"], by_score("score", "doc_id"), k)
    keyword = calibrate_bm25(F.col("score"))
    return top.withColumn("raw_score", F.col("score")).withColumn("keyword_score", keyword).withColumn("score", keyword)
