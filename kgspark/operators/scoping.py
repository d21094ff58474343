"""Visibility, document status, jobs and other lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import split_values

# Fixed values.
NOT_READY = (
    "uploading", "queued", "parsing", "chunking", "embedding", "graphing", "validating", "failed",
    "cancelled", "consistency_failed", "timeout", "deleting",
)
STATUSES = ("pending", "processing", "processed", "failed")
FAILED_JOBS = ("failed", "timeout", "cancelled", "consistency_failed")
RUNNING_JOBS = ("running", "cancelling")


def visible(records: DataFrame, kb_id: str, index: DataFrame, bindings: DataFrame, key: str) -> DataFrame:
    """Records a knowledge base may see.

    ``records`` (key, doc_id, kb_id, file_path); multi-valued columns are separator-joined.
    ``index`` (doc_id, kb_id, status, deleted) and ``bindings`` (file_name, kb_id). A document
    that is not ready hides its records; a tagged kb decides before the index, the index before
    the file binding.
    """
    i = index.select("doc_id", F.col("kb_id").alias("_ikb"), F.col("status").alias("_is"), F.col("deleted").alias("_del"), F.lit(True).alias("_in"))
    r = records.join(i, "doc_id", "left")
    blocked = F.coalesce(F.col("_del") | F.col("_is").isin(*NOT_READY), F.lit(False))
    tags = split_values(F.col("kb_id"))
    parts = records.select(key, F.explode(split_values(F.col("file_path"))).alias("_p"))
    names = parts.select(key, F.explode(F.array_distinct(F.array("_p", F.regexp_extract(F.replace("_p", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)))).alias("file_name"))
    bound = bindings.filter(F.col("kb_id") == kb_id).select("file_name").distinct()
    by_file = names.join(bound, "file_name", "left_semi").select(key).distinct().withColumn("_file", F.lit(True))
    r = r.join(by_file, key, "left")
    allowed = (
        F.when(F.size(tags) > 0, F.array_contains(tags, kb_id))
        .when(F.col("_in"), (F.col("_ikb") == kb_id) & ~F.col("_del"))
        .otherwise(F.coalesce("_file", F.lit(False)))
    )
    return r.filter(~blocked & allowed).select(*records.columns)


def status_counts(docs: DataFrame, statuses=STATUSES) -> DataFrame:
    """Documents per status, empty ones included, and the total as "all"."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in statuses], "status STRING")  # a handful of rows
    counts = docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    full = names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("status"), "n")
    return full.unionByName(total)


def repair_statuses(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """Drop unfinished status rows without content (failed ones stay), send interrupted ones back.

    ``docs`` (doc_id, status). Only pending, processing and failed documents are looked at.
    """
    have = contents.select("doc_id").distinct().withColumn("_have", F.lit(True))
    rows = docs.join(have, "doc_id", "left")
    with_text = F.col("_have").isNotNull()
    gone = ~with_text & F.col("status").isin("pending", "processing")
    status = F.when(with_text & F.col("status").isin("processing", "failed"), "pending").otherwise(F.col("status"))
    return rows.filter(~gone).withColumn("status", status).drop("_have")


def latest_jobs(jobs: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """Newest job per key."""
    rest = [c for c in jobs.columns if c not in keys]
    newest = jobs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "job_id")).alias("_j"))
    return newest.select(*keys, *[F.col(f"_j.{c}").alias(c) for c in rest])


def document_list(docs: DataFrame, index: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with the status that the latest job, its stage, else the index gives them.

    ``docs`` (doc_id, name), ``index`` (doc_id, display_name, status, deleted), ``jobs`` (doc_id,
    job_id, job_status, stage, progress, created_at). Indexed documents without a record appear
    as well unless they were cancelled.
    """
    live = index.filter(~F.col("deleted")).select("doc_id", "display_name", F.col("status").alias("_is"), F.lit(True).alias("_in"))
    job = latest_jobs(jobs, ["doc_id"]).select("doc_id", "job_id", "job_status", "stage", "progress")
    rows = docs.withColumn("_doc", F.lit(True)).join(live, "doc_id", "full_outer").join(job, "doc_id", "left")
    status = (
        F.when((F.col("job_status") == "succeeded") | (F.col("stage") == "ready"), "ready")
        .when(F.col("job_status").isin(*FAILED_JOBS), F.col("job_status"))
        .when(F.col("stage") != "", F.col("stage")).otherwise(F.coalesce(F.nullif("_is", F.lit("")), F.lit("queued")))
    )
    rows = rows.withColumn("status", F.when(F.col("_in"), F.when(status == "checked", "ready").otherwise(status)).otherwise("ready"))
    rows = rows.filter(F.coalesce("_doc", F.lit(False)) | (F.col("status") != "cancelled"))
    progress = F.when(F.col("status") == "ready", 100).otherwise(F.coalesce("progress", F.lit(0)))
    return rows.select("doc_id", F.coalesce("display_name", "name", F.col("doc_id").cast("string")).alias("name"), "status", progress.alias("progress"), F.coalesce("job_id", F.lit("")).alias("job_id"))


def expired_jobs(jobs: DataFrame, moment: Column) -> DataFrame:
    """Running jobs whose lease is over."""
    return jobs.filter(F.col("job_status").isin(*RUNNING_JOBS) & F.col("lease_until").isNotNull() & (F.col("lease_until") <= moment))


def audit_list(items: DataFrame, decisions: DataFrame, default: str) -> DataFrame:
    """Items with their saved decision or the default."""
    saved = decisions.select("item_id", F.col("decision").alias("_d"))
    return items.join(saved, "item_id", "left").withColumn("status", F.coalesce("_d", F.lit(default))).drop("_d")


def conversation_list(conversations: DataFrame, text: str = "") -> DataFrame:
    """Title filter; pinned first, then the latest message."""
    rows = conversations.filter(F.contains("title", F.lit(text.strip()))) if text.strip() else conversations
    return rows.orderBy(F.col("is_pinned").desc(), F.col("last_message_at").desc(), "conv_id")
