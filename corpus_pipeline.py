"""From raw documents to packed sequences: five stages, each written and read again before the next.

Quality by a field over lines, near duplicates, benchmark items, secrets, packing. Every stage judges all
that its predecessor kept, and its decisions take effect: low quality, all but one of a group of near
duplicates and documents with a benchmark item go, secrets are masked, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontamination, line_quality, near_duplicates, packing, secret_scan
from kgspark.llm.common import crc_of_id, read, work_folder

THRESHOLD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below THRESHOLD; learns from labels that are not held out."""
    model = line_quality.train(docs, read(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    scored = line_quality.score_documents(docs, model, "_quality")
    return scored.where(scored["_quality"] >= THRESHOLD).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near duplicates (five words, 0.8), and equal rows of an id once.

    Rows that share an id but not a text both stay where their id stays. Of rows with equal id and text the
    least in all columns stays.
    """
    found = near_duplicates.near_duplicates(docs, size=5, per_cent=80)
    docs = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    same = [F.col("doc_id"), F.xxhash64("text").alias("_text")]
    repeated = docs.where("doc_id IS NOT NULL").groupBy(*same).count().where("count > 1").select("doc_id").distinct()
    if not repeated.limit(1).count():
        return docs
    rows = docs.join(repeated, "doc_id", "left_semi").select(F.struct(docs.columns).alias("_row"))
    once = rows.groupBy("_row.doc_id", "_row.text").agg(F.min("_row").alias("_row")).select("_row.*")
    return docs.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.without_items(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets and linked credential parts in the texts; drops nothing."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of 2048 tokens: one row per piece."""
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


ORACLE_SQL = None  # the quality model, sketches and the tokenizer are beyond SQL; see tests/llm
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
