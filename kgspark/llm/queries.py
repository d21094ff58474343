"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import (
    decontamination, digests, divergence, importance, line_quality, lm, near_duplicates, packing, search, secret_scan, sharding, substrings,
    token_files, twins,
)
from kgspark.llm.common import crc_of_id, read, work_folder

SHARDS = 24

#: Tokenizers, the language model and the fitted field are beyond SQL; tests/llm has those queries.
ORACLES: dict[str, str] = {
    "op2_hilbert_sharding": twins.shards(SHARDS),
    "op4_setsketch_duplicates": twins.DUPLICATES,
    "op5_substring_removal": twins.SUBSTRINGS,
    "op8_credential_linking": twins.SECRETS,
    "op9_simhash_windows": twins.ITEMS,
    "op10_block_pruned_search": twins.TOP_K,
    "op11_importance_resampling": twins.RESAMPLED,
    "op12_quartile_digests": twins.DIGESTS,
    "op13_source_divergence": twins.AUDIT,
}


THRESHOLD = 0.7


def op1_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a field over their lines; labels with crc32(doc_id) mod 4 = 2 are held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = line_quality.train(docs, labels, crc_of_id() % 4 != 2)
    scored = line_quality.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 runs of a Hilbert curve over source, language and size."""
    placed = sharding.hilbert_shards(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, best fit by falling length."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.cut_documents(read(spark, sf_dir, "documents"), path, end_id=1))


def op4_setsketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles overlap by 80 per cent."""
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), size=4, per_cent=80)


def op5_substring_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words under a 35-word window that starts anywhere else, too."""
    removed = substrings.remove_repeats(read(spark, sf_dir, "documents"), 35)
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").alias("n_intervals"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token blocks with a shared dictionary, and read back."""
    folder = work_folder(spark, "tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, path, spaces=True, end_id=0)
    return token_files.read_tokens(spark, folder)


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a subword lattice and a word unigram, learnt where crc32(doc_id) mod 7 is not 2."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return lm.score_documents(read(spark, sf_dir, "documents"), path, crc_of_id() % 7 != 2)


def op8_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base kinds, and weak parts that complete one another."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans")
    )


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    return decontamination.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_block_pruned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest integer inner products of every vector whose id is divisible by 20."""
    return search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five per cent of all documents, drawn by how well their word runs fit the benchmark's texts."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents, and how like they are an edited copy's and the next document's."""
    return digests.compare_with_next(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of every language differ from one another, and by which terms from the language."""
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_field_quality": op1_line_field_quality,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_setsketch_duplicates": op4_setsketch_duplicates,
    "op5_substring_removal": op5_substring_removal,
    "op6_token_files": op6_token_files,
    "op7_lattice_scores": op7_lattice_scores,
    "op8_credential_linking": op8_credential_linking,
    "op9_simhash_windows": op9_simhash_windows,
    "op10_block_pruned_search": op10_block_pruned_search,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quartile_digests": op12_quartile_digests,
    "op13_source_divergence": op13_source_divergence,
}
