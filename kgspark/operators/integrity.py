"""Referential checks, purge checks and cascading removal."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_ROWS = 500_000  # relations that one task puts in order


def check_references(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Violations of the id rules: (kind, id).

    ``chunks`` (chunk_id, source_id), ``entities`` (entity_id, name, source_id), ``relations``
    (relation_id, src_entity_id, tgt_entity_id, source_id). Ids are shuffled and merged: a table of them looks
    small by its file, so it would be broadcast, and every task would hold all ids. The number of parts grows with the
    relations, so that what a task holds does not.
    """
    parts = max(relations.sparkSession.sparkContext.defaultParallelism, math.ceil(relations.count() / PART_ROWS))
    known = chunks.select(F.col("chunk_id").alias("source_id")).repartition(parts, "source_id").distinct().hint("merge")

    def lost(rows, id_col, kind):
        return rows.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"))

    found = [
        lost(chunks.filter(F.col("source_id").isNotNull() & (F.col("source_id") != F.col("chunk_id"))), "chunk_id", "chunk_source"),
        lost(entities.join(known, "source_id", "left_anti"), "entity_id", "entity_source"),
        lost(entities.filter(F.col("name") == F.col("entity_id")), "entity_id", "entity_name"),
        lost(relations.repartition(parts, "source_id").join(known, "source_id", "left_anti"), "relation_id", "relation_source"),
    ]
    for side in ("src_entity_id", "tgt_entity_id"):
        ends = entities.select(F.col("entity_id").alias(side)).repartition(parts, side).distinct()
        missing = relations.repartition(parts, side).join(ends.hint("merge"), side, "left_anti")
        found.append(lost(missing, "relation_id", f"relation_{side[:3]}"))
    return reduce(DataFrame.unionByName, found)


def leftovers(stores: dict[str, DataFrame], docs: DataFrame, chunks: DataFrame, kb_id: str) -> DataFrame:
    """What a purge left behind per store: (store, leftovers, orphans, passed).

    Every store has (id, kb_id, doc_id, source_id); one row per source for elements with several.
    A row is left over when its kb, document or source was purged, an orphan when it has none.
    """
    d = docs.select("doc_id").distinct().withColumn("_d", F.lit(True))
    c = chunks.select(F.col("chunk_id").alias("source_id")).distinct().withColumn("_c", F.lit(True))
    parts = []
    for name, rows in stores.items():
        hit = (F.coalesce(F.col("kb_id") == kb_id, F.lit(False))) | F.col("_d").isNotNull() | F.col("_c").isNotNull()
        bare = F.col("kb_id").isNull() & F.col("doc_id").isNull() & F.col("source_id").isNull()
        marked = rows.join(d, "doc_id", "left").join(c, "source_id", "left")
        per_id = marked.groupBy("id").agg(F.max(hit.cast("int")).alias("_hit"), F.min(bare.cast("int")).alias("_bare"))
        parts.append(per_id.agg(
            F.coalesce(F.sum("_hit"), F.lit(0)).alias("leftovers"), F.coalesce(F.sum("_bare"), F.lit(0)).alias("orphans")
        ).withColumn("store", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("leftovers") == 0)


def document_consistency(expected: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document: is every expected chunk stored once, embedded once, and nothing else there?

    All three (doc_id, chunk_id); (doc_id, n_expected, missing, repeated, surplus, passed).
    """
    e = expected.select("doc_id", "chunk_id").distinct().withColumn("_e", F.lit(1))

    def counted(df, name):
        return df.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias(name))

    rows = e.join(counted(chunks, "_c"), ["doc_id", "chunk_id"], "full_outer").join(counted(vectors, "_v"), ["doc_id", "chunk_id"], "full_outer")
    zero = rows.na.fill(0, ["_e", "_c", "_v"])

    def n(condition):
        return F.count(F.when(condition, 1))

    wanted = F.col("_e") == 1
    per_doc = zero.groupBy("doc_id").agg(
        n(wanted).alias("n_expected"), n(wanted & ((F.col("_c") == 0) | (F.col("_v") == 0))).alias("missing"),
        n((F.col("_c") > 1) | (F.col("_v") > 1)).alias("repeated"), n(~wanted).alias("surplus"),
    )
    good = (F.col("n_expected") > 0) & (F.col("missing") + F.col("repeated") + F.col("surplus") == 0)
    return per_doc.withColumn("passed", good)


def remove_documents(graph_sources: DataFrame, elements: DataFrame, chunk_scopes: DataFrame, removed: DataFrame, keys: list[str]):
    """Cascade a document removal into graph elements: (elements, sources, kb tags).

    ``graph_sources`` (keys, source_id, …) has one row per source, so descriptions and documents
    stay aligned with it; ``chunk_scopes`` (chunk_id, kb_id); ``removed`` (chunk_id). Elements that
    lose all sources are dropped; the kb tags follow from the chunks that remain.
    """
    gone = removed.select(F.col("chunk_id").alias("source_id")).distinct()
    kept = graph_sources.join(gone, "source_id", "left_anti")
    had = graph_sources.select(*keys).distinct()
    alive = kept.select(*keys).distinct()
    dead = had.join(alive, keys, "left_anti")
    scopes = kept.join(chunk_scopes.withColumnRenamed("chunk_id", "source_id"), "source_id").select(*keys, "kb_id").distinct()
    return elements.join(dead, keys, "left_anti"), kept, scopes


def cached_answers(entries: DataFrame, cited: DataFrame, removed: DataFrame) -> DataFrame:
    """Cache entries that cite none of the removed chunks; ``cited`` (entry_id, chunk_id)."""
    dead = cited.join(removed.select("chunk_id").distinct(), "chunk_id", "left_semi").select("entry_id").distinct()
    return entries.join(dead, "entry_id", "left_anti")


def purge_scope(tables: dict[str, DataFrame], kb_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop a knowledge base from the metadata tables; (tables, report of dropped rows)."""
    mine = F.coalesce(F.col("kb_id") == kb_id, F.lit(False))
    kept = {name: df.filter(~mine) for name, df in tables.items()}
    counts = [
        df.filter(mine).agg(F.count(F.lit(1)).alias("dropped")).withColumn("table", F.lit(name)) for name, df in tables.items()
    ]
    return kept, reduce(DataFrame.unionByName, counts)
