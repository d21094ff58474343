"""Snapshot tables: readers, keyed upserts, exports.

Writers produce a new snapshot; Parquet has no in-place update. Every function is a join or an
aggregation on the key, so a batch of a million keys costs one shuffle, not a million lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import ids
from kgspark.functions.text import sanitize, summary
from kgspark.operators.graph_build import UNKNOWN
from kgspark.operators.graph_query import both_ways
from kgspark.operators.scale import previous_row, rank_in_groups

# File name endings of the text family.
TEXT_SUFFIXES = (
    ".txt", ".md", ".html", ".htm", ".tex", ".json", ".xml", ".yaml", ".yml", ".rtf", ".csv",
    ".log", ".conf", ".ini", ".properties", ".sql", ".bat", ".sh", ".c", ".cpp", ".py", ".java",
    ".js", ".ts", ".swift", ".go", ".rb", ".php", ".css", ".scss", ".less",
)
PAGE_MIN, PAGE_MAX = 10, 200


def text_files(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Text files below a folder that are not indexed yet: (file_path, text)."""
    pattern = "*{" + ",".join(TEXT_SUFFIXES) + "}"
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(folder, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("text"))
    )
    return files if known is None else files.join(known.select("file_path"), "file_path", "left_anti")


def enqueue(arrivals: DataFrame, stored: DataFrame | None = None, escapes: bool = True) -> DataFrame:
    """New documents of a batch: (doc_key, text, content_summary, content_length, file_path, status).

    ``arrivals`` (position, text, file_path). Equal contents count once, the first arrival wins;
    ids that are stored already drop out before anything is written.
    """
    clean = arrivals.withColumn("text", sanitize(F.col("text"), escapes)).withColumn("doc_key", ids.content_id("doc-", F.col("text")))
    first = clean.groupBy("doc_key").agg(F.min_by(F.struct("text", "file_path"), "position").alias("_f"))
    if stored is not None:
        first = first.join(stored.select("doc_key"), "doc_key", "left_anti")
    return first.select(
        "doc_key", "_f.text", summary(F.col("_f.text")).alias("content_summary"),
        F.length("_f.text").alias("content_length"), "_f.file_path", F.lit("pending").alias("status"),
    )


def register_uploads(uploads: DataFrame, segment: int = 65536) -> DataFrame:
    """Version numbers and logical documents for uploads in arrival order.

    ``uploads`` (position, doc_id, owner_id, kb_id, name, content_hash). A content an owner has in
    a knowledge base already is a duplicate of its first upload. Others become the next version of
    (kb, name); owner, kb and name share one logical document.
    """
    first = uploads.groupBy("owner_id", "kb_id", "content_hash").agg(F.min(F.struct("position", "doc_id")).alias("_f"))
    accepted = uploads.join(first.select(F.col("_f.doc_id").alias("doc_id")), "doc_id", "left_semi")
    part = F.floor(F.col("position") / segment)
    order = [F.col("position").asc()]
    ranked = rank_in_groups(accepted, ["kb_id", "name"], order, part, "version")
    linked = previous_row(ranked, ["owner_id", "kb_id", "name"], [F.col("position")], part, F.col("doc_id"), "previous_doc_id")
    logical = accepted.groupBy("owner_id", "kb_id", "name").agg(F.min_by("doc_id", "position").alias("document_id"))
    rows = linked.join(logical, ["owner_id", "kb_id", "name"])
    columns = ["position", "doc_id", "document_id", "previous_doc_id", "version"]
    again = uploads.join(first, ["owner_id", "kb_id", "content_hash"]).filter(F.col("doc_id") != F.col("_f.doc_id"))
    duplicates = again.select("position", "doc_id", F.col("_f.doc_id").alias("duplicate_of"))
    return rows.select(*columns).unionByName(duplicates, allowMissingColumns=True)


def insert_chunks(docs: DataFrame, stored_docs: DataFrame, stored_chunks: DataFrame) -> DataFrame:
    """Ready-made chunks of new documents: (chunk_id, doc_id, chunk_order_index, content).

    ``docs`` (doc_id, chunks). A chunk text that several documents bring belongs to the first.
    """
    fresh = docs.join(stored_docs.select("doc_id"), "doc_id", "left_anti")
    rows = fresh.select("doc_id", F.posexplode("chunks").alias("pos", "content"))
    rows = rows.withColumn("chunk_id", ids.content_id("chunk-", F.col("content")))
    # earliest document, there the last position
    one = rows.groupBy("chunk_id").agg(F.min(F.struct("doc_id", (-F.col("pos")).alias("p"), "content")).alias("_r"))
    new = one.join(stored_chunks.select("chunk_id"), "chunk_id", "left_anti")
    return new.select("chunk_id", "_r.doc_id", (-F.col("_r.p")).alias("chunk_order_index"), "_r.content")


def insert_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame, nodes: DataFrame | None = None):
    """A ready-made graph: (chunks, nodes, edges) with sources mapped to chunk ids.

    ``chunks`` (source_id, content), ``entities`` (name, entity_type, description, source_id),
    ``relations`` (src, tgt, description, keywords, weight, source_id). Unknown sources and ends
    are named UNKNOWN.
    """
    keyed = chunks.withColumn("chunk_id", ids.content_id("chunk-", F.col("content")))
    where = keyed.groupBy("source_id").agg(F.max("chunk_id").alias("_c"))

    def mapped(df):
        return df.join(where, "source_id", "left").withColumn("source_id", F.coalesce("_c", F.lit(UNKNOWN))).drop("_c")

    e, r = mapped(entities), mapped(relations)
    known = e.select("name") if nodes is None else e.select("name").unionByName(nodes.select("name"))
    ends = r.select(F.explode(F.array("src", "tgt")).alias("name"), "source_id").groupBy("name").agg(F.min("source_id").alias("source_id"))
    missing = ends.join(known, "name", "left_anti").select(
        "name", F.lit(UNKNOWN).alias("entity_type"), F.lit(UNKNOWN).alias("description"), "source_id"
    )
    return keyed, e.select("name", "entity_type", "description", "source_id").unionByName(missing), r


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write per key wins; create_time survives, update_time follows the last write.

    ``stored`` (key, value, create_time, update_time), ``changes`` (key, value, at, order).
    """
    last = changes.groupBy(key).agg(
        F.max_by("value", order).alias("_v"), F.max_by("at", order).alias("_u"), F.min_by("at", order).alias("_c")
    )
    both = stored.join(last, key, "full_outer")
    return both.select(
        key, F.coalesce("_v", "value").alias("value"), F.coalesce("create_time", "_c").alias("create_time"),
        F.coalesce("_u", "update_time").alias("update_time"),
    )


def merge_attributes(stored: DataFrame, changes: DataFrame, keys: list[str], sticky: tuple[str, ...] = ("kb_id",)) -> DataFrame:
    """Given attributes override, missing ones stay, sticky ones never change once set."""
    columns = [c for c in stored.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns if c in changes.columns])
    both = stored.join(renamed, keys, "full_outer")

    def value(c):
        if c not in changes.columns:
            return F.col(c)
        return F.coalesce(c, f"_{c}").alias(c) if c in sticky else F.coalesce(f"_{c}", c).alias(c)

    return both.select(*keys, *[value(c) for c in columns])


def get_by_ids(wanted: DataFrame, stored: DataFrame, key: str, placeholders: bool = True) -> DataFrame:
    """Stored rows for wanted keys with their ordinal; missing ones as NULL rows or left out."""
    return wanted.join(stored, key, "left" if placeholders else "inner")


def filter_keys(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def delete_by_ids(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def export_relations(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, as the exported table lists it."""
    keep = [c for c in edges.columns if c not in ("src", "tgt")]
    return both_ways(edges, *keep).withColumnsRenamed({"node": "src", "other": "tgt"})


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def unique_contexts(lines: DataFrame, column: str = "value", field: str = "context") -> DataFrame:
    """Distinct contexts of JSON lines; lines that do not parse are skipped."""
    context = F.from_json(F.col(column), f"{field} STRING")[field]
    return lines.select(context.alias("context")).filter("context IS NOT NULL").dropDuplicates(["context"])


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Case-insensitive substring filter over several columns."""
    wanted = needle.strip().lower()
    if not wanted:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted))
    return rows.filter(found)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an ordered list with the total: sizes are clamped, pages start at 1."""
    size = min(PAGE_MAX, max(PAGE_MIN, size))
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    part = rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(total))
