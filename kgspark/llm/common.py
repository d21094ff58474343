"""What the operators of this subpackage share: reading, cut lineage, global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.scale import cut_lineage, shared_folder

__all__ = ["crc_of_id", "cut_lineage", "hash_sample", "number_rows", "read", "size_of", "work_folder", "written"]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of one run, in the store that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: for loops, whose plans would otherwise carry their past along."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; NULL has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of an id written as text, as the train/held-out rules take it."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(0)).cast("string").cast("binary"))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` with the smallest hash of ``key``; all if there are fewer.

    A limit on the hash, set by the row count so that about a fifth more rows pass it, comes first: what
    is put in order stays as small as the sample, however many tasks read the table.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > rows:
        df = df.where(place < int((1 << 40) * min(1.0, (1.2 * rows + 200) / total)))
    return df.orderBy(place, key).limit(rows)


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Adds the 0-based position of every row in the order of ``order``, without a one-task sort.

    Rows are dealt out by ranges of the whole sort key, so equal leading values do not pile up, sorted
    in their partition and written to the shared folder. Every partition then needs one number: how
    many rows come before it.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    part, index = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_part", part).withColumn("_index", index)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # One row per partition: as bounded as the number of partitions that the session sets.
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_index")).drop("_at", "_part", "_index", "_before")
