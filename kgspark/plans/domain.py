"""The given tables seen as the engine's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import fusion as R
from kgspark.operators import lexical as L
from kgspark.operators import vectors as V
from kgspark.operators.scale import use_all_cores

from .registry import read


def docs(spark, sf) -> DataFrame:
    return use_all_cores(read(spark, sf, "documents")).select("doc_id", "text", F.col("lang").alias("kb_id"), F.col("source").alias("owner_id"))


def queries(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyword_hits(spark, sf, k: int = R.BM25_TOP) -> DataFrame:
    return L.keyword_hits(docs(spark, sf).select("doc_id", "text"), queries(spark, sf), k)


def dense_hits(spark, sf, k: int = R.DENSE_TOP) -> DataFrame:
    d = V.hashed_embedding(docs(spark, sf), "doc_id")
    q = V.hashed_embedding(queries(spark, sf), "query_id")
    return V.sparse_hits(d, q, k)


def channels(spark, sf) -> DataFrame:
    keep = ["query_id", "doc_id", "rank", "score"]
    dense = R.stamp(dense_hits(spark, sf).select(*keep, "vector_score"), "dense")
    bm25 = R.stamp(keyword_hits(spark, sf).select(*keep, "keyword_score"), "bm25")
    return R.union_channels(dense, bm25)


def fused(spark, sf) -> DataFrame:
    return R.reciprocal_rank(channels(spark, sf))


def vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def label_queries(spark, sf) -> DataFrame:
    """One query per label: the mean of its vectors."""
    return V.centroids(vectors(spark, sf), "label")


# ---- graph: parts and suppliers, one record per order line, the order is the chunk --------

_DAMAGE = (
    "CASE l_linenumber WHEN 1 THEN '<|##|>' WHEN 2 THEN '<||>' WHEN 3 THEN '<|#>' WHEN 4 THEN '<#|>' "
    "WHEN 5 THEN '<X#|>' WHEN 6 THEN '<|#| ' WHEN 7 THEN '||#||' ELSE '<|#|>' END"
)
_PART = "'Part ' || CAST(l_partkey AS STRING) || ' ' || p_name"
_SUPPLIER = "'Supplier ' || CAST(l_suppkey AS STRING)"
_QUANTITY = "CAST(l_quantity AS STRING)"
FIRST_PASS = (
    f"'entity' || {_DAMAGE} || {_PART} || {_DAMAGE} || p_type || {_DAMAGE} || 'lot ' || l_returnflag || ' of ' || {_QUANTITY} || chr(10) || "
    f"'relation' || {_DAMAGE} || {_PART} || {_DAMAGE} || {_SUPPLIER} || {_DAMAGE} || p_brand || ',' || l_linestatus || {_DAMAGE} || "
    f"CASE WHEN l_linenumber % 2 = 0 THEN {_QUANTITY} ELSE 'shipped ' || {_QUANTITY} || ' units' END"
)
SECOND_PASS = (
    f"'entity<|#|>' || {_PART} || '<|#|>' || p_brand || '<|#|>lot ' || l_returnflag || ' of ' || {_QUANTITY} || ' at ' || CAST(l_extendedprice AS STRING) || chr(10) || "
    f"'entity<|#|>' || {_SUPPLIER} || '<|#|>org<|#|>supplies ' || p_name"
)
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def extractions(spark, sf) -> DataFrame:
    """Model output per order and pass; an order has at most a handful of lines."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.expr("p_partkey = l_partkey"))

    # Columns move to the order, and texts are rendered there: these are several times as long.
    columns = dict.fromkeys([*LINE_ORDER, *re.findall(r"\b[lp]_\w+", FIRST_PASS + SECOND_PASS)])

    def rendered(number, lines, line, shipped):
        of_row = re.sub(r"\b([lp]_\w+)", r"r.\1", f"{', '.join(LINE_ORDER)}, {line}")
        placed = F.sort_array(F.expr(f"transform({lines}, r -> struct({of_row} AS line))"))
        text = F.concat(F.array_join(F.transform(placed, lambda r: r["line"]), "\n"), F.lit("\n<|COMPLETE|>"))
        shipped = F.unix_timestamp(F.col(shipped).cast("timestamp"))
        return F.struct(F.lit(number).alias("pass"), text.alias("result"), shipped.alias("created_at"))

    # Both passes of an order come from one grouping.
    orders = lines.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(
        F.collect_list(F.struct(*columns)).alias("_0"),
        F.min("l_shipdate").alias("_at0"), F.min(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate"))).alias("_at1"),
    )
    second = "filter(_0, l -> l.l_linenumber % 3 = 0)"
    both = F.array(rendered(0, "_0", FIRST_PASS, "_at0"), F.when(F.expr(f"size({second}) > 0"), rendered(1, second, SECOND_PASS, "_at1")))
    path = F.concat(F.lit("src"), (F.col("chunk_id") % 20).cast("string"))
    passes = orders.select("chunk_id", F.explode(both).alias("_p"), path.alias("file_path")).filter("_p IS NOT NULL")
    return passes.select("chunk_id", "_p.*", "file_path")


def relation_records(spark, sf) -> DataFrame:
    """One relation record per order line, without the detour over model text."""
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt"),
        F.col("l_quantity").alias("weight"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("keywords"),
        F.concat(F.lit("lot "), F.col("l_returnflag")).alias("description"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("created_at"), F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")).alias("file_path"),
    )


def edges(spark, sf) -> DataFrame:
    """Merged edges (src = part, tgt = supplier, weight, keywords)."""
    from kgspark.operators.graph_build import merge_relations

    return merge_relations(relation_records(spark, sf))


def nodes(spark, sf) -> DataFrame:
    """All parts and suppliers that occur in order lines, with a type."""
    li = read(spark, sf, "lineitem")
    parts = li.select(F.concat(F.lit("P"), "l_partkey").alias("name"), F.col("l_partkey").alias("p_partkey")).distinct()
    parts = parts.join(read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("entity_type")), "p_partkey").drop("p_partkey")
    suppliers = li.select(F.concat(F.lit("S"), "l_suppkey").alias("name"), F.lit("SUPPLIER").alias("entity_type")).distinct()
    return parts.unionByName(suppliers)
