"""Shards along a Hilbert curve over several metadata columns.

Every dimension is quantised to ``2**bits`` steps of about equal weight, the steps form a cell of a grid,
and the cells are visited in the order of a Hilbert curve. Runs of that order become shards, so a shard
covers a compact box of the metadata space and a filter on any dimension skips most shards by their
minima and maxima.

Only DataFrame functions are used. Texts never move: sizes and checksums are taken in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import number_rows, size_of

BITS = 4


def hilbert_steps(dims: int, bits: int) -> list[tuple[str, list[str]]]:
    """The transform from grid coordinates ``x0..`` to the curve, as successive column assignments.

    Skilling's transposition: undo excess rotations from the high bit down, then Gray-encode. Each step
    replaces all coordinates at once; expressions are plain SQL over the step before.
    """
    names = [f"x{i}" for i in range(dims)]
    steps = []
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i in range(dims):
            new = list(names)
            if i == 0:
                new[0] = f"CASE WHEN (x0 & {high}) <> 0 THEN xor(x0, {low}) ELSE x0 END"
            else:
                swap = f"(xor(x0, x{i}) & {low})"
                new[0] = f"CASE WHEN (x{i} & {high}) <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"
                new[i] = f"CASE WHEN (x{i} & {high}) <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END"
            steps.append(new)
    for i in range(1, dims):
        steps.append([*names[:i], f"xor(x{i}, x{i - 1})", *names[i + 1:]])
    last = f"x{dims - 1}"
    mask = "0"
    for bit in range(bits - 1, 0, -1):
        mask = f"xor({mask}, CASE WHEN ({last} & {1 << bit}) <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    steps.append([f"xor({n}, {mask})" for n in names])
    return [list(zip(names, step)) for step in steps]


def curve_index(dims: int, bits: int) -> str:
    """Interleaved bits of the transposed coordinates: the place of the cell on the curve."""
    place = []
    for bit in range(bits):
        for i in range(dims):
            weight = 1 << (bit * dims + dims - 1 - i)
            place.append(f"((x{i} & {1 << bit}) // {1 << bit}) * {weight}")
    return " + ".join(place)


def _spark_sql(text: str) -> str:
    """The same expression in Spark's spelling."""
    out = text.replace("//", "div")
    while "xor(" in out:
        start = out.rindex("xor(")  # the innermost one comes last or stands alone
        depth, comma, end = 0, 0, start + 4
        for end in range(start + 4, len(out)):
            if out[end] == "(":
                depth += 1
            elif out[end] == ")":
                if depth == 0:
                    break
                depth -= 1
            elif out[end] == "," and depth == 0:
                comma = end
        out = f"{out[:start]}(({out[start + 4:comma]}) ^ ({out[comma + 1:end]})){out[end + 1:]}"
    return out


def hilbert_cells(cells: DataFrame, dims: int, bits: int) -> DataFrame:
    """Adds ``curve`` to rows with integer coordinates ``x0..`` below ``2**bits``; keeps them as ``c0..``."""
    df = cells.select(*[F.col(f"x{i}").alias(f"c{i}") for i in range(dims)], *[F.col(f"x{i}") for i in range(dims)])
    kept = [f"c{i}" for i in range(dims)]
    for step in hilbert_steps(dims, bits):
        df = df.selectExpr(*kept, *[f"{_spark_sql(e)} AS {n}" for n, e in step])
    return df.selectExpr(*kept, f"CAST({_spark_sql(curve_index(dims, bits))} AS BIGINT) AS curve")


def quantised(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Distinct values of ``column`` with a step ``0 .. 2**bits - 1``, in order of value, of equal row weight.

    The step of a value is the share of rows with smaller values. NULL comes first. Distinct values are
    summed by their first two characters before the sums are put in order, so the one ordered task sees
    those prefixes only.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_head", F.substring(F.coalesce(F.col(column).cast("string"), F.lit("")), 1, 2))
    heads = counts.groupBy("_head").agg(F.sum("_n").alias("_hn"))
    running = W.orderBy("_head").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("_head", F.coalesce(F.sum("_hn").over(running), F.lit(0)).alias("_hb"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    inside = W.partitionBy("_head").orderBy(F.col(column).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_b", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(heads, "_head")
    step = F.floor((F.col("_b") + F.col("_hb")) * (1 << bits) / F.col("_total")).cast("int")
    return counts.crossJoin(F.broadcast(total)).select(column, step.alias("_step"))  # total: one row


def hilbert_shards(
    df: DataFrame, shards: int, categories: tuple[str, ...] = ("source", "lang"), doc_id: str = "doc_id",
    text: str = "text", bits: int = BITS,
) -> DataFrame:
    """Every row of ``df`` with its place on the curve and its shard; shard row counts differ by one at most.

    Dimensions are ``categories`` and the bit length of the text's size. Returns doc_id, size,
    text_crc32, curve, shard, slot (0-based place in the shard) and the quantised dimensions. Ties on
    the curve are ordered by id, then checksum. NULL texts count as empty, NULL categories as a value of
    their own, repeated rows each get a slot, an empty table gives no rows, and other columns of ``df``
    are ignored.
    """
    dims = len(categories) + 1
    size = size_of(text) + 8
    # 8 .. 2**35 bytes: half steps of the bit length, below 2**bits after the cut at both ends.
    length = F.least(F.greatest(F.length(F.bin(size)) - 4, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")
    rows = df.select(
        F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(categories)], size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), length.alias(f"x{dims - 1}"),
    )
    for i, c in enumerate(categories):
        steps = quantised(df.select(c), c, bits).select(F.col(c).alias("_value"), F.col("_step").alias(f"x{i}"))
        rows = rows.join(steps, F.col(f"k{i}").eqNullSafe(F.col("_value")), "left").drop("_value")
    grid = rows.sparkSession.range(1 << (bits * dims)).select(
        *[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(f"x{i}") for i in range(dims)]
    )
    cells = hilbert_cells(grid, dims, bits)  # a constant number of rows: 2 ** (bits * dims)
    rows = rows.join(F.broadcast(cells), [F.col(f"x{i}") == F.col(f"c{i}") for i in range(dims)])
    rows = rows.drop(*[f"c{i}" for i in range(dims)], *[f"k{i}" for i in range(dims - 1)])
    ranked = number_rows(rows, ["curve", "doc_id", "text_crc32"])
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    return cut_runs(ranked, shards).drop("_n", "row_no")


def cut_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """Cuts the order ``row_no`` of ``_n`` rows into ``shards`` runs whose lengths differ by one at most."""
    shard = F.expr(f"row_no * {shards} div _n")
    first = F.expr(f"(shard * _n + {shards} - 1) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("row_no") - first)
