"""Edits that keep a graph whole: merges along chains, renames with their edges, checked edges, closed facts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import SEP

from .graph_build import canonical, edit_nodes, supersede
from .scale import cut_lineage, salted_join

BLANK_LINE = "\n\n"


def resolve_merges(mapping: DataFrame) -> DataFrame:
    """Where every merged name ends: (source, target, cyclic), one row per source.

    ``mapping`` (source, target) may hold chains: with a to b and b to c, both end at c. Every turn replaces a
    target by the target's target, so a chain of n steps takes log2(n) turns. Names on a cycle, or that lead
    into one, have no end: they are marked and keep their first target. Of several targets of a source the
    least counts; a name mapped to itself and NULL names are no merges.
    """
    steps = mapping.where("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    first = cut_lineage(steps)
    count = first.count()
    jumps = first.withColumn("open", F.lit(True))
    for _ in range(math.ceil(math.log2(count + 1)) + 1 if count else 0):
        onward = jumps.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        jumps = jumps.join(onward, "target", "left").select("source", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("open"))
        jumps = cut_lineage(jumps)
        if not jumps.where("open").limit(1).count():
            break
    begun = first.withColumnRenamed("target", "_first")
    return jumps.join(begun, "source").select("source", F.when(F.col("open"), F.col("_first")).otherwise(F.col("target")).alias("target"), F.col("open").alias("cyclic"))


def apply_names(df: DataFrame, resolved: DataFrame, column: str, salts: int = 8) -> DataFrame:
    """Replace names by where they end; hot names are spread over ``salts`` tasks."""
    ends = resolved.where("NOT cyclic").select(F.col("source").alias(column), F.col("target").alias("_to"))
    moved = salted_join(df, ends, [column], df.columns, "left", salts)
    return moved.withColumn(column, F.coalesce("_to", column)).select(df.columns)


def _merged(column: str, how: str):
    """Aggregate of one column over merged rows in order of ``position``; empty values do not count."""
    value = F.col(column)
    given = value.isNotNull() & (value.cast("string") != "")
    if how == "max":
        return F.max(column)
    if how in ("keep_first", "keep_last"):
        pick = F.min_by if how == "keep_first" else F.max_by
        return pick(column, F.when(given, F.col("position")))
    if how == "concatenate":
        listed = F.array_sort(F.collect_list(F.when(given, F.struct("position", value.cast("string").alias("v")))))
        return F.array_join(F.transform(listed, lambda x: x["v"]), BLANK_LINE)
    if how == "join_unique":
        parts = F.flatten(F.collect_set(F.when(given, F.split(value.cast("string"), SEP))))
        return F.array_join(F.array_sort(F.array_distinct(parts)), SEP)
    raise ValueError(f"unknown merge strategy {how!r}")


def merge_graph(
    nodes: DataFrame, edges: DataFrame, mapping: DataFrame, node_strategies: dict[str, str], edge_strategies: dict[str, str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges nodes and moves their edges along: (nodes, edges, names that were not merged).

    Nodes (name, position, …) and edges (src, tgt, position, …) have a place in order. Strategies per column:
    concatenate (values in order, a blank line between), keep_first, keep_last, join_unique (of parts, sorted)
    and max; columns without one drop out. Self-loops drop out and parallel edges merge. Merges of
    missing nodes and merges on a cycle are left out and returned with a reason.
    """
    known = nodes.select(F.col("name").alias("source"), F.lit(True).alias("_known")).distinct()
    asked = mapping.join(known, "source", "left")
    good = resolve_merges(asked.where("_known").select("source", "target"))
    good = cut_lineage(good)
    left_out = asked.where("_known IS NULL").select("source", "target", F.lit("missing").alias("reason"))
    left_out = left_out.unionByName(good.where("cyclic").select("source", "target", F.lit("cycle").alias("reason")))
    moved = apply_names(nodes, good, "name")
    new_nodes = moved.groupBy("name").agg(*[_merged(c, how).alias(c) for c, how in node_strategies.items()], F.count(F.lit(1)).alias("n_merged"))
    moved = canonical(apply_names(apply_names(edges, good, "src"), good, "tgt"))
    new_edges = moved.groupBy("src", "tgt").agg(*[_merged(c, how).alias(c) for c, how in edge_strategies.items()], F.count(F.lit(1)).alias("n_merged"))
    return new_nodes, new_edges, left_out


def edit_graph(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits nodes, and edges follow their renamed ends: (nodes, edges, rejected edits with the reason).

    As ``edit_nodes``; of several renames to one name the least old name gets it, the others are rejected as
    taken, and an edge between renamed nodes moves at both ends.
    """
    renamed = F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name"))
    winner = changes.where(renamed).groupBy("new_name").agg(F.min("name").alias("_winner"))
    checked = changes.join(winner, "new_name", "left").withColumn("_lost", renamed & (F.col("_winner") != F.col("name")))
    lost = checked.where("_lost").select(*changes.columns, F.lit("taken").alias("reason"))
    good = cut_lineage(checked.where("NOT coalesce(_lost, false)").select(changes.columns))
    new_nodes, rejected = edit_nodes(nodes, good)
    bad = rejected.select(F.col("name").alias("source")).distinct()
    moves = good.where(renamed).select(F.col("name").alias("source"), F.col("new_name").alias("target"), F.lit(False).alias("cyclic"))
    moves = cut_lineage(moves.join(bad, "source", "left_anti"))
    moved = apply_names(apply_names(edges, moves, "src"), moves, "tgt")
    return new_nodes, canonical(moved), rejected.select(*changes.columns, "reason").unionByName(lost)


def edit_relations(edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of edges (src, tgt, and columns to set, NULL for unchanged): (edges, edits of missing edges)."""
    keys = ["src", "tgt"]
    new = canonical(changes)
    columns = [c for c in changes.columns if c not in keys]
    known = edges.select(*keys).distinct()
    named = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = edges.join(named, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in edges.columns])
    return out, new.join(known, keys, "left_anti")


def create_relations(new: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New edges whose ends are nodes and that do not exist, either way round: (created, rejected with the reason)."""
    have = nodes.select(F.col("name")).distinct()
    known = canonical(edges).select("src", "tgt", F.lit(True).alias("_there")).distinct()
    checked = canonical(new).dropDuplicates(["src", "tgt"])
    for end in ("src", "tgt"):
        checked = checked.join(have.select(F.col("name").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    checked = checked.join(known, ["src", "tgt"], "left")
    reason = F.when(F.col("_src").isNull() | F.col("_tgt").isNull(), "missing end").when(F.col("_there"), "exists")
    checked = checked.withColumn("reason", reason)
    return checked.where("reason IS NULL").select(new.columns), checked.where("reason IS NOT NULL").select(*new.columns, "reason")


def supersede_onto(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Current and closed edges after ``incoming`` came on top of ``stored``, with the time each was closed at.

    Both (src, relation_type, tgt, position, relation_id, at); every position of ``incoming`` comes after those
    of ``stored``. As ``supersede``, and ``invalid_at`` is the time of the relation that closed an edge last; closed
    edges stay for audit.
    """
    columns = ["src", "relation_type", "tgt", "position", "relation_id", "at"]
    rows = incoming.select(columns)
    if stored is not None:
        rows = stored.select(columns).unionByName(rows)
    closed = rows.groupBy(F.col("relation_id").alias("superseded_by")).agg(F.max("at").alias("invalid_at"))
    return supersede(rows).join(closed, "superseded_by", "left").select("src", "relation_type", "tgt", "relation_id", "status", "superseded_by", "invalid_at")
