"""Extraction records to a merged property graph.

The graph is kept in first normal form, so that a hub with many sources never becomes one wide
row:

* ``nodes`` (name, entity_type, …) and ``edges`` (src, tgt, weight, keywords, …), src < tgt,
* ``node_sources`` / ``edge_sources``: one row per element and chunk,
* ``node_texts`` / ``edge_texts``: one row per element and distinct description, with its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import patterns as P
from kgspark.functions.text import (
    SEP,
    bind,
    clean_name,
    computed_once,
    fields_of_lines,
    repair_lines,
    split_markers,
    token_count,
    unescaped_fields_of_lines,
)

from .names import marks_in_own_texts
from .scale import cut_lineage, rank_in_groups, top_per_key

# Fixed values.
UNKNOWN = "UNKNOWN"
FORBIDDEN_TYPE = r"['()<>|/\\]"
FLOAT = r"^[-+]?[0-9]*\.?[0-9]+$"
JOIN_FRAGMENTS, JOIN_TOKENS, GROUP_TOKENS = 8, 1200, 12000
PATH_BYTES = 28768 - 5
CAUSE_WORD = "导致"
# end of fixed values
SEGMENT = 4096  # fragments of one key that are summarised together in one task


# ---- parsing ----------------------------------------------------------------------------


def parse_records(extractions: DataFrame) -> DataFrame:
    """Model output to records: (chunk_id, pass, pos, fields, created_at, file_path).

    ``extractions`` (chunk_id, pass, result, created_at, file_path). Records that were glued
    together with field delimiters instead of line breaks are taken apart.
    """
    d = r"<\|#\|>"
    known = lambda r: r.startswith("entity") | r.startswith("relation")

    def relations(part):
        head = F.when(known(part), part).otherwise(F.concat(F.lit("entity<|"), part))
        return F.transform(
            split_markers(head, f"{d}relationship{d}|{d}relation{d}"),
            lambda r: F.when(known(r), r).otherwise(F.concat(F.lit("relation<|#|>"), r)),
        )

    glued = f"{d}(?:entity|relationship|relation){d}"

    def apart(lines):
        each = F.transform(
            lines,
            lambda r: F.when(known(r) & ~r.rlike(glued), F.array(r)).otherwise(
                F.flatten(F.transform(split_markers(r, f"{d}entity{d}"), relations))
            ),
        )
        return F.when(F.forall(lines, known) & ~F.col("result").rlike(glued), lines).otherwise(F.flatten(each))

    # A text stays one string with a record per line until its delimiters are whole.
    ended = F.coalesce("result", F.lit(""))
    for mark in ("<|COMPLETE|>", "<|complete|>"):
        ended = F.replace(ended, F.lit(mark), F.lit("\n"))
    place = ["chunk_id", "pass", "created_at", "file_path"]
    lined = computed_once(extractions, place, _t=F.array_join(bind(split_markers(ended, "\n"), apart), "\n"))
    whole = computed_once(lined, place, _t=repair_lines(F.col("_t")))
    # Strings meet Python, not arrays: one row per text, and only a text with HTML entities sends it anything.
    asked = whole.select(*place, "_t", unescaped_fields_of_lines(F.when(F.contains("_t", F.lit("&")), F.col("_t"))).alias("_u"))
    cut = computed_once(asked, place, _f=F.coalesce("_u", fields_of_lines(F.col("_t"))))
    # Outer: for an inner explode Spark infers a filter on the array and computes it once more.
    rows = cut.select("chunk_id", "pass", F.posexplode_outer("_f").alias("pos", "fields"), "created_at", "file_path")
    return rows.filter("pos IS NOT NULL")


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(r.substr(F.lit(1), F.lit(1))), F.lower(r.substr(F.lit(2), F.length(r))))), ""
    )


_PLACE = ("chunk_id", "pass", "pos", "created_at", "file_path")


def entity_records(records: DataFrame) -> DataFrame:
    """Valid entity records: name, title-cased type and description."""
    f = F.col("fields")
    rows = computed_once(
        records.filter((F.size(f) == 4) & F.contains(f[0], F.lit("entity"))), list(_PLACE),
        name=clean_name(f[1]), _type=clean_name(f[2]), description=clean_name(f[3], False),
    )
    valid = (F.col("name") != "") & (F.col("_type") != "") & ~F.col("_type").rlike(FORBIDDEN_TYPE) & (F.col("description") != "")
    return rows.filter(valid).withColumn("entity_type", title_case(F.col("_type"))).drop("_type")


def relation_records(records: DataFrame) -> DataFrame:
    """Valid relation records; the weight is the last field when it is a number, else 1."""
    f = F.col("fields")
    last = F.regexp_replace(F.regexp_replace(F.element_at(f, -1), '^"+|"+$', ""), "^'+|'+$", "")
    rows = computed_once(
        records.filter((F.size(f) == 5) & F.contains(f[0], F.lit("relation"))), list(_PLACE),
        src=clean_name(f[1]), tgt=clean_name(f[2]),
        keywords=F.replace(clean_name(f[3]), F.lit("，"), F.lit(",")), description=clean_name(f[4], False),
        weight=F.when(last.rlike(FLOAT), last.try_cast("double")).otherwise(1.0),
    )
    return rows.filter((F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt")))


def best_pass(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk and key keep the pass whose first description is longest, the earliest on a tie.

    Records of a chunk and key meet once, in the order of their places; they are not joined with themselves.
    """
    known = records.dropna(subset=["chunk_id", *keys, "pass"])
    group = W.partitionBy("chunk_id", *keys)
    before = F.lag("pass").over(group.orderBy("pass", "pos"))
    first = F.when(~before.eqNullSafe(F.col("pass")), F.struct(F.length("description").alias("n"), (-F.col("pass")).alias("p")))
    best = known.withColumn("_first", first).withColumn("_best", F.max("_first").over(group))
    return best.filter(F.col("pass") == -F.col("_best.p")).drop("_first", "_best").select("chunk_id", *keys, "pass", *[
        c for c in records.columns if c not in ("chunk_id", *keys, "pass")
    ])


# ---- merging ----------------------------------------------------------------------------


def _seen() -> Column:
    return F.struct("created_at", "chunk_id", "pos")


def texts_of(records: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct descriptions per key with the place of their first sight."""
    rows = records.filter(F.col("description") != "")
    return rows.groupBy(*keys, "description").agg(F.min(_seen()).alias("seen"))


def text_order() -> list[Column]:
    """Oldest first; of the same time the longest first."""
    return [F.col("seen.created_at").asc(), F.length("description").desc(), F.col("seen").asc()]


def ordered_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Number the descriptions of every key in merge order."""
    week = F.floor(F.col("seen.created_at") / 604800)
    return rank_in_groups(texts, keys, text_order(), week, "ordinal")


def sources_of(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys, F.col("chunk_id").alias("source_id")).agg(F.min("file_path").alias("file_path"))


def merge_entities(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One node per name with its most frequent type; (name, entity_type, n_records, created_at).

    Of equally frequent types the first seen wins; the type of a stored node votes once, last.
    """
    votes = records.select("name", "entity_type", F.struct(F.lit(0).alias("late"), _seen().alias("at")).alias("seen"))
    if stored is not None:
        hit = records.select("name").distinct()
        blank = F.struct(F.lit(1).alias("late"), F.lit(None).cast(records.select(_seen().alias("s")).schema["s"].dataType).alias("at"))
        votes = votes.unionByName(stored.join(hit, "name", "left_semi").select("name", "entity_type", blank.alias("seen")))
    new = F.when(F.col("seen.late") == 0, 1)
    counted = votes.groupBy("name", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"), F.count(new).alias("_new"),
        F.min("seen.at.created_at").alias("created_at"),
    )
    # Types of a name meet once, and what no caller reads is not worked out.
    return counted.filter("name IS NOT NULL").groupBy("name").agg(
        F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), "seen")).alias("entity_type"),
        F.sum("_new").alias("n_records"), F.min("created_at").alias("created_at"),
    )


def canonical(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Undirected key: the smaller end first. Self-loops drop out."""
    return df.filter(F.col(src) != F.col(tgt)).withColumns(
        {"src": F.least(src, tgt), "tgt": F.greatest(src, tgt)}
    )


def merge_relations(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One edge per unordered pair: weights added up, keywords split, distinct and sorted."""
    rows = canonical(records).select("src", "tgt", "weight", "keywords", F.lit(1).alias("_new"))
    if stored is not None:
        hit = rows.select("src", "tgt").distinct()
        old = canonical(stored).join(hit, ["src", "tgt"], "left_semi")
        rows = rows.unionByName(old.select("src", "tgt", F.coalesce("weight", F.lit(1.0)).alias("weight"), "keywords", F.lit(0).alias("_new")))
    # Equal keyword strings combine first, so an edge gathers each of them once.
    base = rows.groupBy("src", "tgt", "keywords").agg(F.sum("weight").alias("weight"), F.sum("_new").alias("_new"))
    merged = base.groupBy("src", "tgt").agg(
        F.sum("weight").alias("weight"), F.sum("_new").alias("n_records"), F.collect_list("keywords").alias("_k")
    )
    words = F.flatten(F.transform("_k", lambda k: split_markers(k, f"{SEP}|,")))
    return merged.select("src", "tgt", "weight", "n_records", F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("keywords"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are no nodes yet, as UNKNOWN nodes."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("name")).distinct()
    return ends.join(nodes.select("name"), "name", "left_anti").withColumn("entity_type", F.lit(UNKNOWN))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    node_sources: DataFrame
    edge_sources: DataFrame
    node_texts: DataFrame
    edge_texts: DataFrame


def build_graph(entities: DataFrame, relations: DataFrame, stored: Graph | None = None) -> Graph:
    """Merge entity and relation records, on top of the stored elements they touch if given.

    The result holds the touched elements whole, with stored sources and texts among the new ones, so it
    can replace what is stored of them. Ends without an entity record become UNKNOWN nodes with the
    sources and texts of their edges.
    """
    relations = canonical(relations)
    nodes = merge_entities(entities, stored.nodes if stored else None)
    edges = merge_relations(relations, stored.edges if stored else None)
    known = nodes if stored is None else nodes.select("name").unionByName(stored.nodes.select("name"))
    unknown = missing_endpoints(relations, known)  # the edges have the same ends, and are not merged for them
    nodes = nodes.unionByName(unknown, allowMissingColumns=True)
    edge_sources, edge_texts = sources_of(relations, ["src", "tgt"]), texts_of(relations, ["src", "tgt"])

    def lent(table):
        ends = table.withColumn("name", F.explode(F.array("src", "tgt"))).drop("src", "tgt")
        return ends.join(unknown.select("name"), "name", "left_semi")

    lent_texts = lent(edge_texts).groupBy("name", "description").agg(F.min("seen").alias("seen"))
    lent_sources = lent(edge_sources).groupBy("name", "source_id").agg(F.min("file_path").alias("file_path"))
    node_sources = sources_of(entities, ["name"]).unionByName(lent_sources)
    node_texts = texts_of(entities, ["name"]).unionByName(lent_texts)
    if stored is not None:
        names, pairs = nodes.select("name"), edges.select("src", "tgt")
        node_sources = _with_stored(node_sources, stored.node_sources, names, "source_id", "file_path")
        node_texts = _with_stored(node_texts, stored.node_texts, names, "description", "seen")
        edge_sources = _with_stored(edge_sources, stored.edge_sources, pairs, "source_id", "file_path")
        edge_texts = _with_stored(edge_texts, stored.edge_texts, pairs, "description", "seen")
    return Graph(nodes, edges, node_sources, edge_sources, node_texts, edge_texts)


def _with_stored(new: DataFrame, old: DataFrame, touched: DataFrame, value: str, first: str) -> DataFrame:
    """Rows of ``new`` and those stored of the touched elements, each value once with its least ``first``."""
    keys = touched.columns
    kept = old.join(touched.distinct(), keys, "left_semi")
    both = new.select(*keys, value, first).unionByName(kept.select(*keys, value, first))
    return both.groupBy(*keys, value).agg(F.min(first).alias(first))


def document_index(graph: Graph, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which entities and relations every document speaks of: (doc_id, name), (doc_id, src, tgt)."""
    owner = chunks.select(F.col("chunk_id").alias("source_id"), "doc_id")
    entities = graph.node_sources.join(owner, "source_id").select("doc_id", "name").distinct()
    relations = graph.edge_sources.join(owner, "source_id").select("doc_id", "src", "tgt").distinct()
    return entities, relations


# ---- descriptions -----------------------------------------------------------------------


def concatenate(texts: list[str]) -> str:
    return SEP.join(texts)


def summarise(
    texts: DataFrame, keys: list[str], reduce: Callable[[list[str]], str] = concatenate,
    group_tokens: int = GROUP_TOKENS, max_rounds: int = 48, segment: int | None = SEGMENT,
) -> DataFrame:
    """One description per key: (keys, description, fragments, reduced).

    Few and short fragments are joined. Longer lists are cut into neighbouring groups of at least
    two fragments and at most ``group_tokens`` tokens; ``reduce`` makes one text of each group,
    and the list, at most about half as long, goes round again. Every list is also cut after each
    ``segment`` fragments, so a hub is summarised by many tasks and only its last, short list meets
    in one place; ``segment=None`` groups each list as a whole. A list that does not become short
    enough in ``max_rounds`` raises.
    """
    from .scale import cut_lineage

    rows = ordered_texts(texts, keys).select(*keys, "ordinal", "description", F.lit(False).alias("reduced"))
    done = None
    for _ in range(max_rounds):
        sized = rows.withColumn("_n", token_count(F.col("description")))
        totals = sized.groupBy(*keys).agg(
            F.sum("_n").alias("_tokens"), F.count(F.lit(1)).alias("_count"), F.max("reduced").alias("_was")
        )
        small = (F.col("_tokens") <= group_tokens) | (F.col("_count") <= 2)
        last = sized.join(totals.filter(small), keys)
        finished = _reduce_last(last, keys, reduce)
        done = finished if done is None else done.unionByName(finished)
        open_rows = sized.join(totals.filter(~small).select(*keys), keys, "left_semi")
        rows = cut_lineage(_reduce_groups(open_rows, keys, reduce, group_tokens, segment))
        if rows.isEmpty():
            return done
    raise RuntimeError(f"descriptions did not become short enough in {max_rounds} rounds; is ``reduce`` shortening them?")


def _reduce_last(rows: DataFrame, keys: list[str], reduce) -> DataFrame:
    listed = rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "description"))), lambda r: r["description"]).alias("_l"),
        F.sum("_n").alias("_tokens"), F.max("_was").alias("_was"),
    )
    plain = (F.size("_l") == 1) | ((F.size("_l") < JOIN_FRAGMENTS) & (F.col("_tokens") < JOIN_TOKENS))

    @F.pandas_udf("string")
    def shorten(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else reduce(list(x)))

    short = shorten(F.when(~plain, F.col("_l")))
    return listed.select(
        *keys, F.when(plain, F.array_join("_l", SEP)).otherwise(short).alias("description"),
        F.size("_l").alias("fragments"), (F.col("_was") | ~plain).alias("reduced"),
    )


def group_bounds(sizes: np.ndarray, limit: int) -> list[int]:
    """Where neighbouring groups begin, and the end: as many as fit into ``limit``, two at least."""
    upto = np.append(0, np.cumsum(sizes))
    bounds = [0]
    while bounds[-1] < len(sizes):
        first = bounds[-1]
        fitting = int(np.searchsorted(upto, upto[first] + limit, "right")) - 1
        bounds.append(min(len(sizes), max(fitting, first + 2)))
    return bounds


def _reduce_groups(rows: DataFrame, keys: list[str], reduce, limit: int, segment: int | None) -> DataFrame:
    """Groups of neighbours inside segments of a key, each reduced to one row."""
    cut = F.floor((F.col("ordinal") - 1) / segment) if segment else F.lit(0)
    cut_rows = rows.withColumn("_seg", cut)
    schema = cut_rows.select(*keys, "ordinal", "description", "reduced").schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        bounds = group_bounds(pdf["_n"].to_numpy(), limit)
        texts = pdf["description"].tolist()
        out = pdf.iloc[bounds[:-1]][[*keys, "ordinal"]].copy()
        out["description"] = [texts[a] if b - a == 1 else reduce(texts[a:b]) for a, b in zip(bounds, bounds[1:])]
        out["reduced"] = True
        return out

    coarse = F.floor(F.col("_o") / segment) if segment else F.lit(0)
    merged = cut_rows.groupBy(*keys, "_seg").applyInPandas(run, schema)
    return rank_in_groups(
        merged.withColumnRenamed("ordinal", "_o"), keys, [F.col("_o").asc()], coarse, "ordinal"
    ).drop("_o")


def bounded_paths(paths: DataFrame, keys: list[str], limit: int = PATH_BYTES) -> DataFrame:
    """Longest-first-seen list of distinct paths below a byte limit: (keys, file_path, n_paths).

    ``paths`` (keys, path, position). A path that does not fit is skipped, later ones may fit.
    Among paths of one byte length only the first ``limit / (length + separator)`` can ever be
    taken, so the list per key is bounded before it is folded.
    """
    first = paths.filter(F.col("path") != "").groupBy(*keys, "path").agg(F.min("position").alias("position"))
    sized = first.withColumn("_b", F.octet_length("path"))
    glue = len(SEP)
    possible = top_per_key(sized, [*keys, "_b"], [F.col("position").asc(), F.col("path").asc()], limit // (glue + 1) + 1, "_i")
    possible = possible.filter(F.col("_i") <= F.floor(F.lit(limit) / (F.col("_b") + glue)) + 1)
    listed = possible.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "path", "_b"))).alias("_p"))

    def step(acc, p):
        cost = p["_b"] + F.when(acc["n"] > 0, glue).otherwise(0)
        fits = acc["bytes"] + cost < limit
        return F.struct(
            (acc["bytes"] + F.when(fits, cost).otherwise(0)).alias("bytes"), (acc["n"] + fits.cast("int")).alias("n"),
            F.when(fits, F.concat(acc["out"], F.array(p["path"]))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    folded = listed.select(*keys, F.aggregate("_p", start, step).alias("_f"))
    return folded.select(*keys, F.array_join("_f.out", SEP).alias("file_path"), F.col("_f.n").alias("n_paths"))


# ---- evidence, grounding, supersession --------------------------------------------------


def grounded(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations whose ends and whose keyword or description stand in the document's text.

    A text is read once for all that its relations name.
    """
    named = ("src", "tgt", "keywords", "description")
    wanted = relations.select("doc_id", F.explode(F.array(*named, F.lit(CAUSE_WORD))).alias("mark"))
    there = cut_lineage(marks_in_own_texts(docs, wanted))
    r = relations.join(docs.select("doc_id"), "doc_id")
    for column in named:
        mine = there.select("doc_id", F.col("mark").alias(column), F.lit(True).alias(f"_{column}"))
        r = r.join(mine, ["doc_id", column], "left")
    caused = there.filter(F.col("mark") == CAUSE_WORD).select("doc_id", F.lit(True).alias("_cause"))
    r = r.join(caused, "doc_id", "left")

    def end(c):
        own = F.col("doc_id").cast("string")
        return F.col(f"_{c}") & ~F.col(c).isin("") & (F.col(c) != F.concat(own, F.lit("-a"))) & (F.col(c) != F.concat(own, F.lit("-b")))

    cause = ~F.contains("keywords", F.lit(CAUSE_WORD)) | F.coalesce("_cause", F.lit(False))
    said = F.coalesce(F.col("_keywords"), F.lit(False)) | (F.coalesce(F.col("_description"), F.lit(False)) & (F.length("description") >= 2))
    return r.filter(end("src") & end("tgt") & cause & said).select(relations.columns)


def merge_evidence(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Append new sources once; source and document stay one row: (keys, source_id, doc_id)."""
    fresh = incoming.groupBy(*keys, "source_id").agg(F.min("doc_id").alias("doc_id"))
    return stored.select(*keys, "source_id", "doc_id").unionByName(
        fresh.join(stored.select(*keys, "source_id"), [*keys, "source_id"], "left_anti")
    )


def supersede(relations: DataFrame) -> DataFrame:
    """Current and superseded edges of relations arriving in order of ``position``.

    For a source and relation type every relation to a new target closes the edges to all other
    targets; ``superseded_by`` names the last relation that closed an edge. Only aggregates: the
    last relation and the last relation to any other target decide.
    """
    key = ["src", "relation_type"]
    per_target = relations.groupBy(*key, "tgt").agg(
        F.min("position").alias("first_at"), F.max(F.struct("position", "relation_id")).alias("last")
    )
    newest = per_target.groupBy(*key).agg(F.max(F.struct("last", "tgt")).alias("_top"))
    joined = per_target.join(newest, key)
    others = (
        joined.filter(F.col("tgt") != F.col("_top.tgt")).groupBy(*key).agg(F.max("last").alias("_second"))
    )
    joined = joined.join(others, key, "left")
    is_top = F.col("tgt") == F.col("_top.tgt")
    closer = F.when(~is_top, F.col("_top.last")).when(F.col("_second.position") > F.col("first_at"), F.col("_second"))
    return joined.select(
        *key, "tgt", F.col("last.relation_id").alias("relation_id"),
        F.when(closer.isNull(), "active").otherwise("superseded").alias("status"),
        closer["relation_id"].alias("superseded_by"),
    )


# ---- edits ------------------------------------------------------------------------------


def rename_nodes(names: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace names by their merge target; ``mapping`` (source, target)."""
    m = mapping.select(F.col("source").alias(column), F.col("target").alias("_to"))
    return names.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def merge_nodes(nodes: DataFrame, mapping: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """Merge nodes by a mapping; ``position`` orders the nodes of one target.

    Strategies per column: keep_first, keep_last, max. Long values (sources, descriptions) live in
    their own tables and merge there by renaming and ``distinct``.
    """
    moved = rename_nodes(nodes, mapping, "name")
    pick = {"keep_first": F.min_by, "keep_last": F.max_by}
    out = []
    for column, how in strategies.items():
        given = F.col(column).isNotNull() & (F.col(column).cast("string") != "")
        if how == "max":
            out.append(F.max(column).alias(column))
        else:
            out.append(pick[how](column, F.when(given, F.col("position"))).alias(column))
    return moved.groupBy("name").agg(*out, F.count(F.lit(1)).alias("n_merged"))


def rewire_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Point edges at merge targets, drop self-loops, merge parallels with the highest weight."""
    moved = canonical(rename_nodes(rename_nodes(edges, mapping, "src"), mapping, "tgt"))
    return moved.groupBy("src", "tgt").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_merged"))


def edit_nodes(nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of edits; (new nodes, rejected edits with the reason).

    ``changes`` (name, new_name, entity_type, description) with NULL for "unchanged". An edit of
    a missing node and a rename to a name that is taken are rejected.
    """
    have = nodes.select(F.col("name").alias("_have"))
    checked = (
        changes.join(have, F.col("name") == F.col("_have"), "left").withColumnRenamed("_have", "_old")
        .join(have, F.col("new_name") == F.col("_have"), "left")
    )
    renamed = F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name"))
    reason = F.when(F.col("_old").isNull(), "missing").when(renamed & F.col("_have").isNotNull(), "taken")
    checked = checked.withColumn("reason", reason).drop("_old", "_have")
    good = checked.filter("reason IS NULL").drop("reason")
    c = good.select("name", F.col("new_name"), F.col("entity_type").alias("_t"), F.col("description").alias("_d"))
    edited = nodes.join(c, "name", "left").select(
        F.coalesce("new_name", "name").alias("name"), F.coalesce("_t", "entity_type").alias("entity_type"),
        F.coalesce("_d", "description").alias("description"),
    )
    return edited, checked.filter("reason IS NOT NULL")


def create_elements(new: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split new elements into creatable and already existing ones."""
    known = existing.select(*keys).distinct()
    return new.join(known, keys, "left_anti"), new.join(known, keys, "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every edge at them."""
    gone = names.select("name").distinct()
    left = edges.join(gone.withColumnRenamed("name", "src"), "src", "left_anti")
    left = left.join(gone.withColumnRenamed("name", "tgt"), "tgt", "left_anti")
    return nodes.join(gone, "name", "left_anti"), left


def delete_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(canonical(pairs).select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")


def deletion_impact(sources: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """What losing chunks means per element: delete, rebuild or keep; (keys, action, remaining)."""
    hit = removed.select(F.col("chunk_id").alias("source_id"), F.lit(1).alias("_hit")).distinct()
    counted = sources.join(hit, "source_id", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_lost")
    )
    action = F.when(F.col("_lost") == F.col("_n"), "delete").when(F.col("_lost") > 0, "rebuild").otherwise("keep")
    return counted.select(*keys, action.alias("action"), (F.col("_n") - F.col("_lost")).alias("remaining"))


def rebuild(entities: DataFrame, relations: DataFrame, graph: Graph, removed: DataFrame) -> Graph:
    """Rebuild what loses chunks from the records of the chunks that remain.

    ``entities`` / ``relations`` are the cached records of all chunks. A node whose entity records
    are all gone falls back to its stored type and the texts of its edges.
    """
    gone = removed.select("chunk_id").distinct()
    node_work = deletion_impact(graph.node_sources, removed, ["name"]).filter("action = 'rebuild'").select("name")
    edge_work = deletion_impact(graph.edge_sources, removed, ["src", "tgt"]).filter("action = 'rebuild'").select("src", "tgt")
    kept_e = entities.join(gone, "chunk_id", "left_anti").join(node_work, "name", "left_semi")
    kept_r = canonical(relations).join(gone, "chunk_id", "left_anti").join(edge_work, ["src", "tgt"], "left_semi")
    nodes, edges = merge_entities(kept_e), merge_relations(kept_r)
    bare = node_work.join(nodes.select("name"), "name", "left_anti")
    nodes = nodes.unionByName(
        graph.nodes.join(bare, "name", "left_semi").select("name", "entity_type"), allowMissingColumns=True
    )
    ends = texts_of(canonical(relations).join(gone, "chunk_id", "left_anti"), ["src", "tgt"])
    lent = ends.withColumn("name", F.explode(F.array("src", "tgt"))).join(bare, "name", "left_semi")
    lent = lent.groupBy("name", "description").agg(F.min("seen").alias("seen"))
    return Graph(
        nodes, edges, sources_of(kept_e, ["name"]), sources_of(kept_r, ["src", "tgt"]),
        texts_of(kept_e, ["name"]).unionByName(lent), texts_of(kept_r, ["src", "tgt"]),
    )
