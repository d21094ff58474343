"""Queries over the property graph: lookups, neighbourhoods, expansion, PageRank, retrieval.

``nodes`` (name, …), ``edges`` (src, tgt, …) with one row per unordered pair. Joins that meet a
hub are salted; iterations cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import names_in_texts
from .pagerank import STEPS, pagerank
from .scale import cut_lineage, discard, salted_join, top_per_key, written

# Fixed values.
DECAY, HOPS = 0.72, 2
SEED_COSINE, SEED_LABEL_SCORE, SEED_LIMIT = 0.5, 0.8, 8
GRAPH_RANK = 0.85
SALTS = 8


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Every edge from both of its ends: (node, other, *keep). One scan, no shuffle."""
    ends = F.explode(
        F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")), F.struct(F.col("tgt").alias("node"), F.col("src").alias("other")))
    )
    return edges.select(ends.alias("_e"), *keep).select("_e.node", "_e.other", *keep)


def incident_edges(edges: DataFrame, names: DataFrame, *keep: str) -> DataFrame:
    return both_ways(edges, *keep).join(names.select(F.col("name").alias("node")).distinct(), "node", "left_semi")


def exists(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Flag for every wanted key whether it is stored."""
    known = stored.select(*keys).distinct().withColumn("_k", F.lit(True))
    return wanted.join(known, keys, "left").withColumn("present", F.col("_k").isNotNull()).drop("_k")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, isolated ones included. Counts combine before the shuffle."""
    counted = both_ways(edges).groupBy(F.col("node").alias("name")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("name").join(counted, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def edge_degrees(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """Sum of the degrees of both ends. A hub's edges are spread over several tasks."""
    d = degree.select("name", "degree")
    a = salted_join(edges, d.toDF("src", "_a"), ["src"], ["tgt"], "left", SALTS)
    b = salted_join(a, d.toDF("tgt", "_b"), ["tgt"], ["src"], "left", SALTS)
    return b.withColumn("edge_degree", F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).drop("_a", "_b")


def touching_chunks(sources: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with at least one source among the given chunks."""
    wanted = chunks.select(F.col("chunk_id").alias("source_id")).distinct()
    return sources.join(wanted, "source_id", "left_semi").select(*keys).distinct()


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    k = kept.select("name").distinct()
    first = edges.join(k.withColumnRenamed("name", "src"), "src", "left_semi")
    return first.join(k.withColumnRenamed("name", "tgt"), "tgt", "left_semi")


def top_by_degree(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` best connected nodes and the edges among them."""
    best = degrees(nodes, edges).orderBy(F.col("degree").desc(), "name").limit(limit)
    return best, induced(edges, best)


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Hop distance of every node within ``depth`` of the starts: (start, name, hop)."""
    adjacent = both_ways(edges).distinct()
    found = starts.select(F.col("name").alias("start"), "name", F.lit(0).alias("hop")).distinct()
    frontier = found
    for hop in range(1, depth + 1):
        step = (
            salted_join(adjacent, frontier.select("start", F.col("name").alias("node")), ["node"], ["other"], salts=SALTS)
            .select("start", F.col("other").alias("name")).distinct()
        )
        frontier = cut_lineage(step.join(found.select("start", "name"), ["start", "name"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def bounded_neighbourhood(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int, limit: int) -> DataFrame:
    """Breadth-first subgraph nodes: levels in order, high degree first inside a level, at most
    ``limit``; (name, hop, degree, position, truncated)."""
    hops = reachable(edges, start, depth).groupBy("name").agg(F.min("hop").alias("hop"))
    ranked = hops.join(degrees(nodes, edges), "name")
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))  # one row
    order = [F.col("hop").asc(), F.col("degree").desc(), F.col("name").asc()]
    kept = ranked.orderBy(*order).limit(limit)
    numbered = kept.withColumn("position", F.row_number().over(W.orderBy(*order)))  # at most ``limit`` rows
    return numbered.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("_n") > limit).drop("_n")


def pick_center(nodes: DataFrame, edges: DataFrame, wanted: str) -> DataFrame:
    """The node meant by a name: exact id, else exact label, else partial; the best connected."""
    n = nodes if "label" in nodes.columns else nodes.withColumn("label", F.col("name"))
    low, text = F.lower("label"), wanted.lower()
    fit = F.when(F.col("name") == wanted, 0).when(low == text, 1).when(F.contains(low, F.lit(text)), 2)
    ranked = n.withColumn("_fit", fit).filter("_fit IS NOT NULL").join(degrees(nodes, edges), "name")
    return ranked.orderBy("_fit", F.col("degree").desc(), "name").limit(1).select("name")


def overview(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, limit: int) -> DataFrame:
    """Best connected nodes (then by mentions and name) that are linked among themselves."""
    d = degrees(nodes, edges).filter("degree > 0").join(mentions.select("name", "mentions"), "name", "left")
    d = d.withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    top = d.orderBy(F.col("degree").desc(), F.col("mentions").desc(), F.col("name").desc()).limit(limit)
    linked = induced(edges, top).select(F.explode(F.array("src", "tgt")).alias("name")).distinct()
    return top.join(linked, "name", "left_semi")


def neighbours(edges: DataFrame, names: DataFrame, limit: int, *keep: str) -> DataFrame:
    """Neighbours of the given nodes, at most ``limit`` each, heaviest first."""
    around = incident_edges(edges, names, "weight", *keep)
    return top_per_key(around, ["node"], [F.col("weight").desc(), F.col("other").asc()], limit)


def entity_list(nodes: DataFrame, sources: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """Nodes with the number of distinct chunks that mention them, filtered by type and text."""
    freq = sources.groupBy("name").agg(F.countDistinct("source_id").alias("frequency"))
    rows = nodes.join(freq, "name", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    if kind is not None:
        rows = rows.filter(F.col("entity_type") == kind)
    needle = text.strip().lower()
    return rows.filter(F.contains(F.lower("name"), F.lit(needle))) if needle else rows


def relation_list(edges: DataFrame, scope: DataFrame, text: str = "", label: str = "") -> DataFrame:
    """Edges inside a scope by name part and label."""
    from kgspark.functions.text import relation_labels

    rows = induced(edges, scope).withColumn("labels", relation_labels(F.col("keywords")))
    needle = text.strip().lower()
    if needle:
        rows = rows.filter(F.contains(F.lower("src"), F.lit(needle)) | F.contains(F.lower("tgt"), F.lit(needle)))
    if label:
        rows = rows.filter(F.array_contains("labels", label) | F.contains("keywords", F.lit(label)))
    return rows


# ---- expansion --------------------------------------------------------------------------


def expand_paths(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, decay: float = DECAY) -> DataFrame:
    """Expand seeds along simple paths; (query_id, name, hop, score, path).

    ``seeds`` (query_id, name, seed_score, position), ``edges`` (src, tgt, label). A node is taken
    by the first arrival of a breadth-first queue: fewest hops, then the order of the seed and of
    the neighbours (by name) along the path. The seed's score decays per hop.
    """
    adjacent = written(both_ways(edges, "label"))  # every hop reads it
    # Position along the path as one comparable array.
    place = F.array(F.struct(F.col("position").cast("long").alias("p"), F.lit("").alias("n")))
    frontier = seeds.filter(F.col("name").cast("string") != "").select(
        "query_id", "name", F.lit(0).alias("hop"), F.col("seed_score"), F.array(F.col("name").cast("string")).alias("path"),
        F.array("name").alias("seen"), place.alias("place"),
    )
    frontier = _first(frontier)
    found = frontier
    for hop in range(1, hops + 1):
        arrivals = salted_join(
            adjacent, frontier.withColumnRenamed("name", "node"), ["node"], ["other"], salts=SALTS
        ).filter(~F.array_contains("seen", F.col("other"))).select(
            "query_id", F.col("other").alias("name"), F.lit(hop).alias("hop"), "seed_score",
            F.concat("path", F.array(F.when(F.col("label") == "", "相关").otherwise(F.col("label")), F.col("other").cast("string"))).alias("path"),
            F.concat("seen", F.array("other")).alias("seen"),
            F.concat("place", F.array(F.struct(F.lit(0).cast("long").alias("p"), F.col("other").cast("string").alias("n")))).alias("place"),
        )
        fresh = _first(arrivals).join(found.select("query_id", "name"), ["query_id", "name"], "left_anti")
        frontier = written(fresh)  # in columns: names repeat along paths
        found = found.unionByName(frontier)
    discard(adjacent)
    return found.select("query_id", "name", "hop", (F.col("seed_score") * F.pow(F.lit(decay), F.col("hop"))).alias("score"), "path")


def _first(rows: DataFrame) -> DataFrame:
    """First arrival per query and node; a reduction that combines before the shuffle."""
    columns = [c for c in rows.columns if c not in ("query_id", "name")]
    best = rows.groupBy("query_id", "name").agg(F.min_by(F.struct(*columns), "place").alias("_b"))
    return best.select("query_id", "name", *[F.col(f"_b.{c}").alias(c) for c in columns])


def pagerank_retrieval(edges: DataFrame, nodes: DataFrame, hits: DataFrame, top_k: int, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Rank nodes and relations by PageRank from entity hits (query_id, name, score)."""
    scores = written(pagerank(edges, hits.select("query_id", "name", F.col("score").alias("weight")), steps=steps))
    order = [F.round("score", 12).desc(), F.col("name").asc()]
    # Written, so that its few rows travel to the edges and not the edges to them.
    best = written(top_per_key(scores, ["query_id"], order, top_k).join(nodes, "name"))
    ends = both_ways(edges.withColumn("_w", F.coalesce("weight", F.lit(1.0))), "src", "tgt", "_w")
    touched = ends.join(best.select("query_id", F.col("name").alias("node")), "node").select("query_id", "src", "tgt", F.col("_w").alias("weight")).distinct()
    s = scores.select("query_id", "name", F.col("score").alias("_s"))
    ranked = (
        touched.join(s.withColumnsRenamed({"name": "src", "_s": "_a"}), ["query_id", "src"], "left")
        .join(s.withColumnsRenamed({"name": "tgt", "_s": "_b"}), ["query_id", "tgt"], "left")
        .withColumn("score", F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).drop("_a", "_b")
    )
    order = [F.round("score", 12).desc(), F.col("src").asc(), F.col("tgt").asc()]
    return best, top_per_key(ranked, ["query_id"], order, max(top_k * 2, top_k))


def label_seeds(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Nodes whose label stands in the query, longest label only: (query_id, name, score).

    All labels are looked for in one pass over a query, whatever their lengths.
    """
    labelled = nodes.filter(F.length("label") >= 2).select("name", "label")
    hits = names_in_texts(queries, labelled, "query_id").withColumn("_n", F.length("label"))
    longest = hits.groupBy("query_id").agg(F.max("_n").alias("_n"))
    best = hits.join(longest, ["query_id", "_n"]).join(labelled, "label").select("query_id", "name").distinct()
    return best.select("query_id", "name", F.lit(SEED_LABEL_SCORE).alias("score"))


def seeds(vector_hits: DataFrame, nodes: DataFrame, queries: DataFrame, limit: int = SEED_LIMIT) -> DataFrame:
    """Entry nodes: close vectors whose label the query does not name, and the longest named label.

    (query_id, name, seed_score, cosine, position); ``vector_hits`` (query_id, name, score).
    """
    close = (
        vector_hits.filter(F.col("score") >= SEED_COSINE).join(nodes.select("name", "label"), "name")
        .join(queries.select("query_id", "text"), "query_id")
        .filter((F.col("label") == "") | ~F.contains("text", F.col("label")))
    )
    close = top_per_key(close, ["query_id"], [F.col("score").desc(), F.col("name").asc()], limit)
    a = close.select("query_id", "name", F.col("score").alias("c"), F.lit(None).cast("double").alias("l"))
    b = label_seeds(nodes, queries).select("query_id", "name", F.lit(None).cast("double").alias("c"), F.col("score").alias("l"))
    both = a.unionByName(b).groupBy("query_id", "name").agg(F.max("c").alias("c"), F.max("l").alias("l"))
    scored = both.select("query_id", "name", F.greatest("c", "l").alias("seed_score"), F.coalesce("c", F.lit(0.0)).alias("cosine"), F.col("l").isNotNull().alias("named"))
    order = W.partitionBy("query_id").orderBy("named", F.col("cosine").desc(), "name")
    return scored.withColumn("position", F.row_number().over(order))


def graph_hits(
    seed: DataFrame, edges: DataFrame, sources: DataFrame, queries: DataFrame, labels: DataFrame, limit: int
) -> DataFrame:
    """Chunks reached from the seeds over at most two hops: (query_id, chunk_id, hop, path, score…).

    ``edges`` (src, tgt, label) hold only what is valid and in scope. A chunk keeps its first
    path; when it is reached again over more hops the longer path replaces it.
    """
    paths = expand_paths(seed, edges)
    order = [F.round("score", 9).desc(), F.col("hop").asc(), F.col("name").asc()]
    kept = top_per_key(paths, ["query_id"], order, max(limit * 3, limit), "path_rank")
    origin = seed.select("query_id", F.col("name").cast("string").alias("_o"), "cosine")
    kept = kept.withColumn("_o", F.get("path", F.lit(0))).join(origin, ["query_id", "_o"])
    named = labels.select(F.col("name"), "label")
    kept = kept.join(named, "name", "left").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    seed_label = named.select(F.col("name").cast("string").alias("_o"), F.col("label").alias("_ol"))
    kept = kept.join(seed_label, "_o", "left")
    hit = (F.col("label") != "") & F.contains("_q", F.col("label")) | (F.col("_ol") != "") & F.contains("_q", F.col("_ol"))
    kept = kept.withColumn("keyword_score", F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0))
    kept = kept.filter((F.col("cosine") > 0) | (F.col("keyword_score") > 0))
    reached = sources.join(kept, "name").select(
        "query_id", F.col("source_id").alias("chunk_id"), "path_rank", "hop", "score", "cosine", "keyword_score",
        F.array_join("path", " → ").alias("path"),
    )
    first = reached.groupBy("query_id", "chunk_id").agg(
        F.min_by(F.struct("score", "cosine", "keyword_score"), "path_rank").alias("f"),
        # more hops win, of equal hops the earlier path
        F.max_by(F.struct("hop", "path", "score"), F.struct("hop", (-F.col("path_rank")).alias("r"))).alias("l"),
        F.min("path_rank").alias("path_rank"),
    )
    rows = first.select(
        "query_id", "chunk_id", F.col("l.hop").alias("hop"), F.col("l.path").alias("path"), F.col("f.score").alias("score"),
        F.col("f.cosine").alias("vector_score"), F.col("f.keyword_score").alias("keyword_score"),
        (F.col("l.score") * GRAPH_RANK).alias("ranking_score"), "path_rank",
    )
    return top_per_key(rows, ["query_id"], [F.col("path_rank").asc(), F.col("chunk_id").asc()], limit * 2)


def local_retrieval(entity_hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity hits with their degree, and their edges by (edge degree, weight)."""
    degree = degrees(nodes, edges)
    found = entity_hits.join(degree, "name")
    mine = both_ways(edges, "src", "tgt", "weight").join(
        entity_hits.select("query_id", F.col("name").alias("node")), "node"
    ).select("query_id", "src", "tgt", "weight").distinct()
    return found, edge_degrees(mine, degree)


def global_retrieval(relation_hits: DataFrame) -> DataFrame:
    """End nodes of ranked relations in first-seen order: (query_id, name, position)."""
    ends = relation_hits.select("query_id", "rank", F.posexplode(F.array("src", "tgt")).alias("_i", "name"))
    first = ends.groupBy("query_id", "name").agg(F.min(F.struct("rank", "_i")).alias("_at"))
    order = W.partitionBy("query_id").orderBy("_at")
    return first.select("query_id", "name", F.row_number().over(order).alias("position"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """Nodes per entity type."""
    kind = F.coalesce(F.col("entity_type"), F.lit("未知")).alias("entity_type")
    return nodes.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
