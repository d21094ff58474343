"""Composite jobs: expected documents, search modes, staged search, KG query modes, ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import query_route, squash, subquestions, token_count
from kgspark.operators import evaluation as E
from kgspark.operators import fusion as R
from kgspark.operators import graph_query as N
from kgspark.operators import lexical as L
from kgspark.operators import vectors as V
from kgspark.operators.lexical import by_score
from kgspark.operators.names import names_in_texts
from kgspark.operators.scale import cut_lineage, rank_in_groups, top_per_key, written


def containing(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents whose text contains a mark: (query_id, doc_id). All marks are looked for in one pass over a text."""
    found = names_in_texts(docs, marks, name="mark")
    return found.join(marks.select("query_id", "mark"), "mark").select("query_id", "doc_id").distinct()


# ---- search modes -----------------------------------------------------------------------

MODES = ("vector", "keyword", "hybrid", "tree", "graph", "mix")


class TextIndex:
    """Documents prepared for retrieval: text, ownership, sparse vectors.

    ``docs`` (doc_id, text, kb_id, owner_id). The sparse vectors are written once per index, when first used.
    """

    def __init__(self, docs: DataFrame, scope: list[str] | None = None):
        self.docs, self.scope = docs, scope or []
        self._vectors = None

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = written(V.hashed_embedding(self.docs, "doc_id", keep=self.scope))
        return self._vectors

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        asked = V.hashed_embedding(queries, "query_id", keep=self.scope)
        hits = V.sparse_hits(self.vectors, asked, k, scope=self.scope)
        return hits.select("query_id", "doc_id", "rank", "score", "raw_score", "vector_score")

    def cosines(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """Cosine of each (query_id, doc_id) of ``pairs``; pairs without a common slot are absent."""
        asked = V.hashed_embedding(queries, "query_id").select("query_id", "slot", F.col("w").alias("_qw"))
        mine = pairs.select("query_id", "doc_id").join(self.vectors.select("doc_id", "slot", "w"), "doc_id")
        return mine.join(asked, ["query_id", "slot"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("_qw")).alias("cosine"))

    def lexical(self, queries: DataFrame, k: int) -> DataFrame:
        hits = L.keyword_hits(self.docs.select("doc_id", "text", *self.scope), queries, k, self.scope)
        return hits.select("query_id", "doc_id", "rank", "score", "raw_score", "keyword_score")


def mix_hits(
    index: TextIndex, queries: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, k: int
) -> DataFrame:
    """Hits of a mixed question to the knowledge graph: (query_id, doc_id, score, vector_score, keyword_score).

    ``chunks`` (query_id, rank, chunk_id) as ``kg_query`` gives them are scored by cosine, or by keywords
    where they have none in common. Entities (query_id, name, score) and relations (query_id, src, tgt,
    score) compete for places with their own cosine, but belong to no document.
    """
    first = chunks.filter(F.col("rank") <= k).select("query_id", F.col("chunk_id").alias("doc_id"))
    texts = first.join(index.docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = texts.join(index.cosines(first, queries), ["query_id", "doc_id"], "left")
    keyword = L.calibrate_bm25(L.single_bm25(F.col("_q"), F.col("text")))
    cosine = F.when(F.col("cosine").isNotNull(), L.calibrate_cosine(F.col("cosine")))
    scored = scored.select("query_id", "doc_id", cosine.alias("vector_score"), keyword.alias("keyword_score"))
    fallback = F.when(F.col("keyword_score") > 0, F.col("keyword_score")).otherwise(0.0)
    rows = scored.select("query_id", "doc_id", F.coalesce("vector_score", fallback).alias("score"), "vector_score", "keyword_score")
    for named in (entities, relations):
        value = L.calibrate_cosine(F.col("score"))
        rows = rows.unionByName(named.filter(F.col("score").isNotNull()).select(
            "query_id", F.lit(None).cast(index.docs.schema["doc_id"].dataType).alias("doc_id"),
            value.alias("score"), value.alias("vector_score"), F.lit(0.0).alias("keyword_score"),
        ))
    return rows


def search(
    index: TextIndex, queries: DataFrame, mode: str, top_k: int = 10, ratio: float = 0.5,
    threshold: float | None = None, scorer=None, hypothetical: DataFrame | None = None, rerank_pool: int = 50,
    found: DataFrame | None = None,
) -> DataFrame:
    """One retrieval pass for all queries: ranked, admitted, public rows.

    ``scorer`` is a column function (query text, document text) that reranks the best ``rerank_pool``.
    ``hypothetical`` (query_id, text) is the assumed answer of the tree mode. ``found`` brings what the
    modes graph (``graph_query.graph_hits``, with documents as chunks) and mix (``mix_hits``) found in
    the knowledge graph. Any other mode raises.
    """
    pool = rerank_pool if scorer else top_k
    if mode == "keyword":
        hits = index.lexical(queries, pool)
    elif mode == "hybrid":
        hits = R.weighted_fuse(index.dense(queries, pool), index.lexical(queries, pool), ratio)
        hits = top_per_key(hits, ["query_id"], by_score("score", "doc_id"), pool)
    elif mode == "tree":
        tree = R.tree_scores(index.dense(hypothetical if hypothetical is not None else queries, pool), index.dense(queries, pool))
        tree = top_per_key(tree, ["query_id"], by_score("ranking_score", "doc_id"), pool)
        hits = tree.select("query_id", "doc_id", "rank", F.col("ranking_score").alias("score"), F.col("query_cosine").alias("vector_score"))
    elif mode == "vector":
        hits = index.dense(queries, pool)
    elif mode in ("graph", "mix"):
        if found is None:
            raise ValueError(f"mode {mode!r} ranks hits of the knowledge graph; give them as ``found``")
        if mode == "graph":
            found = found.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("ranking_score").alias("score"), "vector_score", "keyword_score")
        order = [F.round("score", 9).desc(), F.col("doc_id").asc_nulls_first()]
        hits = top_per_key(found, ["query_id"], order, pool)
    else:
        raise ValueError(f"unknown search mode {mode!r}; known are {', '.join(MODES)}")
    hits = R.union_channels(hits, _no_scores(hits))
    hits = hits.join(index.docs, "doc_id", "left" if mode == "mix" else "inner")
    if scorer:
        asked = queries.select("query_id", F.col("text").alias("_q"))
        hits = hits.join(asked, "query_id").withColumn("rerank_score", scorer(F.col("_q"), F.col("text"))).drop("_q")
        hits = hits.withColumn("score", F.coalesce("rerank_score", "score"))
    admitted = R.by_threshold(R.admit(hits, mode, ratio), threshold)
    final = top_per_key(admitted.drop("rank"), ["query_id"], by_score("score", "doc_id"), top_k)
    shown = ["query_id", "rank", "doc_id", "kb_id", "owner_id", F.col("score").alias("ranking_score"), "admission_score", "vector_score", "keyword_score"]
    return R.public_hits(final.select(*shown))


def _no_scores(hits: DataFrame) -> DataFrame:
    """An empty frame that brings the score columns a channel does not fill."""
    names = ("vector_score", "keyword_score")
    return hits.limit(0).select("query_id", "doc_id", *[F.lit(None).cast("double").alias(n) for n in names])


def variants(queries: DataFrame, force: str | Column | None = None) -> DataFrame:
    """Texts to search per query: (query_id, variant, text); the query itself is variant 0."""
    q = squash(F.col("text"))
    route = query_route(F.col("text")) if force is None else F.lit(force)
    multi = F.array(q, F.concat(q, F.lit(" 相关事实")), F.concat(q, F.lit(" 关键内容")))
    texts = (
        F.when(route == "subquestions", F.concat(F.array(q), subquestions(q))).when(route == "multi", multi).otherwise(F.array(q))
    )
    rows = queries.select("query_id", F.posexplode(F.array_distinct(texts)).alias("variant", "text"))
    return rows.filter(F.col("text") != "")


def _per_variant(search_fn, texts: DataFrame, k: int) -> DataFrame:
    """Search every variant as a query of its own and give the hits back to their query."""
    asked = texts.select(F.struct("query_id", "variant").alias("query_id"), "text")
    hits = search_fn(asked, k)
    return hits.withColumn("variant", F.col("query_id.variant")).withColumn("query_id", F.col("query_id.query_id"))


def gather(index: TextIndex, texts: DataFrame, top_k: int = 5, threshold: float | None = None) -> DataFrame:
    """Search all variants by keyword and vector and keep the best score per document."""
    dense = _per_variant(index.dense, texts, top_k).withColumn("list_no", F.col("variant") * 2)
    lexical = _per_variant(index.lexical, texts, top_k).withColumn("list_no", F.col("variant") * 2 + 1)
    best = R.best_per_document(R.union_channels(dense, lexical), "list_no")
    top = top_per_key(best.drop("rank"), ["query_id"], by_score("score", "doc_id"), top_k)
    return R.by_threshold(top.select("query_id", "rank", "doc_id", "score"), threshold)


def staged(
    index: TextIndex, queries: DataFrame, mode: str = "hybrid", top_k: int = 8, ratio: float = 0.5,
    threshold: float | None = None, force: str | Column | None = None, scorer=None, parents: DataFrame | None = None,
    graph: DataFrame | None = None, use_parents: bool = True,
) -> DataFrame:
    """Staged retrieval: channels per variant, rank fusion, reranking, admission, parents.

    ``parents`` (doc_id, parent_id, parent_tokens); ``graph`` are graph hits (query_id, doc_id,
    rank, score, vector_score, keyword_score). The fused list has at most RRF_CAP rows per query.
    """
    ranked = _ranked(index, queries, mode, ratio, threshold, force, scorer, graph)
    return _chosen(ranked, R.child_limit(top_k), parents, use_parents)


def _ranked(index: TextIndex, queries: DataFrame, mode: str, ratio: float, threshold, force, scorer, graph) -> DataFrame:
    """What staged retrieval admits, in its order, with the number of tokens of each text."""
    texts = variants(queries, force)
    tag = lambda name: F.concat(F.lit(name + "-"), F.col("variant"))
    channels = []
    if mode in ("vector", "hybrid", "mix", "tree"):
        channels.append(_per_variant(index.dense, texts, R.DENSE_TOP).withColumn("channel", tag("dense")))
    if mode in ("keyword", "hybrid", "mix"):
        channels.append(_per_variant(index.lexical, texts, R.BM25_TOP).withColumn("channel", tag("bm25")))
    if mode == "hybrid":
        mixed = R.blend(R.union_channels(*channels), ratio)
        mixed = mixed.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by_score("ranking_score", "doc_id"))))
        channels.append(R.stamp(mixed, "blend"))
    if graph is not None and mode in ("graph", "mix"):
        channels.append(R.stamp(graph, "graph"))
    # The fused list feeds reranking, admission and parents: written once, a few rows per query.
    fused = cut_lineage(R.reciprocal_rank(R.union_channels(*channels))).join(index.docs, "doc_id")
    fused = fused.withColumn("ranking_score", F.col("rrf_score"))
    if scorer:
        asked = queries.select("query_id", F.col("text").alias("_q"))
        near = fused.filter(F.col("rank") <= R.RERANK_POOL).join(asked, "query_id")
        fused = near.withColumn("rerank_score", scorer(F.col("_q"), F.col("text"))).drop("_q").filter("rerank_score IS NOT NULL")
        fused = fused.withColumn("ranking_score", F.col("rerank_score"))
    admitted = R.by_threshold(R.admit(fused.withColumn("score", F.col("ranking_score")), mode, ratio), threshold)
    order = W.partitionBy("query_id").orderBy(*by_score("ranking_score", "doc_id"))
    ranked = admitted.withColumn("rank", F.row_number().over(order))
    return ranked.select("query_id", "rank", "doc_id", "ranking_score", "admission_score", "kb_id", "owner_id", token_count(F.col("text")).alias("_tokens"))


def _chosen(ranked: DataFrame, limit: int, parents: DataFrame | None, use_parents: bool) -> DataFrame:
    if not use_parents:
        return ranked.filter(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "ranking_score", "admission_score")
    if parents is None:
        ranked = ranked.withColumn("parent_id", F.lit("")).withColumn("parent_tokens", F.col("_tokens"))
    else:
        ranked = ranked.join(parents, "doc_id", "left").withColumn("parent_tokens", F.coalesce("parent_tokens", "_tokens"))
    ranked = ranked.withColumn("chunk_id", F.col("doc_id"))
    chosen = R.aggregate_parents(ranked, limit)
    return ranked.select("query_id", "rank", "doc_id", "ranking_score", "admission_score").join(
        chosen.select("query_id", "rank", "parent_id"), ["query_id", "rank"]
    )


# ---- questions to the knowledge graph ---------------------------------------------------


def kg_query(
    mode: str, queries: DataFrame, entity_hits: DataFrame, relation_hits: DataFrame, chunk_hits: DataFrame,
    nodes: DataFrame, edges: DataFrame, node_sources: DataFrame, edge_sources: DataFrame,
    max_related: int = 5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and chunks for a mode: local, global, hybrid, mix, naive or bypass.

    ``entity_hits`` (query_id, name, score, rank), ``relation_hits`` (query_id, src, tgt, rank),
    ``chunk_hits`` (query_id, chunk_id, rank). The three results are (query_id, rank, name),
    (query_id, rank, src, tgt) and (query_id, rank, chunk_id).
    """
    lists_e, lists_r, lists_c = [], [], []
    if mode in ("local", "hybrid", "mix"):
        found, around = N.local_retrieval(entity_hits.select("query_id", "name", "rank"), nodes, edges)
        order = [F.col("edge_degree").desc(), F.col("weight").desc(), F.col("src").asc(), F.col("tgt").asc()]
        around = around.drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
        lists_e.append(found.select("query_id", "name", F.col("rank").alias("pos"), F.lit(0).alias("list_no")))
        lists_r.append(around.select("query_id", "src", "tgt", F.col("rank").alias("pos"), F.lit(0).alias("list_no")))
    if mode in ("global", "hybrid", "mix"):
        ends = N.global_retrieval(relation_hits)
        lists_e.append(ends.select("query_id", "name", F.col("position").alias("pos"), F.lit(1).alias("list_no")))
        lists_r.append(relation_hits.select("query_id", "src", "tgt", F.col("rank").alias("pos"), F.lit(1).alias("list_no")))
    if mode in ("naive", "mix"):
        lists_c.append(chunk_hits.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.lit(0).alias("list_no")))
    empty = queries.limit(0)
    entities = relations = None
    if lists_e:
        entities = cut_lineage(R.round_robin(R.union_channels(*lists_e), ["query_id"], ["name"]).select("query_id", "rank", "name"))
        relations = cut_lineage(R.round_robin(R.union_channels(*lists_r), ["query_id"], ["src", "tgt"]).select("query_id", "rank", "src", "tgt"))
        mine = _owned(entities, node_sources, ["name"])
        by_entity = R.weighted_polling(R.owner_chunks(mine), _places(mine), max_related)
        lists_c.append(by_entity.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.lit(1).alias("list_no")))
        theirs = _owned(relations, edge_sources, ["src", "tgt"])
        rest = R.owner_chunks(theirs, by_entity)
        # owners that lost all their chunks to the entities give up their place
        dense = F.dense_rank().over(W.partitionBy("query_id").orderBy("owner_pos")) - 1
        rest = rest.withColumn("owner_pos", dense)
        by_relation = R.weighted_polling(rest, rest.select("query_id", "owner_pos").distinct(), max_related)
        lists_c.append(by_relation.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.lit(2).alias("list_no")))
    if not lists_c:
        none = empty.select("query_id", F.lit(0).alias("rank"))
        return none.withColumn("name", F.lit("")), none.withColumn("src", F.lit("")).withColumn("tgt", F.lit("")), none.withColumn("chunk_id", F.lit(""))
    chunks = R.round_robin(R.union_channels(*lists_c), ["query_id"], ["chunk_id"]).select("query_id", "rank", "chunk_id")
    return entities, relations, chunks


def _owned(ranked: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of ranked elements with both positions; a hub's list is numbered in segments."""
    rows = ranked.select("query_id", *keys, (F.col("rank") - 1).alias("owner_pos")).join(sources.select(*keys, "source_id"), keys)
    # Ascends with the id and differs between ids that share the usual prefix "chunk-".
    segment = F.substring(F.col("source_id").cast("string"), 1, 8)
    placed = rank_in_groups(rows, ["query_id", "owner_pos"], [F.col("source_id").cast("string").asc()], segment, "chunk_pos")
    return placed.select("query_id", "owner_pos", "chunk_pos", F.col("source_id").alias("chunk_id"))


def _places(owned: DataFrame) -> DataFrame:
    return owned.select("query_id", "owner_pos").distinct()


# ---- evaluation over variants -----------------------------------------------------------


def ablation(index: TextIndex, questions: DataFrame, expected: DataFrame, forces=("single", "multi", "subquestions"), threshold: float = 0.5) -> DataFrame:
    """Metrics of staged retrieval per query variant, with and without parents.

    All variants are searched in one pass: a question is asked once for each of them, under an id of its own.
    """
    names = F.explode(F.array(*[F.lit(f) for f in forces])).alias("_f")

    def each(rows: DataFrame) -> DataFrame:
        own = F.struct(F.col("_f").alias("variant"), "query_id").alias("query_id")
        return rows.select("*", names).select(own, *[c for c in rows.columns if c != "query_id"])

    questions, expected = cut_lineage(each(questions)), cut_lineage(each(expected))
    ranked = cut_lineage(_ranked(index, questions.select("query_id", "text"), "hybrid", 0.5, threshold, F.col("query_id.variant"), None, None))
    rows = []
    for use_parents in (True, False):
        hits = _chosen(ranked, R.child_limit(8), None, use_parents)
        placed = hits.join(ranked.select("query_id", "rank", "kb_id", "owner_id"), ["query_id", "rank"]).withColumnRenamed("doc_id", "unit_id")
        per = E.question_metrics(questions.drop("text"), expected, placed)
        rows.append(per.withColumn("variant", F.col("query_id.variant")).withColumn("parents", F.lit(use_parents)))
    return E.metrics(R.union_channels(*rows), ["variant", "parents"])
