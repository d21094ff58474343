"""Sparse and dense embeddings, exact and approximate nearest neighbours.

Dense search packs vectors into blocks (one row = up to a few thousand vectors), joins corpus
blocks with query blocks on a cell id and multiplies them with NumPy inside the tasks. Only the
best k rows per query and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.text import tokens

from .lexical import by_score, calibrate_cosine
from .scale import spread, top_per_key, written

# Fixed values.
SLOTS = 16384
DENSE_THRESHOLD = 0.15
SYNONYM_THRESHOLD, SYNONYM_POOL, SYNONYM_LIMIT = 0.8, 8, 3
CACHE_THRESHOLD = 0.92

_DIGITS = 10  # scores are compared after rounding to this many digits


def slot(token: Column) -> Column:
    """Hash bucket of a token: the last 14 bits of its SHA-256."""
    return (F.conv(F.substring(F.sha2(token, 256), 61, 4), 16, 10).cast("int") % SLOTS).cast("int")


TOKENS = 2_000_000  # tokens whose slots are counted together


def _counted(keys: list[pa.Array], lists: pa.ListArray, names: list[str]) -> pa.RecordBatch:
    """Slots of some rows with their shares. Each distinct token is hashed once, as ``slot`` does it."""
    codes = lists.flatten().dictionary_encode()
    hashed = [sha256(t).digest() for t in codes.dictionary.cast(pa.binary()).to_pylist()]
    slots = np.array([int.from_bytes(h[-2:], "big") % SLOTS for h in hashed], np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    found, n = np.unique(row * SLOTS + slots[codes.indices.to_numpy()], return_counts=True)
    row, at = np.divmod(found, SLOTS)
    norm = np.sqrt(np.bincount(row, weights=n.astype(np.float64) ** 2, minlength=len(lists)))
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays([*(k.take(rows) for k in keys), pa.array(at.astype(np.int32)), pa.array(n / norm[row])], names)


def hashed_embedding(df: DataFrame, id_col: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Sparse L2-normalised bag of words: (id, *keep, slot, w).

    Slots are counted where the row is, so neither texts nor counts are shuffled.
    """
    keys = [id_col, *(keep or [])]
    cut = df.select(*keys, tokens(F.col(text)).alias("_t"))
    schema = T.StructType([*cut.drop("_t").schema.fields, T.StructField("slot", T.IntegerType()), T.StructField("w", T.DoubleType())])
    names = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(np.diff(batch.column(len(keys)).offsets.to_numpy()))
            low = 0
            while low < batch.num_rows:
                before = upto[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(upto, before + TOKENS, "right")))
                some = batch.slice(low, high - low)
                yield _counted(some.columns[:-1], some.column(len(keys)), names)
                low = high

    return cut.mapInArrow(count, schema)


def sparse_cosine(docs: DataFrame, queries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Non-zero cosines of sparse unit vectors: (query_id, doc_id, *scope, score)."""
    scope = scope or []
    asked = queries.select("query_id", *scope, "slot", F.col("w").alias("_qw"))
    return (
        docs.join(written(asked), [*scope, "slot"])
        .groupBy("query_id", "doc_id", *scope)
        .agg(F.sum(F.col("w") * F.col("_qw")).alias("score"))
    )


ASKED_CELLS = 16_000_000  # queries times slots that travel to the documents


def _asked_products(docs: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """Cosines from ``threshold`` on of queries small enough to be held as one matrix: (query_id, doc_id, score).

    Only asked slots of documents move; a document's rows meet in one task, where it is multiplied with all queries.
    """
    rows = asked.toArrow()
    ids = rows.column("query_id").combine_chunks()
    number = asked.select("query_id").distinct().toArrow().column("query_id").combine_chunks()
    place = {q: i for i, q in enumerate(map(repr, number.to_pylist()))}
    slots, at = np.unique(rows.column("slot").to_numpy(), return_inverse=True)
    column = np.array([place[repr(q)] for q in ids.to_pylist()], np.int64)
    weight = rows.column("w").to_numpy()
    step = max(1, ASKED_CELLS // max(1, len(slots), len(place)))
    kinds = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def scored(matrix: np.ndarray, table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole documents of ``table``, of which one begins at each of ``starts``."""
        slot, w = (table.column(c).to_numpy() for c in ("slot", "w"))
        doc = table.column("doc_id").combine_chunks()
        bounds = np.append(starts, table.num_rows)
        for low in range(0, len(starts), step):
            cut = bounds[low:low + step + 1]
            part = slice(cut[0], cut[-1])
            dense = np.zeros((len(cut) - 1, len(slots)))
            np.add.at(dense, (np.repeat(np.arange(len(cut) - 1), np.diff(cut)), np.searchsorted(slots, slot[part])), w[part])
            scores = dense @ matrix
            row, col = np.nonzero(scores >= threshold)
            yield pa.RecordBatch.from_arrays([number.take(pa.array(col)), doc.take(pa.array(cut[row])), pa.array(scores[row, col])], ["query_id", "doc_id", "score"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, held = None, None
        for batch in batches:
            if matrix is None:
                matrix = np.zeros((len(slots), len(place)))
                np.add.at(matrix, (at, column), weight)
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            starts = np.flatnonzero(held.column("_first").to_numpy())
            if len(starts) > 1:  # the last document may go on in the next batch
                yield from scored(matrix, held.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from scored(matrix, held.combine_chunks(), np.array([0]))

    wanted = docs.join(F.broadcast(asked.select("slot").distinct()), "slot", "left_semi")
    turn = F.row_number().over(W.partitionBy("doc_id").orderBy("slot"))
    met = wanted.select("doc_id", "slot", "w", (turn == 1).cast("byte").alias("_first"))
    return met.mapInArrow(multiply, kinds)


def sparse_hits(docs: DataFrame, queries: DataFrame, k: int, threshold: float = DENSE_THRESHOLD, scope: list[str] | None = None) -> DataFrame:
    """Best ``k`` documents per query at or above ``threshold``; many queries, or a scope, meet in a join instead of a product."""
    asked = queries.select("query_id", "slot", "w") if not scope and threshold > 0 else None
    if asked is not None:
        asked = written(asked)
        n, slots = asked.agg(F.countDistinct("query_id"), F.countDistinct("slot")).first()
        if n * slots > ASKED_CELLS:
            asked = None
    if asked is not None:
        scored = _asked_products(docs, asked, threshold)
    else:
        scored = sparse_cosine(docs, queries, scope).filter(F.col("score") >= threshold)
    top = top_per_key(scored, ["query_id"], by_score("score", "doc_id"), k)
    return top.withColumn("raw_score", F.col("score")).withColumn("vector_score", calibrate_cosine(F.col("score")))


def cosine(left: Column, right: Column) -> Column:
    """NULL for missing or unequal vectors, 0 for a zero norm."""

    def dot(a, b):
        pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    comparable = (F.size(left) > 0) & (F.size(left) == F.size(right))
    return F.when(comparable, F.when(norm > 0, dot(left, right) / norm).otherwise(0.0))


def _pack(df: DataFrame, id_col: str, cell: str, salts: int | None, rows: int) -> DataFrame:
    """Rows to blocks (cell, salt, ids, dim, mat); a block holds one cell and one dimension."""
    id_type = df.schema[id_col].dataType
    cell_type = df.schema[cell].dataType
    schema = T.StructType(
        [
            T.StructField("_cell", cell_type),
            T.StructField("_salt", T.IntegerType()),
            T.StructField("_ids", T.ArrayType(id_type)),
            T.StructField("_dim", T.IntegerType()),
            T.StructField("_mat", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_block = 0
        for pdf in batches:
            pdf = pdf[pdf["_vec"].notna()]
            pdf = pdf.assign(_dim=[len(v) for v in pdf["_vec"]])
            out = []
            for (c, dim), part in pdf.groupby(["_c", "_dim"], sort=True):
                if dim == 0:
                    continue
                for at in range(0, len(part), rows):
                    piece = part.iloc[at : at + rows]
                    mat = np.stack(piece["_vec"].to_numpy()).astype(np.float64)
                    norm = np.linalg.norm(mat, axis=1, keepdims=True)
                    mat = np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)
                    first = int(piece["_h"].iloc[0]) if salts else 0
                    out.append((c, (first + n_block) % (salts or 1), list(piece["_id"]), int(dim), mat.tobytes()))
                    n_block += 1
            if out:
                yield pd.DataFrame(out, columns=["_cell", "_salt", "_ids", "_dim", "_mat"])

    source = df.select(
        F.col(cell).alias("_c"), F.col(id_col).alias("_id"), F.col("embedding").alias("_vec"),
        F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).cast("int").alias("_h"),
    )
    return source.mapInPandas(run, schema)


def _best(ids: np.ndarray, scores: np.ndarray, k: int, floor: float | None) -> np.ndarray:
    keep = np.arange(len(scores)) if floor is None else np.flatnonzero(scores >= floor)
    if len(keep) > k:
        edge = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= edge]
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    threshold: float | None = DENSE_THRESHOLD,
    cell: str | None = None,
    salts: int | None = None,
    corpus_block: int = 4096,
    query_block: int = 256,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Best ``k`` cosines per query: (query_id, doc_id, score, rank).

    ``corpus`` (doc_id, embedding), ``queries`` (query_id, embedding). With ``cell`` (a column on
    both sides: a scope or an index cell) only vectors of the same cell are compared. A query may
    appear in several cells. Both sides are packed where they are. Query blocks of up to
    ``broadcast_bytes`` (measured) go to the corpus, which then stays in place; more of them meet the
    corpus blocks in a shuffle in which a cell is spread over ``salts`` tasks, by default one for
    every four blocks of the corpus.
    """
    if cell is None:
        corpus, queries = corpus.withColumn("_c0", F.lit(0)), queries.withColumn("_c0", F.lit(0))
        cell = "_c0"
    right = written(_pack(queries, "query_id", cell, None, query_block).drop("_salt"))
    right = right.withColumnRenamed("_ids", "_qids").withColumnRenamed("_mat", "_qmat")
    size = right.agg(F.sum(F.length("_qmat"))).first()[0] or 0
    if size <= broadcast_bytes:
        left, right, keys = _pack(corpus, "doc_id", cell, None, corpus_block), F.broadcast(right), ["_cell", "_dim"]
    else:
        salts = salts or max(1, -(-corpus.count() // (4 * corpus_block)))
        left, right, keys = _pack(corpus, "doc_id", cell, salts, corpus_block), spread(right, salts), ["_cell", "_salt", "_dim"]
    doc_type, query_type = corpus.schema["doc_id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("doc_id", doc_type),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                docs, asked = np.asarray(row.ids), np.asarray(row.qids)
                mat = np.frombuffer(row.mat).reshape(-1, row.dim)
                qmat = np.frombuffer(row.qmat).reshape(-1, row.dim)
                scores = np.round(mat @ qmat.T, _DIGITS)
                picks = [_best(docs, scores[:, j], k, threshold) for j in range(len(asked))]
                at = np.concatenate(picks) if picks else np.array([], dtype=int)
                col = np.repeat(np.arange(len(asked)), [len(p) for p in picks])
                yield pd.DataFrame({"query_id": asked[col], "doc_id": docs[at], "score": scores[at, col]})

    blocks = left.join(right, keys)
    named = blocks.select("_ids", "_mat", "_qids", "_qmat", "_dim").toDF("ids", "mat", "qids", "qmat", "dim")
    found = named.mapInPandas(multiply, schema)
    return top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], k)


def centroids(corpus: DataFrame, by: str, id_name: str = "query_id") -> DataFrame:
    """Mean vector per group, computed dimension by dimension."""
    cells = corpus.select(by, F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return rows.select(F.col(by).alias(id_name), F.col("v.m").alias("embedding"))


def index_cells(corpus: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 5) -> DataFrame:
    """k-means centres of the corpus: (cell, embedding). Bounded by ``n_cells``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    data = corpus.select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cell INT, embedding ARRAY<DOUBLE>")


def approximate_nearest(
    corpus: DataFrame, queries: DataFrame, k: int, centres: DataFrame, probes: int = 4,
    threshold: float | None = None,
) -> DataFrame:
    """Inverted-file search: exact scores inside the ``probes`` cells nearest to each query."""
    home = assign_cells(corpus.select("doc_id", "embedding"), centres, 1)
    visit = assign_cells(queries.select("query_id", "embedding"), centres, probes)
    return nearest(home, visit, k, threshold, cell="cell")


CENTRE_BYTES = 64 << 20


def assign_cells(vectors: DataFrame, centres: DataFrame, cells: int) -> DataFrame:
    """``vectors`` with one row for each of the ``cells`` centres of greatest cosine, in column ``cell``.

    Centres go to the tasks of the scan and are checked to be at most CENTRE_BYTES. Vectors that are
    NULL, empty or of another length have no cell and are left out; equal cosines go to the smaller cell.
    """
    held = centres.orderBy("cell").limit(CENTRE_BYTES // 8 + 1).collect()
    if sum(len(r["embedding"]) * 8 for r in held) > CENTRE_BYTES:
        raise ValueError("too many centres to assign cells in the scan; use fewer cells")
    names = [r["cell"] for r in held]
    matrix = np.array([r["embedding"] for r in held], np.float64).reshape(len(held), -1)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = [v is not None and len(v) == matrix.shape[1] > 0 for v in pdf["embedding"]]
            pdf = pdf[fits]
            if not len(pdf):
                continue
            mat = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            size = np.linalg.norm(mat, axis=1, keepdims=True)
            scores = np.round(np.divide(mat, size, out=np.zeros_like(mat), where=size > 0) @ matrix.T, _DIGITS)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :cells]
            out = pdf.loc[pdf.index.repeat(order.shape[1])].copy()
            out["cell"] = np.array(names, dtype="int32")[order.ravel()]
            yield out

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])
    return vectors.mapInPandas(assign, schema)


def synonym_targets(neighbours: DataFrame, threshold: float = SYNONYM_THRESHOLD, limit: int = SYNONYM_LIMIT) -> DataFrame:
    """Choose synonym partners from (query_id, doc_id, score) neighbours.

    A self-similarity under 0.5 shows that the store returned distances; they are turned round.
    """
    own = F.max(F.when(F.col("query_id") == F.col("doc_id"), F.col("score"))).over(W.partitionBy("query_id"))
    turned = neighbours.withColumn("_own", own).withColumn(
        "score", F.when(F.col("_own") < 0.5, 1 - F.col("score")).otherwise(F.col("score"))
    )
    fit = turned.filter((F.col("query_id") != F.col("doc_id")) & (F.col("score") >= threshold)).drop("_own", "rank")
    return top_per_key(fit, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], limit)


def synonym_edges(neighbours: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """New undirected synonym edges (src, tgt, weight) between nodes that have no edge yet."""
    picked = synonym_targets(neighbours, **options).select(
        F.least("query_id", "doc_id").alias("src"), F.greatest("query_id", "doc_id").alias("tgt"), "score"
    )
    merged = picked.groupBy("src", "tgt").agg(F.max("score").alias("weight"))
    known = edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    return merged.join(known, ["src", "tgt"], "left_anti")


def cache_hits(
    requests: DataFrame, entries: DataFrame, cited: DataFrame, live_chunks: DataFrame, scope: list[str],
    threshold: float = CACHE_THRESHOLD,
) -> DataFrame:
    """Best usable cached answer per request: (request_id, entry_id, score).

    ``entries`` (entry_id, position, embedding, *scope), ``cited`` (entry_id, chunk_id),
    ``requests`` (request_id, embedding, *scope). Usable: same scope, at least one cached chunk,
    and all of them live. Of equal scores the later entry wins.
    """
    dead = cited.join(live_chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    usable = entries.join(cited.select("entry_id").distinct(), "entry_id", "left_semi").join(
        dead.select("entry_id").distinct(), "entry_id", "left_anti"
    )
    cell = F.xxhash64(*scope)
    found = nearest(
        # Among equals the smallest id wins, so the negative position prefers later entries.
        usable.select((-F.col("position")).alias("doc_id"), cell.alias("_cell_id"), "embedding"),
        requests.withColumn("_cell_id", cell).select(F.col("request_id").alias("query_id"), "_cell_id", "embedding"),
        1, threshold, cell="_cell_id",
    )
    back = usable.select((-F.col("position")).alias("doc_id"), "entry_id")
    return found.join(back, "doc_id").select(F.col("query_id").alias("request_id"), "entry_id", "score")


def vector_pick(groups: DataFrame, vectors: DataFrame, queries: DataFrame, max_related: int) -> DataFrame:
    """Chunks most similar to the query over all its groups: (query_id, chunk_id, score, rank).

    ``groups`` (query_id, group_id, chunk_id). The number to pick is ``max_related`` times half
    the number of groups. A query with any chunk without vector gets nothing here.
    """
    n_groups = groups.groupBy("query_id").agg(F.countDistinct("group_id").alias("_g"))
    wanted = groups.select("query_id", "chunk_id").distinct()
    scored = (
        wanted.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
        .join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        .withColumn("score", F.round(cosine(F.col("embedding"), F.col("_q")), _DIGITS))
    )
    broken = scored.filter(F.col("score").isNull()).select("query_id").distinct()
    whole = scored.join(broken, "query_id", "left_anti").join(n_groups, "query_id")
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    # The largest limit of any query is a constant, so long lists are pruned before the shuffle.
    most = (n_groups.agg(F.max("_g")).first()[0] or 0) * max_related // 2
    ranked = top_per_key(whole, ["query_id"], order, most)
    limit = F.floor(F.lit(max_related) * F.col("_g") / 2)
    return ranked.filter(F.col("rank") <= limit).select("query_id", "chunk_id", "score", "rank")


def reuse_vectors(current: DataFrame, previous: DataFrame, embed) -> DataFrame:
    """Keep the previous version's vector for unchanged chunks and embed only the rest.

    ``current`` (chunk_id, stable_chunk_id, content_hash, text), ``previous`` (stable_chunk_id,
    content_hash, embedding). ``embed`` maps (chunk_id, text) to (chunk_id, embedding). The
    stable id decides first, then the content hash.
    """
    by_id = previous.select("stable_chunk_id", F.col("embedding").alias("_a")).dropDuplicates(["stable_chunk_id"])
    by_hash = previous.groupBy("content_hash").agg(F.min_by("embedding", "stable_chunk_id").alias("_b"))
    known = (
        current.join(by_id, "stable_chunk_id", "left").join(by_hash, "content_hash", "left")
        .withColumn("embedding", F.coalesce("_a", "_b"))
    )
    kept = known.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding", F.lit(True).alias("reused"))
    fresh = embed(known.filter(F.col("embedding").isNull()).select("chunk_id", "text"))
    return kept.unionByName(fresh.select("chunk_id", "embedding", F.lit(False).alias("reused")))


def manifest(vectors: DataFrame, by: list[str]) -> DataFrame:
    """What an index was built with, per group: dimension, vector count, normalised or not."""
    sized = vectors.withColumn("_d", F.size("embedding")).withColumn(
        "_n", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )
    return sized.groupBy(*by).agg(
        F.max("_d").alias("dimension"),
        F.count(F.lit(1)).alias("vectors"),
        F.max(F.abs(F.col("_n") - 1)).alias("_off"),
        F.min("_d").alias("_min"),
    ).select(*by, "dimension", "vectors", (F.col("_off") < 1e-3).alias("normalized"), (F.col("_min") == F.col("dimension")).alias("uniform"))


def manifest_mismatches(stored: DataFrame, wanted: dict) -> DataFrame:
    """Reasons why a stored index does not fit the current settings; empty means compatible."""
    reasons = [
        F.when(~F.col(name).eqNullSafe(F.lit(value)), F.lit(name)) for name, value in sorted(wanted.items())
    ]
    return stored.withColumn("mismatches", F.array_compact(F.array(*reasons)))


SAMPLE_COSINE = 0.98


def validate_index(rebuilt: DataFrame, source: DataFrame, embedded: DataFrame) -> DataFrame:
    """Is a rebuilt index fit to be published? One row with the findings and ``passed``.

    ``rebuilt`` (doc_id, embedding, owner_id), ``source`` (doc_id) what has to be in it and
    ``embedded`` (doc_id, embedding) freshly embedded rows to compare with.
    """
    n = F.count(F.lit(1))
    size = rebuilt.agg(
        n.alias("rows"), F.countDistinct(F.size("embedding")).alias("dimensions"),
        F.count(F.when(F.coalesce(F.col("owner_id").cast("string"), F.lit("")) == "", 1)).alias("unowned"),
    )
    missing = source.select("doc_id").join(rebuilt.select("doc_id"), "doc_id", "left_anti").agg(n.alias("missing"))
    pairs = rebuilt.select("doc_id", "embedding").join(embedded.select("doc_id", F.col("embedding").alias("_e")), "doc_id")
    near = pairs.agg(F.min(F.coalesce(cosine(F.col("embedding"), F.col("_e")), F.lit(0.0))).alias("lowest_cosine"))
    report = size.crossJoin(missing).crossJoin(near)  # one row each
    good = (F.col("rows") > 0) & (F.col("dimensions") == 1) & (F.col("unowned") + F.col("missing") == 0)
    return report.withColumn("passed", good & (F.coalesce("lowest_cosine", F.lit(0.0)) >= SAMPLE_COSINE))


def rebuild_index(rebuilt: DataFrame, source: DataFrame, embedded: DataFrame, path: str) -> str:
    """Write a new index version, check what was written, then publish it; returns its path.

    The pointer is a one-row table that readers look up; it changes only after a passed check.
    """
    import uuid

    spark = rebuilt.sparkSession
    version = f"{path}/version-{uuid.uuid4().hex}"
    rebuilt.write.mode("errorifexists").parquet(version)
    report = validate_index(spark.read.parquet(version), source, embedded).first()
    if not report["passed"]:
        raise ValueError(f"the rebuilt index failed its check: {report.asDict()}")
    spark.createDataFrame([(version,)], "version STRING").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return version
