"""Approximate neighbours: a stored product-quantised index with exact re-scoring, and similar pairs by sign bands.

``QuantisedIndex`` cuts a unit vector into PARTS pieces and stores for each piece the nearest of up to CODES
centres, fitted on a bounded sample. A query's products with all centres are tables, from which every stored
vector's score is estimated by PARTS look-ups, without its components being read. The ``pool`` best estimates
of a query are then scored exactly from the stored vectors.

``similar_pairs`` finds pairs at or above a cosine without comparing all: vectors with equal signs along a
band of random directions share a bucket. Equal vectors are one class and are compared once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import cut_lineage, top_per_key, written

PARTS, CODES = 16, 256
SAMPLE = 20_000  # vectors that the centres are fitted on
ROUNDS = 12
BLOCK = 4096  # vectors stored in one row
GROUP = 256  # queries that visit a block together
BANDS, BITS = 128, 10  # at cosine 0.8 a pair shares no band once in 700,000 cases
CLASS_GROUP = 2048  # vectors of a band that meet in one group, about
SIGNED = 2048  # vectors whose buckets leave together
PRODUCTS = 4_000_000  # cosines worked out together
_DIGITS = 10


def unit(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as rows of length 1; a zero vector stays."""
    mat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)


def _fit(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Centres of points: k-means from distinct points, a centre that loses all its points stays."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= CODES:
        return distinct
    centres = distinct[np.sort(rng.choice(len(distinct), CODES, replace=False))]
    for _ in range(ROUNDS):
        near = _nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, j], len(centres)) for j in range(points.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def _pieces(dims: int) -> list[slice]:
    cuts = np.linspace(0, dims, min(PARTS, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def fitting(vectors: DataFrame) -> DataFrame:
    """Vectors that can be compared: not NULL, not empty, without NULL or non-finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce((F.size("embedding") > 0) & good, F.lit(False)))


class QuantisedIndex:
    """``QuantisedIndex(spark, folder)`` opens what is stored there; ``build`` makes it and ``add`` extends it.

    All vectors of an index have one length; others are left out. Vectors that are NULL, empty or hold a NULL or
    non-finite component take no part.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame, sample: int = SAMPLE) -> QuantisedIndex:
        """Fits centres on the ``sample`` vectors (doc_id, embedding) with the smallest hash of their id, and adds all."""
        good = fitting(vectors)
        dims = good.agg(F.mode(F.size("embedding"), True)).first()[0] or 0
        place = F.xxhash64("doc_id")
        chosen = good.where(F.size("embedding") == dims).orderBy(place, "doc_id").limit(sample).select("embedding").coalesce(1)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points = np.concatenate([unit(b.column(0), dims) for b in batches] or [np.zeros((0, max(dims, 1)))])
            rng = np.random.default_rng(7)
            centres = [_fit(points[:, p], rng) if len(points) else points[:, p] for p in _pieces(dims)]
            yield pa.RecordBatch.from_arrays([
                pa.array([dims], pa.int32()), pa.array([[len(c) for c in centres]], pa.list_(pa.int32())), pa.array([[c.astype("<f8").tobytes() for c in centres]], pa.list_(pa.binary())),
            ], ["dims", "sizes", "centres"])

        chosen.mapInArrow(fit, "dims int, sizes array<int>, centres array<binary>").write.parquet(f"{self.folder}/centres")
        return self.add(vectors)

    def _centres(self) -> tuple[int, list[np.ndarray]]:
        row = self.spark.read.parquet(f"{self.folder}/centres").first()
        return row["dims"], [np.frombuffer(bytes(c), "<f8").reshape(n, -1) for n, c in zip(row["sizes"], row["centres"]) if n]

    def add(self, vectors: DataFrame) -> QuantisedIndex:
        """Codes and stores more vectors; they are packed into blocks where they are."""
        dims, centres = self._centres()
        rows = fitting(vectors).where(F.size("embedding") == dims).select("doc_id", "embedding")
        kind = vectors.schema["doc_id"].dataType.simpleString()
        segment = uuid.uuid4().hex

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = TaskContext.get().partitionId(), 0
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(low, BLOCK)
                    mat = unit(some.column(1), dims)
                    codes = np.stack([_nearest(mat[:, p], c) for p, c in zip(_pieces(dims), centres)], 1).astype(np.uint8)
                    ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{segment}-{part}-{number}"]), ids, pa.array([codes.tobytes()], pa.binary()), pa.array([mat.astype("<f8").tobytes()], pa.binary())],
                        ["block", "ids", "codes", "vectors"],
                    )
                    number += 1

        rows.mapInArrow(code, f"block string, ids array<{kind}>, codes binary, vectors binary").write.mode("append").parquet(f"{self.folder}/blocks")
        return self

    def search(self, queries: DataFrame, k: int, pool: int, threshold: float | None = None) -> DataFrame:
        """Best ``k`` of the ``pool`` vectors with the best estimates: (query_id, doc_id, score, rank).

        A pool of all vectors makes the search exact. ``queries`` (query_id, embedding).
        """
        dims, centres = self._centres()
        blocks = self.spark.read.parquet(f"{self.folder}/blocks")
        asked = fitting(queries).where(F.size("embedding") == dims).select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("_e"))
        groups = -(-asked.count() // GROUP) or 1
        packs = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("_g")).agg(F.collect_list("query_id").alias("queries"), F.flatten(F.collect_list("_e")).alias("_q"))
        packs = packs.drop("_g")
        query_kind, doc_kind = asked.schema["query_id"].dataType, blocks.schema["ids"].dataType.elementType

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, raw, named, flat in zip(*(batch.column(c) for c in ("block", "codes", "queries", "_q"))):
                    codes = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, len(centres))
                    mat = unit(pa.ListArray.from_arrays(pa.array([0, len(flat.values)], pa.int32()), flat.values), len(flat.values)).reshape(-1, dims)
                    guess = np.zeros((len(mat), len(codes)))
                    for j, (p, c) in enumerate(zip(_pieces(dims), centres)):
                        guess += (mat[:, p] @ c.T)[:, codes[:, j]]
                    # One scale per query group is fine: estimates are compared within a query.
                    best = np.argsort(-guess, axis=1, kind="stable")[:, :pool]
                    at, rows = best.ravel(), np.repeat(np.arange(len(mat)), best.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [named.values.take(pa.array(rows)), pa.array([block.as_py()] * len(at)), pa.array(at, pa.int64()), pa.array(guess[rows, at])], ["query_id", "block", "at", "guess"],
                    )

        # The stated query set meets the codes of every block, in groups.
        guesses = blocks.select("block", "codes").crossJoin(packs).mapInArrow(estimate, f"query_id {query_kind.simpleString()}, block string, at long, guess double")
        chosen = top_per_key(guesses, ["query_id"], [F.desc("guess"), F.col("block"), F.col("at")], pool)
        met = chosen.select("query_id", "block", "at").join(asked, "query_id")
        wanted = met.groupBy("block").agg(F.collect_list(F.struct("query_id", "at", "_e")).alias("_w"))
        wanted = wanted.select("block", F.col("_w.query_id").alias("queries"), F.col("_w.at").alias("_at"), F.flatten("_w._e").alias("_q"))

        def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw, ids, named, places, flat in zip(*(batch.column(c) for c in ("vectors", "ids", "queries", "_at", "_q"))):
                    at = places.values.to_numpy()
                    mine = np.frombuffer(raw.as_py(), "<f8").reshape(-1, dims)[at]
                    mat = flat.values.to_numpy().reshape(-1, dims)
                    size = np.linalg.norm(mat, axis=1)
                    scores = np.round(np.divide((mine * mat).sum(1), size, out=np.zeros(len(at)), where=size > 0), _DIGITS)
                    yield pa.RecordBatch.from_arrays([named.values, ids.values.take(pa.array(at)), pa.array(scores)], ["query_id", "doc_id", "score"])

        schema = T.StructType([T.StructField("query_id", query_kind), T.StructField("doc_id", doc_kind), T.StructField("score", T.DoubleType())])
        found = blocks.select("block", "ids", "vectors").join(wanted, "block").mapInArrow(rescore, schema)
        if threshold is not None:
            found = found.where(F.col("score") >= threshold)
        return top_per_key(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def similar_pairs(vectors: DataFrame, threshold: float, most: int, bands: int = BANDS, bits: int = BITS, seed: int = 11) -> DataFrame:
    """(query_id, doc_id, score): for each vector (doc_id, embedding) its ``most`` best others at or above the cosine.

    A pair is compared if the signs of all directions of some band agree; ties go to the smaller id.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"  # both without loss
    good = fitting(vectors).select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    key = F.sha2(F.concat_ws(",", F.transform("e", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    good = good.where(F.exists("e", lambda x: x != 0))  # a vector of zeros is like none
    named = cut_lineage(good.select("doc_id", key.alias("h"), "e"))
    classes = named.groupBy("h").agg(F.first("e").alias("e"), F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()))
    named = cut_lineage(named.join(classes.select("h", "c"), "h").select("doc_id", "c"))
    share = max(0, min(bits, (classes.count() // CLASS_GROUP).bit_length()))  # leading bits of a key that part a band

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                if dims not in planes:
                    planes[dims] = np.random.default_rng([seed, dims]).standard_normal((dims, bands * bits))
                mine = np.flatnonzero(sizes == dims)
                for low in range(0, len(mine), SIGNED):
                    rows = mine[low:low + SIGNED]
                    column = batch.column(2).take(pa.array(rows))
                    keys = ((unit(column, dims) @ planes[dims] > 0).reshape(len(rows), bands, bits) @ (1 << np.arange(bits))).ravel()
                    raw = pa.array([r.tobytes() for r in column.flatten().to_numpy().reshape(len(rows), dims).astype(kind)], pa.binary())
                    n, band = np.repeat(np.arange(len(rows)), bands), np.tile(np.arange(bands), len(rows))
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(i).take(pa.array(rows[n])) for i in (0, 1)), pa.array(np.full(len(n), dims, np.int32)),
                        pa.array(((band << bits) + keys >> bits - share).astype(np.int32)), pa.array(keys.astype(np.int32)), raw.take(pa.array(n)),
                    ], ["c", "first", "dims", "part", "bucket", "e"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        """For each vector its best others of the same bucket, ``most`` + 1 at most; ties to the class with the smaller id."""
        table = table.sort_by([("bucket", "ascending"), ("first", "ascending")])
        c, bucket = (table.column(x).to_numpy() for x in ("c", "bucket"))
        mat = np.frombuffer(b"".join(table.column("e").to_pylist()), kind).astype(np.float64).reshape(len(c), key[0].as_py())
        mat /= np.linalg.norm(mat, axis=1, keepdims=True)
        out = [(c[:0], c[:0], mat[:0, 0])]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for low, high in zip(cuts, cuts[1:]):
            step = max(1, PRODUCTS // (high - low))
            for top in range(low, high if high - low > 1 else low, step):
                scores = np.round(mat[top:min(top + step, high)] @ mat[low:high].T, _DIGITS)
                own = np.arange(len(scores))
                scores[own, own + top - low] = -2.0
                row, at = np.nonzero(scores >= threshold)
                score = scores[row, at]
                order = np.lexsort((at, -score, row))
                row, at, score = row[order], at[order], score[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) <= most
                out.append((c[top + row[kept]], c[low + at[kept]], score[kept]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "score"])

    id_kind = named.schema["doc_id"].dataType.simpleString()
    signed = classes.select("c", "first", "e").mapInArrow(sign, f"c long, first {id_kind}, dims int, part int, bucket int, e binary")
    # Vectors meet where they share a bucket; only the best of each leave it.
    met = signed.groupBy("dims", "part").applyInArrow(meet, "a long, b long, score double").groupBy("a", "b").agg(F.max("score").alias("score"))
    own = classes.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("score"))
    both = cut_lineage(met.union(own))
    # The smallest ids of a class are enough: no vector takes more than ``most`` others.
    first = W.partitionBy("c").orderBy("doc_id")
    members = named.select("doc_id", "c").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).drop("_n")
    offered = both.join(members.withColumnRenamed("c", "b"), "b")
    offered = top_per_key(offered, ["a"], [F.desc("score"), F.col("doc_id")], most + 1).drop("rank")  # itself may be among them
    found = named.select(F.col("doc_id").alias("query_id"), F.col("c").alias("a")).join(offered, "a").where("query_id <> doc_id")
    return top_per_key(found.select("query_id", "doc_id", "score"), ["query_id"], [F.desc("score"), F.col("doc_id")], most)
