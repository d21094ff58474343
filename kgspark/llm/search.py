"""Exact inner-product search that skips blocks of documents by their term maxima.

Components of a vector are its terms. Documents are put in an order in which neighbours share their
strongest term, and cut into ranges; a range holds small blocks, and every block the greatest and least
value of each term. The sum of a query's best products with these bounds what any document of the block
can score. A first wave scores, for each query, its most promising range and so finds a score that its
k-th hit reaches at least. The second wave visits the other ranges; within a range each query takes the
blocks in order of their bounds and stops when a bound falls below its k-th score. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import cut_lineage, number_rows
from kgspark.operators.scale import top_per_key

BLOCK = 64  # documents whose maxima are kept together
RANGE = 2048  # documents in one row of the index
GROUP = 256  # queries that travel together
LIMIT = 1 << 62  # scores and components from here on raise an error
NONE = -LIMIT  # below every score, and its negative is a number, too
HITS = "query_no long, query_id long, vec_id long, score long"


def usable(vector: str | Column) -> Column:
    """Neither NULL nor holding a NULL, NaN or infinite component."""
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, fine), F.lit(False))


def quantised(vector: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double, in whole 64-bit numbers; raises where LIMIT is reached."""
    def step(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < float(LIMIT), F.floor(scaled)).otherwise(F.raise_error(F.lit("a component times the scale exceeds 62 bits")).cast("long"))

    return F.transform(vector, step)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors of a list column as rows; missing trailing components are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: in floating point or 64 bits where every sum is exact there, else without limit."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**61:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores a @ b.T as 64-bit numbers; raises where one reaches LIMIT."""
    found = _product(a, b)
    if found.dtype == object:
        if found.size and max(found.max(), -found.min()) >= LIMIT:
            raise OverflowError("an inner product exceeds 62 bits")
        found = found.astype(np.int64)
    return found


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Greatest scores that blocks allow; what is beyond LIMIT counts as LIMIT."""
    found = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    return np.clip(found, -LIMIT, LIMIT).astype(np.int64) if found.dtype == object else found


def build_index(vectors: DataFrame, dims: int, kind: str = "<i4") -> DataFrame:
    """Index of ``vec_id, q`` (integer vectors): one row per range with ids, vectors and block bounds.

    ``kind`` is the number type that components are stored in.
    """
    home = F.coalesce(F.array_position("q", F.array_max("q")), F.lit(0))
    numbered = number_rows(vectors.withColumn("_home", home), ["_home", "vec_id"])
    ranged = numbered.withColumn("range", F.expr(f"row_no div {RANGE}"))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        rows = _matrix(table.column("q").combine_chunks(), dims)
        blocks = [rows[i:i + BLOCK] for i in range(0, len(rows), BLOCK)]
        high, low = np.array([b.max(0) for b in blocks]), np.array([b.min(0) for b in blocks])
        blob = [x.astype(kind).tobytes() for x in (rows, high, low)]
        return pa.table({
            "range": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "rows": pa.array(blob[:1], pa.binary()), "high": pa.array(blob[1:2], pa.binary()), "low": pa.array(blob[2:], pa.binary()),
        })

    return ranged.groupBy("range").applyInArrow(index, "range long, ids binary, rows binary, high binary, low binary")


def _unpack(raw: bytes, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.int64)


def _best_ranges(dims: int, kind: str):
    """Task function: for each query of a group, its greatest block bound in one range."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, numbers, vectors, where, high, low = (batch.column(c)[i] for c in ("group", "query_nos", "vectors", "range", "high", "low"))
                top = _bounds(_matrix(vectors.values, dims), _unpack(high.as_py(), dims, kind), _unpack(low.as_py(), dims, kind)).max(1)
                n = len(top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group.as_py()] * n, pa.int64()), numbers.values, pa.array([where.as_py()] * n, pa.int64()), pa.array(top)],
                    ["group", "query_no", "range", "bound"],
                )

    return best


def _score(dims: int, k: int, kind: str):
    """Task function: hits of a group's queries in one range, best blocks first, from each query's floor."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, own = (batch.column(c)[i].values.to_numpy() for c in ("query_nos", "query_ids"))
                queries = _matrix(batch.column("vectors")[i].values, dims)
                floor = batch.column("floors")[i].values.to_numpy().copy()
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                rows, high, low = (_unpack(batch.column(c)[i].as_py(), dims, kind) for c in ("rows", "high", "low"))
                bounds = _bounds(queries, high, low)
                order = np.argsort(-bounds, axis=1, kind="stable")
                held_ids = np.full((len(own), k), np.iinfo(np.int64).max)
                held = np.full((len(own), k), NONE)
                for turn in range(order.shape[1]):
                    block = order[:, turn]
                    alive = np.flatnonzero(bounds[np.arange(len(own)), block] >= floor)
                    if not len(alive):
                        break  # bounds only fall from here on, for every query
                    for b in np.unique(block[alive]):
                        who = alive[block[alive] == b]
                        part = slice(b * BLOCK, (b + 1) * BLOCK)
                        scores = _exact(queries[who], rows[part])
                        scores[ids[part][None, :] == own[who][:, None]] = NONE  # never itself
                        both = np.concatenate([held[who], scores], 1)
                        names = np.concatenate([held_ids[who], np.broadcast_to(ids[part], scores.shape)], 1)
                        names = np.where(both == NONE, np.iinfo(np.int64).max, names)
                        best = np.lexsort((names, -both), axis=1)[:, :k]
                        held[who], held_ids[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                        floor[who] = np.maximum(floor[who], held[who, k - 1])
                q, at = np.nonzero((held > NONE) & (held >= floor[:, None]))
                out = [number[q], own[q], held_ids[q, at], held[q, at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_no", "query_id", "vec_id", "score"])

    return score


def _top(hits: DataFrame, key: str, k: int) -> DataFrame:
    return top_per_key(hits, [key], [F.col("score").desc(), F.col("vec_id")], k)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 64) -> DataFrame:
    """The ``k`` best other vectors of each query: query_id, rank, vec_id, score; ties go to the smaller id.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored. Vectors that are NULL or hold a NULL
    or non-finite component take no part, as query or candidate, and neither do rows without an id.
    Vectors of different lengths meet in the components both have. Rows that share an id are one
    another's self, so they never meet; apart from that every row counts: a candidate in two rows stands
    twice among the hits, and so does every hit of a query in two rows. Fewer than ``k`` others are all returned; an empty table or query
    set gives no rows. Components and scores are whole 64-bit numbers; LIMIT and beyond raise.
    """
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("q"), is_query.alias("_query"))
    good = cut_lineage(good)
    dims, top = good.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    dims, kind = dims or 1, "<i4" if (top or 0) < 2**31 else "<i8"
    index = cut_lineage(build_index(good.select("vec_id", "q"), dims, kind))
    asked = number_rows(good.where("_query").select("vec_id", "q"), ["vec_id"], "query_no")
    asked = cut_lineage(asked.select(F.expr(f"query_no div {GROUP}").alias("group"), "query_no", F.col("vec_id").alias("query_id"), "q"))

    def grouped(rows: DataFrame, keys: list[str], floor: Column) -> DataFrame:
        """Queries packed by ``keys``; a pack has GROUP queries at most."""
        packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("query_no", "query_id", "q", floor.alias("floor")))).alias("_p"))
        fields = {"query_nos": "query_no", "query_ids": "query_id", "vectors": "q", "floors": "floor"}
        return packed.select(*keys, *[F.col(f"_p.{f}").alias(name) for name, f in fields.items()])

    lowest = F.lit(NONE).cast("long")
    packs = grouped(asked, ["group"], lowest)
    # The stated query set meets every range, in blocks: groups of queries times rows of the index.
    bounds = packs.crossJoin(index.select("range", "high", "low")).mapInArrow(_best_ranges(dims, kind), "group long, query_no long, range long, bound long")
    first = bounds.groupBy("group", "query_no").agg(F.max_by("range", F.struct("bound", -F.col("range"))).alias("range"))
    seeds = grouped(asked.join(first.drop("group"), "query_no"), ["group", "range"], lowest)
    seeded = seeds.join(index, "range").mapInArrow(_score(dims, k, kind), HITS)
    kth = F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(lowest)
    floors = _top(seeded, "query_no", k).groupBy("query_no").agg(kth.alias("_floor"))
    asked = asked.join(floors, "query_no", "left").withColumn("_floor", F.coalesce("_floor", lowest))
    packs = grouped(asked, ["group"], F.col("_floor"))
    hits = packs.crossJoin(index).mapInArrow(_score(dims, k, kind), HITS)
    return _top(hits.drop("query_no"), "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
