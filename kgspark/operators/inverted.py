"""A stored inverted index with block bounds, and exact BM25 search that skips blocks by them.

Documents are packed where they are: every run of up to SHARD_DOCS documents of a task becomes a shard, and
a shard has one row per term with its postings (document numbers and counts). A term's postings are cut
into blocks of RANGE neighbouring documents; a block stores its greatest count and its least document length.
Both bound the term's part of the score whatever the average length is, so the bounds stay true when more
documents come.

A search reads only rows of asked terms. In a shard, a query takes its terms from the strongest bound on. The
k-th best partial score is a floor for the k-th score; a document whose partial score and the bounds of the
terms to come, in its range, stay below the floor is out, and blocks without a document that is still in are
skipped. Nothing is approximate: ties are kept and decided by the document's id.

Layout: one Parquet table, ``segment=…`` for each ``add`` and in it ``kind=terms`` and ``kind=shards``, committed
together. Columns are read as needed: df alone for the statistics, postings for asked terms only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.text import tokens

from .lexical import B, K1, by_score, calibrate_bm25
from .scale import top_per_key, written

SHARD_DOCS = 16_384
SHARD_TOKENS = 4_000_000
RANGE = 16
GROUP = 256  # queries that visit a shard together
SLACK = 1e-7  # bounds and scores are sums of rounded parts
_PARTS = ("docs", "counts", "ranges", "cuts", "most", "least")  # 32-bit arrays, one value per posting or block
_POSTINGS = "shard string, term string, df int, " + ", ".join(f"{p} binary" for p in _PARTS)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as one binary value each, without a copy per value."""
    values = np.ascontiguousarray(values.astype("<i4"))
    offsets = (4 * cuts).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return large.cast(pa.binary())


def _shard_rows(name: str, listed: pa.Array) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Rows of one shard from the token lists of its documents, the documents in order of length, and their lengths.

    Neighbours of like length have like impacts, so the bounds of a block are close to what it holds.
    """
    lengths = np.diff(listed.offsets.to_numpy())
    order = np.argsort(lengths, kind="stable")
    coded = listed.flatten().dictionary_encode()
    doc = np.repeat(np.argsort(order), lengths)
    lengths = lengths[order]
    keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(lengths)) + doc, return_counts=True)
    term, doc = np.divmod(keys, max(1, len(lengths)))
    first = np.flatnonzero(np.diff(term, prepend=-1))  # where each term's postings begin
    opens = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc // RANGE, prepend=-1) != 0))  # and each block
    of_block = np.searchsorted(first, opens, "right") - 1
    block_first = np.searchsorted(of_block, np.arange(len(first) + 1))
    cuts = np.append(first, len(doc))
    most, least = (np.maximum.reduceat(counts, opens), np.minimum.reduceat(lengths[doc], opens)) if len(doc) else (opens, opens)
    columns = [
        pa.array([name] * len(first), pa.string()), coded.dictionary.take(pa.array(term[first])), pa.array(np.diff(cuts), pa.int32()),
        _blobs(doc, cuts), _blobs(counts, cuts), _blobs(doc[opens] // RANGE, block_first), _blobs(opens - first[of_block], block_first),
        _blobs(most, block_first), _blobs(least, block_first),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", *_PARTS]), order, lengths


def _pack(shard_docs: int):
    """Task function: posting rows of every shard, then one row with its documents (term NULL)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, listed = batch.column(0), batch.column(1)
            upto = np.cumsum(np.diff(listed.offsets.to_numpy()))
            low = 0
            while low < len(ids):
                before = upto[low - 1] if low else 0
                high = min(low + shard_docs, max(low + 1, int(np.searchsorted(upto, before + SHARD_TOKENS, "right"))))
                name = f"{part}-{number}"
                rows, order, lengths = _shard_rows(name, listed.slice(low, high - low))
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int32()))], [*rows.schema.names, "ids", "lengths"])
                last = [pa.array([name]), *[pa.nulls(1, f.type) for f in list(rows.schema)[1:]]]
                last += [pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), a) for a in (ids.slice(low, high - low).take(pa.array(order)), pa.array(lengths, pa.int32()))]
                yield pa.RecordBatch.from_arrays(last, [*rows.schema.names, "ids", "lengths"])
                low, number = high, number + 1

    return pack


def _score(k: int, average: float):
    """Group function: one shard and one group of queries; the shard's best hits of each query, and what was scored."""

    def score(postings: pa.Table, around: pa.Table) -> pa.Table:
        row = {c: around.column(c)[0] for c in around.schema.names} if around.num_rows else {}
        kind = around.schema.field("ids").type.value_type
        out = {"query": [], "at": [], "score": [], "scored": [], "all": []}
        if row and postings.num_rows:
            lengths = row["lengths"].values.to_numpy()
            number = {t: i for i, t in enumerate(postings.column("term").to_pylist())}
            parts = {p: [np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in postings.column(p)] for p in _PARTS}
            first = np.append(0, np.cumsum([len(x) for x in parts["docs"]]))
            blocks = np.append(0, np.cumsum([len(x) for x in parts["ranges"]]))
            flat = {p: np.concatenate(x) for p, x in parts.items()}
            begin = flat["cuts"] + np.repeat(first[:-1], np.diff(blocks))
            end = np.append(begin[1:], first[-1])

            def impact(count: np.ndarray, length: np.ndarray) -> np.ndarray:
                return count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))

            bound = impact(flat["most"], flat["least"])
            value = impact(flat["counts"], lengths[flat["docs"]])
            asked = {}
            for query, term, w in zip(*(row[c].values.to_pylist() for c in ("queries", "terms", "weights"))):
                if term in number:
                    asked.setdefault(query, []).append((number[term], w))
            range_of = np.arange(len(lengths)) // RANGE
            strongest = np.maximum.reduceat(bound, blocks[:-1])
            for query, wanted in asked.items():
                wanted.sort(key=lambda x: -x[1] * strongest[x[0]])
                rest = np.zeros(int(range_of[-1]) + 1)  # what the terms still to come can add in each range
                for t, w in wanted:
                    rest[flat["ranges"][blocks[t]:blocks[t + 1]]] += w * bound[blocks[t]:blocks[t + 1]]
                total, floor, scored = np.zeros(len(lengths)), -np.inf, 0
                for t, w in wanted:
                    mine = np.arange(blocks[t], blocks[t + 1])
                    where = flat["ranges"][mine]
                    if floor > 0:  # only ranges with a document that can still reach the floor
                        able = total + rest[range_of] >= floor - SLACK
                        live = np.bincount(range_of[able], minlength=len(rest)) > 0
                        some = mine[live[where]]
                    else:
                        some = mine
                    rest[where] -= w * bound[mine]
                    if not len(some):
                        continue
                    size = end[some] - begin[some]
                    upto = np.cumsum(size)
                    post = np.repeat(begin[some] - (upto - size), size) + np.arange(int(upto[-1]))
                    total[flat["docs"][post]] += w * value[post]  # a document stands once in a term's postings
                    scored += len(post)
                    if np.count_nonzero(total) >= k:
                        floor = np.partition(total, len(total) - k)[len(total) - k]
                held = sum(int(first[t + 1] - first[t]) for t, _ in wanted)
                best = np.flatnonzero((total > 0) & (total >= floor - SLACK))
                out["query"] += [query] * (len(best) + 1)
                out["at"] += [*best.tolist(), None]
                out["score"] += [*total[best].tolist(), None]
                out["scored"] += [*[None] * len(best), scored]
                out["all"] += [*[None] * len(best), held]
        ids = row["ids"].values.take(pa.array(out["at"], pa.int64())) if row else pa.array([], kind)
        queries = pa.array(out["query"], around.schema.field("queries").type.value_type)
        numbers = [pa.array(out[c], t) for c, t in (("score", pa.float64()), ("scored", pa.int64()), ("all", pa.int64()))]
        return pa.table([queries, ids, *numbers], names=["query_id", "doc_id", "score", "scored", "postings"])

    return score


class InvertedIndex:
    """``InvertedIndex(spark, folder)`` opens what is stored there; ``add`` makes or extends it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, docs: DataFrame, shard_docs: int = SHARD_DOCS) -> InvertedIndex:
        """Adds documents (doc_id, text). Texts stay in their tasks; NULL texts are documents of no length."""
        segment = uuid.uuid4().hex
        rows = docs.select("doc_id", tokens(F.col("text")).alias("_t"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        packed = rows.mapInArrow(_pack(shard_docs), f"{_POSTINGS}, ids array<{kind}>, lengths array<int>")
        packed = packed.withColumn("shard", F.concat(F.lit(f"{segment}-"), "shard")).withColumn("segment", F.lit(segment))
        packed = packed.withColumn("kind", F.when(F.col("term").isNull(), "shards").otherwise("terms"))
        packed.write.mode("append").partitionBy("segment", "kind").parquet(self.folder)
        return self

    def scored(self, queries: DataFrame, k: int) -> DataFrame:
        """Hits of each shard that may be among the best ``k`` (query_id, doc_id, score), and for each query and shard
        one row with the postings that it has there and those that were scored."""
        stored = self.spark.read.parquet(self.folder)
        shards, postings = (stored.where(F.col("kind") == kind) for kind in ("shards", "terms"))
        sums = shards.select(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
        n_docs, average = sums["n"] or 0, (sums["t"] or 0) / (sums["n"] or 1) or 1.0
        asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = written(asked)
        groups = -(-asked.select("query_id").distinct().count() // GROUP) or 1
        asked = asked.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        stats = postings.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weighted = asked.join(stats.select("term", idf.alias("_idf")), "term").withColumn("w", F.col("_idf") * F.col("qtf"))
        packed = weighted.groupBy("_group").agg(F.collect_list(F.struct("query_id", "term", "w")).alias("_q"))
        packed = packed.select(F.col("_group").alias("_to"), F.col("_q.query_id").alias("queries"), F.col("_q.term").alias("terms"), F.col("_q.w").alias("weights"))
        # The stated query set meets every shard, in groups.
        around = shards.select(F.col("shard").alias("_there"), "ids", "lengths").crossJoin(packed)
        rows = postings.select("shard", "term", *_PARTS).join(asked.select("_group", "term").distinct(), "term")
        schema = T.StructType([
            T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", shards.schema["ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()), T.StructField("scored", T.LongType()), T.StructField("postings", T.LongType()),
        ])
        return rows.groupBy("shard", "_group").cogroup(around.groupBy("_there", "_to")).applyInArrow(_score(k, average), schema)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Top ``k`` hits of each query: (query_id, doc_id, rank, score, raw_score, keyword_score)."""
        found = self.scored(queries, k).where("score IS NOT NULL").select("query_id", "doc_id", "score")
        keyword = calibrate_bm25(F.col("score"))
        top = top_per_key(found, ["query_id"], by_score("score", "doc_id"), k)
        return top.withColumn("raw_score", F.col("score")).withColumn("keyword_score", keyword).withColumn("score", keyword)

    def skipped(self, queries: DataFrame, k: int) -> float:
        """Share of the queries' postings that a search for ``k`` hits does not score."""
        scored, held = self.scored(queries, k).agg(F.sum("scored"), F.sum("postings")).first()
        return 1 - scored / held if held else 0.0
