"""Quartile bucket digests: short fingerprints of texts whose difference grows with the texts' difference.

Every run of three UTF-8 bytes falls into one of 256 buckets by a multiplicative hash. The digest holds,
for each bucket, in which quarter of all bucket counts its count lies (2 bits), and before that a byte for
the length (four steps per doubling) and a byte for the first and second quartile relative to the third.
The difference of two digests adds up the steps between their buckets, with a bucket in opposite quarters
counting double, and the bounded differences of the two head bytes; MOST and more count as nothing in
common.

``compare_with_next`` puts documents in order of their ids. A text travels once, to a range of ids; rows
whose successor is in the same range are done there, and only the first and last row of every range meet
in a second step.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import arrays
from kgspark.llm.common import size_of, written

BUCKETS = 256
HEAD = 2
SIZE = HEAD + BUCKETS // 4  # bytes of a digest
MULTIPLIER = 2654435761  # 2**32 over the golden ratio
MOST = 512  # difference at which likeness is 0; unlike texts of one language differ by about 320
LENGTH_STEP, LENGTH_MOST, RATIO_STEP = 4, 48, 2
PART_BYTES = 32 << 20
RUN_BYTES = 2 << 20


def length_code(sizes: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 + four steps per doubling, in whole numbers."""
    sizes = np.asarray(sizes, np.int64)
    power = np.frexp(np.maximum(sizes, 1).astype(np.float64))[1].astype(np.int64) - 1
    return np.where(sizes > 0, 1 + 4 * power + ((sizes << 2 >> power) & 3), 0).astype(np.uint8)


def digests(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digests (SIZE bytes each) of the texts flat[offsets[i]:offsets[i + 1]]."""
    low, n = offsets[0], len(offsets) - 1
    data, edges = flat[low:offsets[-1]].astype(np.uint32), offsets - low
    sizes = np.diff(edges)
    counts = np.zeros((n, BUCKETS), np.int64)
    if len(data) >= 3:
        doc = np.repeat(np.arange(n), sizes)
        inside = doc[:-2] == doc[2:]
        triple = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
        bucket = (triple * np.uint32(MULTIPLIER) >> np.uint32(24)).astype(np.int64)
        counts = np.bincount((doc[:-2] * BUCKETS + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    ordered = np.sort(counts, axis=1)
    first, second, third = (ordered[:, k * BUCKETS // 4 - 1] for k in (1, 2, 3))
    code = (counts > first[:, None]).astype(np.uint8)
    code += counts > second[:, None]
    code += counts > third[:, None]
    out = np.empty((n, SIZE), np.uint8)
    out[:, 0] = length_code(sizes)
    ratios = [np.minimum(16 * q // np.maximum(third, 1), 15) for q in (first, second)]
    out[:, 1] = ratios[0] << 4 | ratios[1]
    out[:, HEAD:] = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    return out


def _byte_steps() -> np.ndarray:
    """Difference of the four buckets in a byte, for all pairs of bytes."""
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    steps = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(steps == 3, 6, steps).sum(2).astype(np.int32).ravel()


_STEPS = _byte_steps()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 for a difference of MOST or more, row by row."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    difference = _STEPS[a[:, HEAD:] * 256 + b[:, HEAD:]].sum(1)
    difference += np.minimum(LENGTH_STEP * np.abs(a[:, 0] - b[:, 0]), LENGTH_MOST)
    difference += RATIO_STEP * (np.abs((a[:, 1] >> 4) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15) - (b[:, 1] & 15)))
    return 1 - np.minimum(difference, MOST) / MOST


def of_texts(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    return digests(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum(sizes)))


def with_fingerprints(df: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``df`` with the digest of ``text`` in hexadecimal; NULL counts as empty. An own column of that name is replaced."""
    df = df.drop(name)
    place = df.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, high in arrays.row_runs(batch.column(place), RUN_BYTES):
                flat, offsets = arrays.text_bytes(batch.column(place).slice(low, high - low))
                found += [d.tobytes().hex() for d in digests(flat, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(add, f"{fields}, `{name}` string")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
EDGES = "edge int, part int, text string"  # edge: 0 a finished row, 1 the first of a part, 2 the last
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
_NAMES = [f.split()[0] for f in f"{RESULT}, {EDGES}".split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def _pairs(ids: list, texts: list[str], after: list[str]) -> list[tuple]:
    """Result rows of documents whose successors are ``after``."""
    edited = []
    for text, other in zip(texts, after):
        moved = len(text) // 4
        edited.append((text[:len(text) - moved] + other[:moved]).encode())
    own, new, following = of_texts([t.encode() for t in texts]), of_texts(edited), of_texts([t.encode() for t in after])
    near_edited, near_next = likeness(own, new).tolist(), likeness(own, following).tolist()
    return [
        (ids[i], len(texts[i]), hashlib.sha256(edited[i]).hexdigest(), own[i].tobytes().hex(), new[i].tobytes().hex(), near_edited[i], near_next[i])
        for i in range(len(ids))
    ]


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows of one part in order; all but the last are finished, the first and last text are kept."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for low, high in arrays.row_runs(batch.column(1), RUN_BYTES):
            ids, texts = (batch.column(i).slice(low, high - low).to_pylist() for i in (0, 1))
            rows = []
            if held is None:
                rows.append((ids[0], *[None] * 6, 1, part, texts[0]))
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            rows += [(*r, 0, part, None) for r in _pairs(ids[:-1], texts[:-1], texts[1:])]
            held = ids[-1], texts[-1]
            if rows:
                yield _batch(rows)
    if held is not None:
        yield _batch([(held[0], *[None] * 6, 2, part, held[1])])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, texts, after = ([batch.column(c)[i].as_py()] for c in range(3))
            row = _batch([(*_pairs(ids, texts, after)[0], 0, 0, None)])
            yield row.select(_NAMES[:7])


def compare_with_next(df: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``df``: its digest, and how like it are an edited copy's and the next document's.

    The next document follows in ascending doc_id; after the last comes the first. In the edited copy the
    last quarter of the code points is replaced by as many first ones of the next document, or all it has.
    NULL texts count as empty. Rows without an id come first; rows that share an id follow one another by
    the SHA-256 of their texts; a single row is its own successor; an empty table gives no rows. Other
    columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(size_of("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_bytes))
    # The row number only spreads equal rows, for which any order is right.
    keyed = docs.withColumn("_sha", F.sha2("text", 256)).withColumn("_no", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, "doc_id", "_sha", "_no").sortWithinPartitions("doc_id", "_sha", "_no")
    found = written(ordered.select("doc_id", "text").mapInArrow(_inside, f"{RESULT}, {EDGES}"), "digests")
    names = _NAMES[:7]
    ends = found.where("edge = 2").select("doc_id", "text", "part")
    heads = found.where("edge = 1").select("part", F.col("text").alias("after"))
    # One small row per part: as many as the partitions asked for above.
    around = heads.select("part").groupBy().agg(F.sort_array(F.collect_list("part")).alias("_all"))
    around = around.select(F.posexplode("_all").alias("_i", "part"), "_all")
    following = around.select("part", F.get("_all", F.expr("(_i + 1) % size(_all)")).alias("_next"))
    last = ends.join(following, "part").join(heads.withColumnRenamed("part", "_next"), "_next").select("doc_id", "text", "after")
    return found.where("edge = 0").select(names).unionByName(last.mapInArrow(_between, RESULT))
