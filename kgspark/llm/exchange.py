"""Questions about corpus-wide counts, asked and answered in bulk.

Some operators need, for every word or window of every document, a number that depends on all documents.
One row per occurrence would multiply the corpus. Here documents are dealt into parts of bounded size by
a hash; a part asks once for each distinct key, as sorted 64-bit hashes cut into buckets by their high
bits; a bucket is answered in one task from what all parts sent to it; and answers come back to the part
in the order in which it asked. Frequent keys cost one entry per part, so no key is hot.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import size_of

PART_BYTES = 4 << 20  # text per part: what a task holds at once; larger ones mean fewer, longer lists
LEAST_PARTS = 64  # so that small inputs, too, are dealt evenly


def part_count(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    total = df.agg(F.sum(size_of("text"))).first()[0] or 0
    return max(LEAST_PARTS, math.ceil(total / part_bytes))


def with_parts(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``. The text takes part in the hash, so rows that share an id still spread."""
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))


def bucket_slices(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct keys: the buckets that have any, and the bounds of their slices."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    found, first = np.unique(of, return_index=True)
    return found.astype(np.int64), np.append(first, len(keys))


def dump(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as byte planes (of their steps, if ascending): high bytes that are mostly zero compress away."""
    values = values.astype("<u8")
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def load(raw: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ascending else values
