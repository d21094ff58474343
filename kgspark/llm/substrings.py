"""Removal of word windows that occur more than once anywhere in the corpus.

Every run of ``size`` words of every document gets a Rabin-Karp hash (prefix sums of word hashes times
powers of a base, so each window costs a subtraction and a product). The hashes are counted over the
whole corpus through ``exchange``; all words under a window that occurs again go, which merges windows
into maximal removal intervals.

Windows count as equal when their 64-bit hashes are; over n windows about n**2 / 2**65 chance pairs are
expected, 0.0004 over a hundred million windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import arrays
from kgspark.llm.exchange import PART_BYTES, bucket_slices, dump, load, part_count, with_parts

SIZE = 35
RUN_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _windows(column: pa.Array, size: int) -> tuple[arrays.Words, np.ndarray, np.ndarray]:
    words = arrays.split_words(*arrays.text_bytes(column), lower=False)
    return words, *arrays.window_hashes(words, size)


def _one(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.array([], kind)


def remove_repeats(df: DataFrame, size: int = SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``df``: its words, those kept, and the removed word intervals (end exclusive).

    Windows are judged on the input. A repeat inside one document counts, overlapping itself or not.
    NULL and empty texts have no words and keep the empty string; documents shorter than a window keep
    everything; of repeated rows every copy loses what is repeated; an empty table gives no rows.
    Other columns are ignored. ``kept_text`` holds kept words joined by one space.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = part_count(docs, part_bytes)
    docs = with_parts(docs, parts)
    buckets = parts

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, _, hashes = _windows(_one(table, "text", pa.string()), size)
        keys = np.unique(hashes)
        found, bounds = bucket_slices(keys, buckets)
        blobs = [dump(keys[a:b], ascending=True) for a, b in zip(bounds, bounds[1:])]
        return pa.table({
            "bucket": pa.array(found, pa.int64()), "asker": pa.array([key[0].as_py()] * len(found), pa.int64()),
            "keys": pa.array(blobs, pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [load(x.as_py(), ascending=True) for x in table.column("keys")]
        every = np.sort(np.concatenate(asked))
        shared = np.unique(every[1:][every[1:] == every[:-1]])  # asked for by two parts at least
        flags = []
        for keys in asked:
            at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
            flags.append(np.packbits(shared[at] == keys if len(shared) else np.zeros(len(keys), bool)).tobytes())
        n = len(flags)
        return pa.table({
            "part": table.column("asker"), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "flags": pa.array(flags, pa.binary()),
        })

    def apply(texts: pa.Table, answers: pa.Table) -> pa.Table:
        column = _one(texts, "text", pa.string())
        words, at, hashes = _windows(column, size)
        keys, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        found, bounds = bucket_slices(keys, buckets)
        told = {b.as_py(): f.as_py() for b, f in zip(answers.column("bucket"), answers.column("flags"))}
        repeated = counts > 1
        for b, low, high in zip(found.tolist(), bounds, bounds[1:]):
            repeated[low:high] |= np.unpackbits(np.frombuffer(told[b], np.uint8), count=high - low).astype(bool)
        starts = at[repeated[which]] if len(at) else at
        cover = np.zeros(len(words.start) + 1, np.int64)
        cover[starts] += 1
        cover[starts + size] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        out = {name.split()[0]: [] for name in RESULT.split(", ")}
        raw = words.data.tobytes()
        for i in range(len(column)):
            a, b = words.first[i], words.first[i + 1]
            kept = np.flatnonzero(~gone[a:b]) + a
            text = b" ".join([raw[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist())])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
            out["n_words"].append(int(b - a))
            out["n_removed"].append(int(b - a - len(kept)))
            out["kept_text"].append(text.decode())
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["removed"].append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
        out["doc_id"] = texts.column("doc_id")
        kinds = {"removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string(), "kept_sha256": pa.string()}
        return pa.table({k: v if k == "doc_id" else pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    asked = docs.groupBy("part").applyInArrow(ask, "bucket long, asker long, keys binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "part long, bucket long, flags binary")
    return docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(apply, RESULT)
