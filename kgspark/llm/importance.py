"""Importance resampling towards a target corpus, by hashed runs of one to three words.

A feature is a run of one to three words, joined by one space; its bucket is its CRC-32 modulo BUCKETS. How
often each bucket occurs in all documents and in the target gives a gain per bucket; the gains of a
document's features add up to its weight, and Gumbel noise from its id turns weights into a draw without
replacement.

CRC-32 is linear: the CRC of two strings one after the other follows from both CRCs and the length of the
second. So a run's CRC is put together from its words' states, and no run is ever spelt out. The vocabulary
has a head and a tail. The head (frequent words with their states, and frequent pairs with their buckets) is
found once over the corpus and broadcast, bounded by HEAD_WORDS, HEAD_PAIRS and WORD_BYTES; words outside it
take their CRC directly, pairs outside it from their words' states. Both ways give the same buckets, so the
head decides about speed only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm import arrays
from kgspark.llm.common import number_rows, written

BUCKETS = 10_000
RUN = 3  # words of the longest feature
HEAD_WORDS = 16_384
HEAD_PAIRS = 16_384
WORD_BYTES = 64  # longer words are never in the head
SHARE = 1e-5  # of a run's words: what is rarer in every run is not frequent
LEAST_WORDS = 20
PER_CENT = 5
SEED = "42"
RUN_BYTES = 4 << 20
TABLED = 64  # lengths up to here are shifted by one table
POLYNOMIAL = 0xEDB88320

#: Bytes between words, once A-Z are in lower case: all of ASCII but digits and letters.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given for each byte's place and value."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that carry a CRC over n zero bytes: for n up to TABLED, and for n = 1, 2, 4 and so on."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1)
    place = np.arange(256, dtype=np.uint32)
    tables = [np.stack([place << np.uint32(8 * j) for j in range(4)])]
    for _ in range(TABLED):
        tables.append(tables[-1] >> 8 ^ step[tables[-1] & 255])
    doubled = [tables[1]]
    for _ in range(40):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(tables), doubled


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs (uint32) carried over ``length`` bytes: ``shifted(crc(a), len(b)) ^ crc(b)`` is crc(a + b)."""
    tables, doubled = _shifts()
    flat, at = tables.ravel(), np.minimum(length, TABLED) * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> 8 & 255)] ^ flat[at + 512 + (crc >> 16 & 255)] ^ flat[at + 768 + (crc >> 24)]
    left = length - TABLED
    far = np.flatnonzero(left > 0)
    for bit in range(int(left[far].max(initial=0)).bit_length()):
        some = far[left[far] >> bit & 1 == 1]
        out[some] = _apply(doubled[bit], out[some])
    return out


class Head:
    """Frequent words with their CRC states, and frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.state = np.array([(zlib.crc32(w), zlib.crc32(b" " + w)) for w in words], np.uint32).reshape(-1, 2)
        known = [(self.number[a] * len(words) + self.number[b], zlib.crc32(p) % BUCKETS) for p in pairs for a, b in [p.split(b" ")] if a in self.number and b in self.number]
        known.sort()
        self.pairs = np.array([k for k, _ in known], np.int64)
        self.buckets = np.array([b for _, b in known], np.int64)

    def states(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its number in the head (-1: tail), and its CRC alone and after a space."""
        number = np.array([self.number.get(w, -1) for w in words], np.int64)
        state = np.empty((len(words), 2), np.uint32)
        state[number >= 0] = self.state[number[number >= 0]]
        for i in np.flatnonzero(number < 0).tolist():
            state[i] = zlib.crc32(words[i]), zlib.crc32(b" " + words[i])
        return number, state

    def pair_buckets(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Bucket of each pair of word numbers, -1 where the pair is not in the head."""
        out = np.full(len(first), -1)
        both = np.flatnonzero((first >= 0) & (second >= 0))
        if len(self.pairs) and len(both):
            key = first[both] * len(self.number) + second[both]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            out[both[hit]] = self.buckets[at[hit]]
        return out


def buckets_of(words: arrays.Words, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first word of every feature of the texts in ``words``."""
    which, values = arrays.distinct(words.data, words.start, words.end)
    if not len(which):
        return which, which
    number, state = (x[which] for x in head.states(values))
    length = words.end - words.start + 1  # with the space before
    last = words.first[1:][words.doc]
    at = [np.arange(len(which)), np.flatnonzero(np.arange(1, len(which) + 1) < last), np.flatnonzero(np.arange(2, len(which) + 2) < last)]
    alone, spaced = state[:, 0], state[:, 1]
    two = shifted(alone[at[1]], length[at[1] + 1]) ^ spaced[at[1] + 1]
    crc = np.zeros(len(which), np.uint32)
    crc[at[1]] = two
    three = shifted(crc[at[2]], length[at[2] + 2]) ^ spaced[at[2] + 2]
    pair = head.pair_buckets(number[at[1]], number[at[1] + 1])
    found = [alone % BUCKETS, np.where(pair >= 0, pair, two % BUCKETS), three % BUCKETS]
    return np.concatenate([f.astype(np.int64) for f in found]), np.concatenate(at)


def _words(column: pa.Array) -> arrays.Words:
    return arrays.split_words(*arrays.text_bytes(column), lower=True, hashed=False, gaps=GAPS)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: words and pairs that are frequent in a run of texts, with their counts there."""
    for batch in batches:
        for low, high in arrays.row_runs(batch.column(0), RUN_BYTES):
            words = _words(batch.column(0).slice(low, high - low))
            which, values = arrays.distinct(words.data, words.start, words.end)
            if not len(which):
                continue
            least = max(2, SHARE * len(which))
            short = np.array([len(v) <= WORD_BYTES for v in values])
            counts = np.bincount(which)
            some = np.flatnonzero((counts >= least) & short)
            at = np.flatnonzero(words.doc[:-1] == words.doc[1:])
            pairs, times = np.unique(which[at] * len(values) + which[at + 1], return_counts=True)
            first, second = np.divmod(pairs, len(values))
            good = np.flatnonzero((times >= least) & short[first] & short[second])
            terms = [values[i] for i in some.tolist()] + [values[i] + b" " + values[j] for i, j in zip(first[good].tolist(), second[good].tolist())]
            size = np.repeat([1, 2], [len(some), len(good)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(size, pa.int32()), pa.array(terms, pa.binary()), pa.array(np.concatenate([counts[some], times[good]]))], ["size", "term", "n"]
            )


def head_of(docs: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The frequent words and pairs of all texts, the most frequent first, HEAD_WORDS and HEAD_PAIRS at most.

    A word that makes up SHARE of all words does so in some run of texts, so it is counted there.
    """
    counts = docs.select("text").mapInArrow(_frequent, "size int, term binary, n long")
    counts = counts.groupBy("size", "term").agg(F.sum("n").alias("n"))
    counts = written(counts, "frequent")
    return tuple(
        [bytes(r[0]) for r in counts.where(F.col("size") == size).orderBy(F.desc("n"), "term").limit(most).select("term").collect()]
        for size, most in ((1, HEAD_WORDS), (2, HEAD_PAIRS))
    )


def bucket_counts(docs: DataFrame, words: list[bytes], pairs: list[bytes]) -> DataFrame:
    """How often each bucket occurs in all texts: bucket, n. Tasks add up their own texts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sums = Head(words, pairs), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for low, high in arrays.row_runs(batch.column(0), RUN_BYTES):
                found, _ = buckets_of(_words(batch.column(0).slice(low, high - low)), head)
                sums += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """Gain of every bucket from both counts (bucket, n): thousandths of the log of the smoothed ratio, rounded down."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    every = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    every = every.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    every = every.crossJoin(every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))  # one row of sums
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def weights(docs: DataFrame, words: list[bytes], pairs: list[bytes], gain: np.ndarray) -> DataFrame:
    """One row per row of ``docs``: its words, features, and the sum of their buckets' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(words, pairs)
        for batch in batches:
            for low, high in arrays.row_runs(batch.column(1), RUN_BYTES):
                found = _words(batch.column(1).slice(low, high - low))
                buckets, at = buckets_of(found, head)
                n = found.counts()
                per_word = np.zeros(len(found.start) + 1, np.int64)
                for low_at, high_at in zip(*_thirds(at)):
                    per_word[1:][at[low_at:high_at]] += gain[buckets[low_at:high_at]]
                upto = np.cumsum(per_word)
                features = sum(np.maximum(n - i, 0) for i in range(RUN))
                columns = [batch.column(0).slice(low, high - low), *map(pa.array, (n, features, upto[found.first[1:]] - upto[found.first[:-1]]))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WEIGHTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, WEIGHTS)


def _thirds(at: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the features of each length lie in ``at``: first words ascend within a length."""
    cuts = (np.flatnonzero(np.diff(at) <= 0) + 1).tolist()
    return [0, *cuts], [*cuts, len(at)]


def noise(doc_id: str | Column = "doc_id", seed: str = SEED) -> Column:
    """Thousandths of a standard Gumbel variable drawn by the id's hash, rounded down."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(df: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_features, weight, score, and rank for the drawn ones.

    Drawn are ``per_cent`` of the documents with ``least_words`` words, rounded down: those with the
    highest scores, ties by the smaller id (rows without an id first). NULL and empty texts have no
    features and weight 0; repeated rows count and are drawn each; an empty target is one without
    features; an empty table gives no rows. Other columns are ignored.
    """
    words, pairs = head_of(df)
    gain = gains(bucket_counts(df, words, pairs), bucket_counts(target, words, pairs)).orderBy("bucket").collect()  # BUCKETS rows
    scored = weights(df, words, pairs, np.array([r["gain"] for r in gain], np.int64))
    scored = written(scored.withColumn("score", F.col("weight") + noise()), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = per_cent * able.count() // 100
    # The row number only spreads rows that are equal in both, for which any order is right.
    placed = able.withColumn("_fall", -F.col("score")).withColumn("_no", F.monotonically_increasing_id())
    placed = number_rows(placed, ["_fall", "doc_id", "_no"])
    rank = F.when(F.col("row_no") < drawn, F.col("row_no") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    few = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(few)
