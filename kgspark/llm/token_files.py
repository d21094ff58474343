"""Token ids in binary blocks with one shared zstandard dictionary, made to read single short documents.

A dictionary is trained on the serialised ids of a bounded sample of documents. Every document is one
zstandard frame of its own against that dictionary. Frames stand in blocks; a block is bytes that
describe themselves: the dictionary's hash, ids and token counts of its documents, and the offset of
every frame, so one document is read without unpacking its neighbours.

Layout of a block, little-endian::

    magic "KTOK1\\0"    6 bytes
    width              uint16     bytes of one token id: 2 or 4
    documents          uint32
    dictionary         32 bytes   SHA-256 of the dictionary
    has id             uint8      for each document: 0 where its id is NULL
    doc ids            int64      for each document
    token counts       uint32     for each document
    offsets            uint64     for each document and one more, from the end of this header
    frames             ...

``write_tokens`` keeps blocks in a Parquet table of the store that Spark writes to (any store it can
reach), in ascending order of doc_id: ``blocks`` with part, block, ranges and ``data``, and
``dictionary`` with its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import hash_sample
from kgspark.llm.tokens import encode_rows

MAGIC = b"KTOK1\0"
HEAD = struct.Struct("<6sHI32s")
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 2_000  # the dictionary's training sample
SAMPLE_CHARS = 20_000  # of each of them, from a place set by its hash; the dictionary only decides about sizes
BLOCK_TOKENS = 1 << 20
RUN_BYTES = 5 << 20  # text encoded at once

BLOCKS = (
    "part int, block int, documents int, first_id long, last_id long, tokens_before long, tokens long, "
    "dictionary_hash string, data binary"
)
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def serialise(ids: np.ndarray, width: int) -> bytes:
    if width == 2 and len(ids) and ids.max() > 0xFFFF:
        raise ValueError("a token id does not fit into 2 bytes; write with width 4")
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(df: DataFrame, path: str, spaces: bool, end_id: int, width: int) -> bytes:
    """Dictionary for the ids of ``df``'s texts, from the SAMPLE_DOCUMENTS rows of smallest id hash.

    A corpus too small or too uniform to train on gets its sample's ids as a raw dictionary instead;
    an empty one an empty dictionary.
    """
    sample = hash_sample(df.select("doc_id", "text"), "doc_id", SAMPLE_DOCUMENTS)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    sample = sample.select(F.col("text").substr(place, F.lit(SAMPLE_CHARS)).alias("text")).coalesce(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        samples = []
        for batch in batches:
            samples += [serialise(ids, width) for _, ids in encode_rows(batch.column(0), path, spaces, end_id)]
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            found = b"".join(samples)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    found = sample.mapInArrow(train, "dictionary binary").first()
    return bytes(found[0]) if found else b""


def pack_block(doc_ids: list, ids: list[np.ndarray], dictionary: bytes, width: int) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    frames = [press.compress(serialise(x, width)) for x in ids]
    offsets = np.append(0, np.cumsum([len(f) for f in frames], dtype=np.uint64)).astype("<u8")
    return b"".join([
        HEAD.pack(MAGIC, width, len(frames), hashlib.sha256(dictionary).digest()),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), offsets.tobytes(), *frames,
    ])


class Block:
    """Opens a block's bytes; ``read(i)`` unpacks the ids of its i-th document only."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, self.width, n, digest = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        has = np.frombuffer(data, np.uint8, n, at)
        ids = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has)]
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n)
        self.body = memoryview(data)[at + 13 * n + 8 * (n + 1):]
        self._open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def read(self, i: int) -> np.ndarray:
        frame = self.body[int(self.offsets[i]):int(self.offsets[i + 1])]
        raw = self._open.decompress(frame)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype(np.uint32)


def write_tokens(df: DataFrame, folder: str, path: str, spaces: bool, end_id: int, width: int = 2) -> None:
    """Writes the ids of ``df.text`` (each followed by ``end_id``) as blocks in order of ``doc_id``.

    NULL and empty texts hold the end id alone; rows with equal ids stand side by side, ordered by text;
    rows without an id come first; an empty table gives no blocks. Other columns are ignored.
    """
    spark = df.sparkSession
    dictionary = train_dictionary(df, path, spaces, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    one = spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary_hash string, dictionary binary")
    one.coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            row = (part, block, len(ids), doc_ids[0], doc_ids[-1], before, held, digest, pack_block(doc_ids, ids, dictionary, width))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i, found in encode_rows(batch.column(1), path, spaces, end_id, RUN_BYTES):
                doc_ids.append(numbers[i])
                ids.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    doc_ids, ids, block, before, held = [], [], block + 1, before + held, 0
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Reads every document back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The dictionary is bounded (DICTIONARY_BYTES) and goes to the tasks with the function. Each part
    needs one number from outside, the ids of the parts before it: one small row per part.
    """
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    blocks = spark.read.parquet(f"{folder}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("tokens").alias("_t"))
    before = F.sum("_t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = blocks.join(F.broadcast(offsets), "part")
    placed = placed.select((F.col("_before") + F.col("tokens_before")).alias("at"), "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(data.as_py(), dictionary)
                counts = block.counts.astype(np.int64)
                starts = at + np.cumsum(counts) - counts
                sums = [zlib.crc32(block.read(i).astype("<u4").tobytes()) for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(decode, DECODED)
