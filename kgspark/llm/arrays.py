"""Texts of an Arrow batch as flat NumPy arrays: words, word hashes and hashes of word windows.

Words are runs of bytes other than ASCII white space (space and 0x09 to 0x0D), or other than the bytes a
caller names. Everything here works on one batch inside a task; callers cut batches into pieces of bounded
size with ``row_runs``. A word's hash is a seeded hash of its bytes; runs of words are hashed by
Rabin-Karp modulo the prime 2**61 - 1, which has no strings that collide whatever the base.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
BYTE_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
PRIME = (1 << 61) - 1
WORD_BASE = 0x1B873593D6E8FEB8 % PRIME
WORD_SEED = 0x5EED2025
_tables: dict[tuple[int, bool], np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Unused memory of this process to the system. Workers live on between tasks, and allocators keep what they freed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def giving_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` over batches, which gives back unused memory when it ends."""

    def giving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return giving


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grows by doubling."""
    table = _tables.get((base, False))
    if table is None or len(table) < n:
        steps = np.full(max(1 << 16, 1 << (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        table = _tables[base, False] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def fold(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for numbers below it, from products of 32-bit halves."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle, small = a1 * b0 + a0 * b1, a0 * b0  # below 2**62 and 2**64
    upper = (a1 * b1 << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half)
    return fold(upper + (small & np.uint64(PRIME)) + (small >> np.uint64(61)))


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; the table is kept and grows by doubling."""
    table = _tables.get((base, True))
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < n:
        step = np.uint64(pow(base, len(table), PRIME))
        table = np.concatenate([table, times(table, np.full(len(table), step))])
    _tables[base, True] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each starts; NULL counts as empty."""
    array = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def row_runs(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together, one row at least."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield low, high
        low = high


@dataclass
class Words:
    """Words of several texts: byte ranges, text number and hash of each, first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_hashes(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, from which ``range_hashes`` reads any range.

    For short ranges only: modulo a power of two, every odd base has equal sums for some strings of 1024.
    """
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end], the same wherever the range stands."""
    back = powers(inverse(base), len(sums))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(BYTE_BASE))


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct ones of the byte strings data[start:end], and for each string which it is.

    Strings stand in order and do not overlap. They are told apart by their bytes, not by hashes.
    """
    if not len(start):
        return np.zeros(0, np.int64), []
    if (start[1:] == end[:-1]).all():
        solid = data[start[0]:end[-1]]
    else:
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        solid = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(solid))])
    found = column.dictionary_encode()
    _, place, held = found.dictionary.buffers()
    raw, cuts = held.to_pybytes(), np.frombuffer(place, np.int64)[:len(found.dictionary) + 1].tolist()
    return found.indices.to_numpy().astype(np.int64), [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Seeded 64-bit hashes of the byte strings data[start:end], each distinct one hashed once."""
    which, values = distinct(data, start, end)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values, repeat(WORD_SEED)), np.uint64, len(values))[which]


def split_words(flat: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool = True, gaps: np.ndarray = IS_SPACE) -> Words:
    """Words of the texts flat[offsets[i]:offsets[i + 1]], with A-Z in lower case if asked.

    ``gaps[b]`` says whether byte b stands between words.
    """
    low = offsets[0]
    data = flat[low:offsets[-1]]
    edges = offsets - low
    if lower:
        data = _LOWER[data]
    solid = np.zeros(len(data) + 2, bool)  # one place of white space on either side
    solid[1:-1] = ~gaps[data]
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = edges[:-1][(edges[:-1] < edges[1:])]  # words never cross from one text to the next
    begins[inner] = solid[1:-1][inner]
    ends[inner[1:] - 1] = solid[1:-1][inner[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, edges)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(first))
    found = byte_hashes(data, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(data, start, end, doc, found, first)


def _word_sums(words: Words) -> np.ndarray:
    """Prefix sums of hash[i] * WORD_BASE**i modulo PRIME; halves are summed apart, so that nothing overflows."""
    terms = times(fold(words.hash), prime_powers(WORD_BASE, len(words.hash)))
    sums = np.zeros(len(terms) + 1, np.uint64)
    high, low = np.cumsum(terms >> np.uint64(31)), np.cumsum(terms & np.uint64((1 << 31) - 1))
    high = fold(high)
    high = fold((high << np.uint64(31) & np.uint64(PRIME)) + (high >> np.uint64(30)))  # times 2**31
    sums[1:] = fold(high + fold(low))
    return sums


def _word_ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash modulo PRIME of the words start:end, the same wherever they stand."""
    back = prime_powers(pow(WORD_BASE, -1, PRIME), len(sums))
    found = times(fold(sums[end] + np.uint64(PRIME) - sums[start]), back[start])
    return mix(found + (end - start).astype(np.uint64) * np.uint64(BYTE_BASE))


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words that lies within one text."""
    n = len(words.hash)
    last = words.first[1:][words.doc] if n else words.first[:0]
    at = np.flatnonzero(np.arange(n) + size <= last)
    return at, _word_ranges(_word_sums(words), at, at + size)


def run_hashes(words: Words) -> np.ndarray:
    """Hash of all words of each text as one sequence."""
    return _word_ranges(_word_sums(words), words.first[:-1], words.first[1:])
