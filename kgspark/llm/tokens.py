"""Token ids of whole texts by a vocabulary file, with every distinct unit of a batch encoded once.

A pre-tokenizer of these vocabularies never joins text across white space (but for one space before a
word), so a text falls into units whose ids follow one another: the ids of a text are those of its
units. Corpora repeat units, so a batch encodes its distinct units only and gathers the rest.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from kgspark.llm.arrays import IS_SPACE, distinct, row_runs, split_words, text_bytes

RUN_BYTES = 2 << 20
JOINED = 500  # units per text that goes to the library
KNOWN_BYTES = 80 << 20  # per worker; what is kept only saves encoding it again
KNOWN_UNIT = 64  # bytes of the longest unit kept
KNOWN_COST = 140  # bytes that an entry takes beside its unit
#: White space beyond ASCII's, as UTF-8, and the ASCII separators that some patterns count as white space.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")

_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Known:
    """Ids of units met before, by their bytes, until KNOWN_BYTES are held: frequent units come early."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.place = np.zeros(1 << 12, np.int64)  # where the ids begin in the pool
        self.size = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        while len(array) < size:
            array = np.concatenate([array, np.zeros_like(array)])
        return array

    def find(self, units: list[bytes]) -> np.ndarray:
        """Number of each unit, -1 where it is new."""
        get = self.number.get
        return np.array([get(u, -1) for u in units], np.int64)

    def add(self, units: list[bytes], pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        if self.held > KNOWN_BYTES:
            return
        some = [i for i, u in enumerate(units) if len(u) <= KNOWN_UNIT]
        n, first = len(some), len(self.number)
        self.number.update(zip([units[i] for i in some], range(first, first + n)))
        self.place, self.size = self._room(self.place, first + n), self._room(self.size, first + n)
        self.pool = self._room(self.pool, self.used + len(pool))
        self.pool[self.used:self.used + len(pool)] = pool
        self.place[first:first + n], self.size[first:first + n] = self.used + begin[some], size[some]
        self.used += len(pool)
        self.held += 4 * len(pool) + sum(len(units[i]) + KNOWN_COST for i in some)


class Encoder:
    """``Encoder(path, spaces)``: ``spaces`` says that white space counts (byte-level vocabularies)."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaces = spaces
        self.separator = b"\n" if spaces else b" \x01 "
        (self.separator_id,) = self.tokenizer.encode(self.separator.decode(), add_special_tokens=False).ids
        self.known = Known()

    def _units(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges of the units in order, and the first unit of each text."""
        words = split_words(flat, offsets, lower=False, hashed=False)
        if not self.spaces:
            return words.start, words.end, words.first
        data, edges = words.data, offsets - offsets[0]
        mark = np.zeros(len(data) + 1, bool)
        if len(words.start):
            opens = edges[:-1][words.doc]
            after_space = words.start > opens
            mark[words.start[after_space] - 1] = True  # one white space: joined to the word if it is a space
            before = np.where(after_space, data[np.maximum(words.start - 1, 0)], 0)
            mark[words.start[before != 0x20]] = True
            mark[words.end] = True  # the white space that follows a word
        mark[edges[:-1]] = True
        for i in self._odd(data, edges):  # such a text is one unit
            mark[edges[i]:edges[i + 1]] = False
            mark[edges[i]] = True
        mark[-1] = False
        start = np.flatnonzero(mark)
        return start, np.append(start[1:], len(data)), np.searchsorted(start, edges)

    @staticmethod
    def _odd(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if not _ODD_LEAD[data].any():
            return np.zeros(0, np.int64)
        at = [m.start() for m in _ODD_SPACE.finditer(data.tobytes())]
        return np.unique(np.searchsorted(edges, at, "right") - 1)

    def _alone(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which units must not be joined to others: white space, whole texts, and what has the separator in it."""
        marks = IS_SPACE[data]
        if self.spaces:
            marks[start] &= data[start] != 0x20  # one space before a word is part of the unit
            marks |= _ODD_LEAD[data]
        else:
            marks |= data == self.separator[1]
        upto = np.append(0, np.cumsum(marks))
        return (upto[end] - upto[start] > 0) | IS_SPACE[data[end - 1]]

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """Ids of new units, how many each has, and where they begin.

        Units go to the library in long texts, with a separator between them that is a token of its own
        and not part of any unit; units for which that does not hold are encoded ``alone``.
        """
        sizes, length = np.zeros(len(units), np.int64), np.array([len(u) for u in units], np.int64)
        ids, end = [], np.cumsum(length)
        alone = self._alone(np.frombuffer(b"".join(units), np.uint8), end - length, end)
        together = np.flatnonzero(~alone)
        for low in range(0, len(together), JOINED):
            some = together[low:low + JOINED]
            text = self.separator.join([units[i] for i in some.tolist()])
            found = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(found == self.separator_id)
            sizes[some] = np.diff(np.concatenate([[-1], cut, [len(found)]])) - 1
            ids.append(np.delete(found, cut))
        rest = np.flatnonzero(alone)
        for i in rest.tolist():
            ids.append(np.array(self.tokenizer.encode(units[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
            sizes[i] = len(ids[-1])
        order = np.concatenate([together, rest])
        pool = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        begin = np.zeros(len(units), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return pool, sizes, begin

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text's begin."""
        flat, offsets = text_bytes(column)
        start, end, first = self._units(flat, offsets)
        data = flat[offsets[0]:offsets[-1]]
        which, units = distinct(data, start, end)
        number = self.known.find(units)
        old = number >= 0
        new = [units[i] for i in np.flatnonzero(~old).tolist()]
        fresh, fresh_size, fresh_begin = self._learn(new)
        size, begin = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        size[old], size[~old] = self.known.size[number[old]], fresh_size
        begin[old], begin[~old] = self.known.place[number[old]], self.known.used + fresh_begin
        pool = np.concatenate([self.known.pool[:self.known.used], fresh])
        each = size[which]
        upto = np.cumsum(each)
        total = int(upto[-1]) if len(upto) else 0
        gathered = pool[np.repeat(begin[which] - (upto - each), each) + np.arange(total)]
        self.known.add(new, fresh, fresh_begin, fresh_size)
        return gathered, np.append(0, upto)[first]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder per worker and vocabulary."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]


def encode_rows(column: pa.Array, path: str, spaces: bool, end_id: int, run_bytes: int = RUN_BYTES):
    """For each row of ``column``: its number and its ids, followed by ``end_id``. Longer runs repeat more units."""
    for low, high in row_runs(column, run_bytes):
        ids, first = encoder(path, spaces).encode(column.slice(low, high - low))
        for i in range(high - low):
            yield low + i, np.append(ids[first[i]:first[i + 1]], np.uint32(end_id))
