"""Packing documents into fixed windows by best fit, longest piece first.

Overlong documents are cut into full windows and one rest. Pieces are then placed in order of falling
length, each into the open window with the least room that still holds it, or else into a new window. A
segment tree over room sizes finds that window.

What decides the result is how many pieces each length has, not which ones they are: at most
``capacity`` numbers. The placement runs over those numbers with runs of equal windows as its unit, so
its cost does not grow with the corpus; it yields a plan of bounded size. Spark counts lengths, numbers
the pieces by length, and each piece finds its place in the plan by its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.arrays import giving_back
from kgspark.llm.common import cut_lineage, number_rows
from kgspark.llm.tokens import encode_rows

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class Rooms:
    """Segment tree over room sizes 0..capacity: which sizes have open windows, the least one first."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.leaves, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node = self.leaves + room
        self.tree[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if count:
            self.runs[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, least: int) -> int | None:
        """Smallest room of at least ``least`` that has an open window."""
        node = self.leaves + least
        if self.tree[node]:
            return least
        while node > 1:  # up until a right sibling holds something, then down its left edge
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Plan for ``counts[length]`` pieces of each length, numbered from 0 by falling length.

    One row per run of pieces: number of its first piece, first window, pieces per window, offset of the
    first piece in its window, length. Piece ``first + j`` goes to window ``window + j // per`` at
    ``offset + j % per * length``.

    Of several windows with the tightest room, which is taken does not matter: they are alike. A window
    that has taken a piece is tighter than before, so it keeps taking pieces of that length while it can.
    """
    rooms, plan, number, windows = Rooms(capacity), [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:  # open as many windows as the rest needs, filled one after another
                room, fresh = capacity, -(-left // (capacity // length))
                first, count = windows, fresh
                windows += fresh
            else:
                first, count = rooms.take(room)
            per = room // length
            full = min(count, left // per)
            if full:
                plan.append((number, first, per, capacity - room, length))
                rooms.put(room - per * length, first, full)
                number, left = number + full * per, left - full * per
            if full < count and left:  # fewer pieces than a window of this run still takes
                plan.append((number, first + full, left, capacity - room, length))
                rooms.put(room - left * length, first + full, 1)
                number, left, full = number + left, 0, full + 1
            rooms.put(room, first + full, count - full)
    return np.array(plan, np.int64).reshape(-1, 5)


def cut_documents(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, spaces: bool = False, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full windows and a rest, with the checksum of their ids.

    NULL text counts as empty: one piece that holds the end id alone. With ``with_ids`` a column ``ids``
    holds the token ids. Other columns of ``df`` are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, out, kept = batch.column(0).to_pylist(), [], []
            for i, ids in encode_rows(batch.column(1), path, spaces, end_id):
                ids = ids.astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    out.append((doc_ids[i], start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        kept.append(piece)
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{PIECES}, ids array<int>" if with_ids else PIECES
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(cut), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length`` (1..capacity each).

    Offsets are gapless within a sequence, sequence ids gapless from 0. Equal pieces each get a place of
    their own, an empty table gives no rows.
    """
    pieces = cut_lineage(pieces)
    lengths = pieces.groupBy("length").count().collect()  # one row per length: at most ``capacity``
    plan = best_fit({r["length"]: r["count"] for r in lengths}, capacity)
    numbered = number_rows(pieces.withColumn("_falling", -F.col("length")), ["_falling", "doc_id", "start"], "_no").drop("_falling")
    names = [c for c in numbered.columns if c != "_no"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(batch.schema.get_field_index("_no")).to_numpy()
            row = plan[np.searchsorted(plan[:, 0], number, "right") - 1]
            nth = number - row[:, 0]
            sequence, offset = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * row[:, 4]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_no")
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Packed training sequences of pieces that carry ``ids``: sequence_id, ids padded to ``capacity``.

    A group is one window, so it never holds more than ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    padding = F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"))
