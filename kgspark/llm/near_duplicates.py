"""Groups of near-duplicate documents: word-shingle sets with a Jaccard similarity at or above a threshold.

1. Each document gets its set's size, a SetSketch and a fingerprint of the set. Documents with equal sets
   are one class, named by its smallest id; only classes go on.
2. Bands of registers put classes into buckets; similar classes share a bucket almost surely.
3. In each bucket all members are compared with its centre, the member with the most company, on full
   sets. Links found make components, so a large group of copies costs one comparison per member.
4. Where a bucket still holds several components, pairs across them are compared: first by sketches, for
   which the likelihood of the joint registers estimates the similarity, then, unless that is far below
   the threshold, on full sets. Such buckets are cut into blocks and compared block by block; a pair is
   looked at in the first bucket it shares. No pair is dropped for the size of its bucket.

With 32 bands of 4 registers a pair of similarity 0.8 shares no bucket once in 20 million cases, and its
estimate falls below the margin (4.5 standard errors) once in 200,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm import arrays, setsketch
from kgspark.llm.common import cut_lineage, written
from kgspark.llm.exchange import LEAST_PARTS

RUN_BYTES = 1 << 20
BLOCK = 256  # members of a bucket compared with each other at once
TILE_BYTES = 16 << 20  # sets compared with each other at once, as 8 bytes per shingle
LUMP = 2_000  # rows that travel together to one Python call
LUMP_BYTES = 32 << 20  # and sets that do
MOST_TASKS = 20_000
MARGIN = 4.5


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in a row and sorted within a text, and where each text's begin."""
    words = arrays.split_words(*arrays.text_bytes(column), lower=True)
    at, hashes = arrays.window_hashes(words, size)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    doc = np.concatenate([words.doc[at], short])
    hashes = np.concatenate([hashes, arrays.run_hashes(words)[short]])
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(column) + 1))
    hashes = hashes[order]
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
    first = np.append(0, np.cumsum([len(s) for s in sets], dtype=np.int64))
    return (np.concatenate(sets) if sets else hashes), first


def _prints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set; 0 for empty sets."""
    some, out = np.flatnonzero(np.diff(first)), np.zeros((2, len(first) - 1), np.uint64)
    for j, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F) if len(some) else ()):
        out[j, some] = np.add.reduceat(arrays.mix(hashes ^ np.uint64(salt)), first[some])
    return out


def _sketch(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.row_runs(batch.column(1), RUN_BYTES):
                hashes, first = shingle_sets(batch.column(1).slice(low, high - low), size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                registers, prints = [None] * len(n), _prints(hashes, first)
                if len(some):
                    starts = np.append(first[some], len(hashes))
                    for i, row in zip(some.tolist(), setsketch.sketches(hashes, starts)):
                        registers[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                     pa.array(registers, pa.binary())],
                    ["doc_id", "n_shingles", "print1", "print2", "sketch"],
                )

    return arrays.giving_back(sketch)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("sketch")]).reshape(-1, setsketch.REGISTERS)
        keys = setsketch.bands(rows)
        count = keys.shape[1]
        band = np.tile(np.arange(count, dtype=np.int32), len(keys))
        keys = arrays.mix(keys.ravel() ^ arrays.mix(band.astype(np.uint64) + np.uint64(1))).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(band), pa.array(np.repeat(batch.column("rep").to_numpy(), count)), pa.array(np.repeat(batch.column("n").to_numpy(), count))],
            ["bucket", "band", "rep", "n"],
        )


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.row_runs(batch.column(1), RUN_BYTES):
                hashes, first = shingle_sets(batch.column(1).slice(low, high - low), size)
                blobs = [hashes[a:b].tobytes() for a, b in zip(first, first[1:])]
                prints = [pa.array(p.view(np.int64)) for p in _prints(hashes, first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(blobs, pa.binary()), *prints], ["member", "shingles", "print1", "print2"])

    return arrays.giving_back(sets)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b``: node and component, its smallest node. Isolated nodes don't appear.

    Every node takes the least label around it, then the label of its label, until nothing changes; long
    chains halve with every turn. All steps are joins and partial aggregations on written tables.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("around"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "around").alias("least"))
        far = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        moved = near.join(far, "least", "left").select("node", F.col("label").alias("old"), F.least("least", "far").alias("label"))
        moved = written(moved, "labels")
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def _compare(per_cent: int):
    """Task function: pairs whose full sets are similar enough, from tiles of members and pair lists."""

    def compare(key: tuple, tiles: pa.Table, members: pa.Table) -> pa.Table:
        sets = {}
        for member, blob in zip(members.column("member").to_pylist(), members.column("shingles")):
            if member not in sets:
                sets[member] = np.frombuffer(blob.as_py(), np.uint64)
        found_a, found_b = [], []
        for names, left, right in zip(tiles.column("members"), tiles.column("lefts"), tiles.column("rights")):
            names = names.values.to_pylist()
            for i, j in zip(left.values.to_pylist(), right.values.to_pylist()):
                a, b = sets[names[i]], sets[names[j]]
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= per_cent * (len(a) + len(b) - common):
                    found_a.append(names[i])
                    found_b.append(names[j])
        del sets
        arrays.give_back()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return compare


def lump_count(rows: int, size: int = 0) -> int:
    return max(LEAST_PARTS, math.ceil(rows / LUMP), math.ceil(size / LUMP_BYTES))


def verified(tiles: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links among the pairs of ``tiles`` (members, lefts, rights: pairs as positions in members; bytes of the sets).

    Tiles travel in lumps of about LUMP sets and LUMP_BYTES; a set goes once to each lump that needs it. Lumps
    are tasks of their own: what they cost is not seen in the bytes that are shuffled.
    """
    tiles = cut_lineage(tiles)
    total = tiles.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    lumps = lump_count(*total)
    lumped = tiles.withColumn("lump", F.pmod(F.xxhash64("members", "lefts"), F.lit(lumps)))
    needed = lumped.select(F.col("lump").alias("to"), F.explode("members").alias("member")).distinct().join(sets, "member")
    tasks = min(lumps, MOST_TASKS)
    left, right = lumped.repartition(tasks, "lump"), needed.repartition(tasks, "to")
    return left.groupBy("lump").cogroup(right.groupBy("to")).applyInArrow(_compare(per_cent), "a long, b long")


def _across(threshold: float):
    """Task function: pairs across components in blocks of buckets whose sketches do not rule them out."""
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / setsketch.REGISTERS)

    def across(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending")])
        tile = np.stack([table.column(c).to_numpy() for c in ("bucket", "low", "high")])
        cuts = np.append(0, np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0)) + 1)
        reps, comps, n, block, band = (table.column(c).to_numpy() for c in ("rep", "component", "n", "block", "band"))
        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)
        keys = setsketch.bands(rows)
        members, lefts, rights, size = [], [], [], []
        for a, b in zip(cuts, [*cuts[1:], len(reps)]):
            same = tile[1, a] == tile[2, a]
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
            fit = (comps[i] != comps[j]) & (100 * np.minimum(n[i], n[j]) >= 100 * threshold * np.maximum(n[i], n[j]) - 1e-6)
            if not same:
                fit &= block[i] != block[j]
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            first = np.argmax(keys[i] == keys[j], axis=1) == band[a]
            i, j = i[first], j[first]
            more, less = (rows[i] > rows[j]).sum(1), (rows[i] < rows[j]).sum(1)
            may = (setsketch.REGISTERS - more - less) >= (least - 0.1) * setsketch.REGISTERS
            i, j, more, less = i[may], j[may], more[may], less[may]
            good = setsketch.similarity(more, less, n[i], n[j]) >= least
            i, j = i[good], j[good]
            if len(i):
                used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                members.append(reps[used].tolist())
                size.append(8 * int(n[used].sum()))
                lefts.append(at[:len(i)].tolist())
                rights.append(at[len(i):].tolist())
        return pa.table({
            "members": pa.array(members, pa.list_(pa.int64())), "lefts": pa.array(lefts, pa.list_(pa.int32())),
            "rights": pa.array(rights, pa.list_(pa.int32())), "bytes": pa.array(size, pa.int64()),
        })

    def giving(key: tuple, table: pa.Table) -> pa.Table:
        found = across(key, table)
        arrays.give_back()
        return found

    return giving


TILES = "members array<long>, lefts array<int>, rights array<int>, bytes long"


def _spread(members: Column, size: Column) -> Column:
    """Blocks that members with sets of so many shingles are cut into."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(size * 8 / TILE_BYTES))


def near_duplicates(df: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (smallest id of its group), kept.

    Words are runs without ASCII white space, A-Z in lower case; a set holds the distinct runs of ``size``
    words, or all words of a shorter text as one. NULL, empty and blank texts have no set, link with
    nothing and are kept. Linked are sets with ``100 * |both| >= per_cent * |either|``. Rows that share
    an id count as one document; if their sets differ, the one with the least fingerprint stands for it.
    Rows without an id link with nothing, have no component and are kept.
    An empty table gives no rows. Other columns are ignored.
    """
    shingle = size
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut_lineage(docs.mapInArrow(_sketch(size), "doc_id long, n_shingles long, print1 long, print2 long, sketch binary"))
    named = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    print_of = F.struct("print1", "print2", "n_shingles")
    split = named.groupBy("doc_id").agg(F.min(print_of).alias("_least"), F.max(print_of).alias("_most")).where("_least <> _most")
    split = written(split.select("doc_id", "_least"), "split")  # ids whose rows have different sets
    sketched = sketched.join(split, "doc_id", "left")
    named = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0) & (F.col("_least").isNull() | (F.col("_least") == print_of)))
    classes = named.groupBy("print1", "print2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(classes.select("print1", "print2", F.col("n_shingles").alias("n"), "rep", "sketch"))
    banded = classes.select("rep", "n", "sketch").mapInArrow(arrays.giving_back(_band_rows), "bucket long, band int, rep long, n long")
    # Sums per bucket or centre are written before they are joined: a join of two shuffled tables can be
    # split where a key is hot, one with an aggregation on top of its shuffle cannot.
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")).where("members > 1")
    buckets = cut_lineage(banded.join(written(shared, "buckets"), "bucket"))
    company = buckets.groupBy("rep").agg(F.sum("members").alias("company"))
    centre = buckets.join(company, "rep").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("neg"), "n")).alias("c"))
    stars = buckets.join(written(centre, "centres"), "bucket")
    stars = stars.select("rep", "n", (-F.col("c.neg")).alias("centre"), F.col("c.n").alias("centre_n"))
    fits = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * per_cent
    stars = cut_lineage(stars.where((F.col("rep") != F.col("centre")) & fits).distinct())
    loads = stars.groupBy("centre").agg(_spread(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    dealt = stars.join(written(loads, "loads"), "centre").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    # Grouped by a key of its own, so that the join on a centre with much company can be split.
    dealt = dealt.withColumn("tile", F.xxhash64("centre", "block"))
    size = (F.sum("n") + F.min("centre_n")) * 8
    tiles = dealt.groupBy("tile", "block").agg(F.min("centre").alias("centre"), F.collect_list("rep").alias("reps"), size.alias("bytes"))
    tiles = tiles.select(
        F.concat(F.array("centre"), "reps").alias("members"), F.expr("transform(reps, x -> 0)").alias("lefts"),
        F.expr("transform(reps, (x, i) -> i + 1)").alias("rights"), "bytes",
    )
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), "member long, shingles binary, print1 long, print2 long")
    stands = split.select(F.col("doc_id").alias("member"), F.col("_least.print1").alias("_p1"), F.col("_least.print2").alias("_p2"))
    sets = sets.join(stands, "member", "left").where("_p1 IS NULL OR (_p1 = print1 AND _p2 = print2)")
    sets = cut_lineage(sets.select("member", "shingles"))
    links = cut_lineage(verified(tiles, sets, per_cent))
    found = components(links)

    labelled = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = cut_lineage(labelled)
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b")
    mixed = written(mixed.select("bucket"), "mixed")
    open_rows = labelled.join(mixed, "bucket").join(classes.select("rep", "sketch"), "rep")
    blocks = _spread(F.col("members"), F.col("size")).cast("int")
    open_rows = open_rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    open_rows = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    open_rows = open_rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "members", "size")
    # Every row of a mixed bucket meets all blocks of it.
    lumps = lump_count(labelled.join(mixed, "bucket").agg(F.coalesce(F.sum(blocks), F.lit(0))).first()[0])
    open_rows = open_rows.withColumn("lump", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(lumps)))
    tiles = open_rows.repartition(min(lumps, MOST_TASKS), "lump").groupBy("lump").applyInArrow(_across(per_cent / 100), TILES)
    more = verified(tiles, sets, per_cent)
    first = found.select(F.col("node"), "component")
    ends = [first.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b")]
    more = more.join(ends[0], "a", "left").join(ends[1], "b", "left")
    more = more.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    second = components(more).select(F.col("node").alias("_first"), F.col("component").alias("_second"))

    final = classes.select("print1", "print2", F.col("n").alias("n_shingles"), "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.withColumn("_first", F.coalesce("component", "rep")).join(second, "_first", "left")
    final = final.select("print1", "print2", "n_shingles", F.coalesce("_second", "_first").alias("_group"))
    keys = ["print1", "print2", "n_shingles"]
    out = sketched.select("doc_id", F.col("n_shingles").alias("_own"), *[F.coalesce(f"_least.{c}", c).alias(c) for c in keys])
    out = out.join(final, keys, "left").drop("n_shingles").withColumnRenamed("_own", "n_shingles")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("_group", "doc_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))
