"""How the sources of a language differ in their words, from run-length coded columns of counts.

Every language keeps the terms of LEAST_DOCS documents at least. A group (language and source) has one column:
its count of each kept term. The terms of a language stand in an order that puts equal counts side by side
(by their counts in the largest groups), so a column is a list of runs; a run is one stretch of terms with
the same count. For two groups the run boundaries are intersected, and each stretch between them adds the
difference of the two smoothed shares times its length.

Columns are cut into blocks of BLOCK terms. Groups of a language are dealt into tiles; a task gets one block
of two tiles, so no task holds a whole language, and partial sums of a pair's blocks are added up by Spark.
All shares are whole numbers of billionths, and all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm import arrays
from kgspark.llm.common import number_rows, written

LEAST_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
LEADERS = 8  # largest groups by whose counts the terms are ordered
BLOCK = 16_384
TILE = 64  # groups of a language that meet others at once, on average
RUN_BYTES = 8 << 20

#: Bytes between terms, once A-Z are in lower case: all of ASCII but letters.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x61), *range(0x7B, 0x80)]] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: for each group and term of a run of texts, its occurrences and documents."""
    for batch in batches:
        for low, high in arrays.row_runs(batch.column(2), RUN_BYTES):
            lang, source, text = (batch.column(i).slice(low, high - low) for i in range(3))
            words = arrays.split_words(*arrays.text_bytes(text), lower=True, hashed=False, gaps=GAPS)
            which, values = arrays.distinct(words.data, words.start, words.end)
            if not len(which):
                continue
            names, number = {}, np.empty(len(text), np.int64)
            for i, name in enumerate(zip(lang.to_pylist(), source.to_pylist())):
                number[i] = names.setdefault(name, len(names))
            size = len(values)
            seen, n = np.unique(words.doc * size + which, return_counts=True)
            doc, term = np.divmod(seen, size)
            keys, place, docs = np.unique(number[doc] * size + term, return_inverse=True, return_counts=True)
            group, term = np.divmod(keys, size)
            total = np.bincount(place, n, len(keys)).astype(np.int64)  # far below 2**53 in one run
            langs, sources = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group)), sources.take(pa.array(group)), pa.array(values, pa.binary()).cast(pa.string()).take(pa.array(term)), pa.array(total), pa.array(docs)],
                ["lang", "source", "term", "n", "docs"],
            )


def share(n: str, size: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (size + SMOOTH * terms)) of named columns, in decimals, which do not overflow."""
    above = f"CAST({n} + {SMOOTH} AS DECIMAL(20,0)) * CAST({UNIT} AS DECIMAL(10,0))"
    return F.expr(f"1 + ({above}) div CAST({size} + {SMOOTH} * {terms} AS DECIMAL(20,0))")


def shares(n: np.ndarray, size: int, terms: int) -> np.ndarray:
    """The same for an array of counts: a long division in steps of 1000, as UNIT is 1000**3."""
    below = size + SMOOTH * terms
    if below >= 1 << 53:
        return np.array([1 + UNIT * (x + SMOOTH) // below for x in n.tolist()], np.int64)
    whole, rest = np.divmod(n + SMOOTH, max(below, 1))
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, max(below, 1))
        whole = whole * 1000 + step
    return whole + 1


def term_counts(df: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms with their counts (lang, source, term, n, all_n), and all groups (lang, source, size, all_size, terms)."""
    named = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
    vocabulary = written(vocabulary.where(F.col("docs") >= least_docs).drop("docs"), "vocabulary")
    kept = written(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    return kept, written(groups.na.fill(0, ["size", "all_size", "terms"]), "groups")


def columns_of(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Run-length coded columns: lang, source, block, ends, counts. Only runs up to the last count above 0.

    Terms are numbered within their language in the order of their counts in its LEADERS largest groups.
    ``ends`` are 32-bit places in the block, one for each run, ``counts`` are 64-bit.
    """
    place = W.partitionBy("lang").orderBy(F.desc("size"), "source")
    leaders = groups.withColumn("_lead", F.row_number().over(place)).where(F.col("_lead") <= LEADERS)
    leaders = leaders.select("lang", "source", "_lead")
    led = kept.join(leaders, ["lang", "source"], "left")
    keys = [f"_c{i}" for i in range(LEADERS)]
    signature = [F.coalesce(F.max(F.when(F.col("_lead") == i + 1, F.col("n"))), F.lit(0)).alias(k) for i, k in enumerate(keys)]
    terms = number_rows(led.groupBy("lang", "term").agg(*signature), ["lang", *keys, "term"]).select("lang", "term", "row_no")
    begins = terms.groupBy("lang").agg(F.min("row_no").alias("_begin"))
    terms = terms.join(begins, "lang").select("lang", "term", (F.col("row_no") - F.col("_begin")).alias("at"))
    placed = kept.join(terms, ["lang", "term"]).select("lang", "source", F.expr(f"at div {block}").alias("block"), (F.col("at") % block).cast("int").alias("at"), "n")

    def code(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, n = table.column("at").to_numpy().astype(np.int64), table.column("n").to_numpy()
        dense = np.zeros(int(at[-1]) + 1, np.int64)  # of one block
        dense[at] = n
        ends = np.append(np.flatnonzero(np.diff(dense)) + 1, len(dense))
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ends.astype("<i4"), dense[ends - 1].astype("<i8"))]
        return pa.table([pa.array([k.as_py()]) for k in key] + blobs, names=["lang", "source", "block", "ends", "counts"])

    return placed.groupBy("lang", "source", "block").applyInArrow(code, "lang string, source string, block long, ends binary, counts binary")


def stretch_sum(ends: tuple[np.ndarray, np.ndarray], values: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over all places of the difference of two run-length coded columns that end at the same place."""
    bounds = np.union1d(*ends)  # where either column may change
    one, two = (v[np.searchsorted(e, bounds)] for e, v in zip(ends, values))
    return int((np.abs(one - two) * np.diff(bounds, prepend=0)).sum())


def _tile(block: int):
    """Group function: partial sums of all pairs of one block that meet in this pair of tiles."""

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        low, high, number, terms = key[1].as_py(), key[2].as_py(), key[3].as_py(), table.column("terms")[0].as_py()
        stop = min(block, terms - number * block)
        table = table.sort_by("source")
        columns = []
        for ends, counts, size in zip(table.column("ends"), table.column("counts"), table.column("size").to_pylist()):
            ends = np.frombuffer(ends.as_py() or b"", "<i4").astype(np.int64)
            counts = np.frombuffer(counts.as_py() or b"", "<i8")
            if stop > (ends[-1] if len(ends) else 0):  # the rest of the block is one run of zeros
                ends, counts = np.append(ends, stop), np.append(counts, 0)
            columns.append((ends, shares(counts, size, terms)))
        names, tiles = table.column("source").to_pylist(), table.column("tile").to_pylist()
        out = [[], [], []]
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if low == high or tiles[i] != tiles[j]:
                    out[0].append(names[i])
                    out[1].append(names[j])
                    out[2].append(stretch_sum((columns[i][0], columns[j][0]), (columns[i][1], columns[j][1])) if stop > 0 else 0)
        return pa.table([pa.array([key[0].as_py()] * len(out[0]), pa.string()), *[pa.array(o, k) for o, k in zip(out, (pa.string(), pa.string(), pa.int64()))]], names=["lang", "a", "b", "value"])

    return tile


def pair_sums(columns: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, item, value: for every two groups of a language, both ways, the sum of their shares' differences."""
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = groups.join(per_lang, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    last = F.greatest(F.lit(0), F.expr(f"(terms - 1) div {block}")).cast("long")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    full = dealt.join(columns, ["lang", "source", "block"], "left")
    full = full.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    full = full.withColumn("low", F.least("tile", "_other")).withColumn("high", F.greatest("tile", "_other"))
    full = full.select("lang", "low", "high", "block", "source", "tile", "size", "terms", "ends", "counts")
    parts = full.groupBy("lang", "low", "high", "block").applyInArrow(_tile(block), "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank for every group (language and source) of ``df``.

    Part ``pair``: the other sources of the language by how far their shares of the kept terms lie apart,
    summed over all terms. Part ``term``: the ``top`` terms that occur in the group and whose share there
    exceeds the language's most. Ranks run from 1 by falling value, then by item.

    NULL text, language or source count as ''. Repeated rows count each. A group without terms has equal
    shares for all; a language without kept terms has pairs at distance 0 and no terms, one with a single
    source no pairs; an empty table gives no rows. Other columns are ignored.
    """
    kept, groups = term_counts(df, least_docs)
    pairs = pair_sums(columns_of(kept, groups, block), groups, block, tile).withColumn("part", F.lit("pair"))
    terms = kept.where("n > 0").join(groups, ["lang", "source"])
    terms = terms.withColumn("value", share("n", "size", "terms") - share("all_n", "all_size", "terms")).where("value > 0")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.select("lang", "source", "part", "item", "value", "rank").unionByName(terms)
