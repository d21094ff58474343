"""Document versions, differences between versions, facts that are valid in time."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import ids
from kgspark.functions import patterns as P
from kgspark.functions.text import squash

from .scale import cut_lineage, next_value, previous_row, written

# Fixed values.
SIMILAR, SAME_PLACE, MOVED = 0.48, 0.25, 0.85
DIFF_LABELS = {"delete": "删除", "insert": "新增"}
KINDS = ("unchanged", "added", "modified", "deleted", "moved")
# end of fixed values
LETTERS = 128  # classes of characters in the bound of a matching share


def decorate(chunks: DataFrame, document: str = "doc_id") -> DataFrame:
    """Add content_hash, anchor and stable_chunk_id; ``chunks`` (doc, pos, content[, anchor])."""
    place = F.concat(F.lit("index:"), (F.col("pos") + 1).cast("string"))
    anchor = F.coalesce(F.nullif("anchor", F.lit("")), place) if "anchor" in chunks.columns else place
    return chunks.withColumn("content_hash", ids.content_hash(squash(F.col("content")))).withColumn("anchor", anchor).withColumn(
        "stable_chunk_id", ids.stable_chunk_id(F.col(document), F.col("anchor"), F.col("content"))
    )


def structure_hash(units: DataFrame, columns: list[str], order: str, id_col: str = "doc_id") -> DataFrame:
    """Hash over the structural places of a document's units, not over their text."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = units.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("_u"))
    return rows.select(id_col, F.sha2(F.array_join("_u.l", "\n"), 256).alias("structure_hash"))


def _letters(texts: list[str]) -> np.ndarray:
    """How often the characters of each text fall into each of LETTERS classes."""
    counts = np.zeros((len(texts), LETTERS), np.int32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts[row] = np.bincount(codes % LETTERS, minlength=LETTERS)
    return counts


class _Ratios:
    """Matching share of old texts with new ones as the standard library's sequence matcher gives it.

    Equal pairs of texts are compared once. ``bounds`` are never below the shares: no more characters
    match than both texts have in common.
    """

    def __init__(self, old: list[str]):
        self.texts = list(dict.fromkeys(old))
        number = {text: i for i, text in enumerate(self.texts)}
        self.of = np.array([number[text] for text in old], np.int64)
        self.letters, self.sizes = _letters(self.texts), np.array([len(t) for t in self.texts], np.int64)
        self.matcher, self.known, self.new = SequenceMatcher(None), {}, None

    def bounds(self, new: str) -> np.ndarray:
        common = np.minimum(self.letters, _letters([new])).sum(1)
        total = self.sizes + len(new)
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)[self.of]

    def share(self, old: int, new: str) -> float:
        pair = (self.of[old], new)
        if pair not in self.known:
            if self.new != new:
                self.matcher.set_seq2(new)
                self.new = new
            self.matcher.set_seq1(self.texts[pair[0]])
            self.known[pair] = self.matcher.ratio()
        return self.known[pair]


def _first_come(names: list[str]):
    """Matching rule over what is left of one document: new chunks choose in their order, each the best old
    chunk nobody has; of equals the earlier one. A text is compared only where its bound can still win."""

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("old_pos"), right.sort_by("new_pos")
        anchors, rows = np.array(left.column("_a").to_pylist(), object), []
        free = np.ones(left.num_rows, bool)
        ratios = _Ratios(left.column("_old").to_pylist())
        for at, (new, anchor) in enumerate(zip(right.column("_new").to_pylist(), right.column("_b").to_pylist())):
            stays = anchors == anchor
            bound = ratios.bounds(new) + np.where(stays, SAME_PLACE, 0.0) + 1e-9
            possible = np.flatnonzero(free & (bound >= SIMILAR))
            best, place = -1.0, -1
            for old in possible[np.argsort(-bound[possible], kind="stable")]:
                if bound[old] < best:
                    break
                score = ratios.share(old, new) + (SAME_PLACE if stays[old] else 0.0)
                if score >= SIMILAR and (score > best or (score == best and old < place)):
                    best, place = score, old
            if place >= 0:
                free[place] = False
                rows.append((at, place, bool(stays[place]), best))
        mine = pa.array([r[0] for r in rows], pa.int64())
        kept = [right.column(name).combine_chunks().take(mine) for name in names[:-4]]
        old = left.column("old_pos").combine_chunks().take(pa.array([r[1] for r in rows], pa.int64()))
        new = right.column("new_pos").combine_chunks().take(mine)
        return pa.table([*kept, old, new, pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.float64())], names=names)

    return choose


def compare_exact(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches of two versions and what is left: (matches, old rest, new rest).

    First the same place and content, then contents that occur once on either side.
    """
    here = [*keys, "anchor", "content_hash"]
    a = old.groupBy(*here).agg(F.max("pos").alias("old_pos"))
    b = new.groupBy(*here).agg(F.max("pos").alias("new_pos"))
    same = a.join(b, here).select(*keys, "old_pos", "new_pos")

    def once(df, name):
        grouped = df.groupBy(*keys, "content_hash").agg(F.count(F.lit(1)).alias("_n"), F.max("pos").alias(name))
        return grouped.filter("_n = 1").drop("_n")

    def rest(df, name, matched):
        return df.join(matched.select(*keys, F.col(name).alias("pos")), [*keys, "pos"], "left_anti")

    unique = once(old, "old_pos").join(once(new, "new_pos"), [*keys, "content_hash"])
    unique = unique.join(same.select(*keys, "old_pos"), [*keys, "old_pos"], "left_anti")
    unique = unique.join(same.select(*keys, "new_pos"), [*keys, "new_pos"], "left_anti")
    matches = same.unionByName(unique.select(*keys, "old_pos", "new_pos"))
    return matches, rest(old, "old_pos", matches), rest(new, "new_pos", matches)


def compare(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Changes between decorated versions: (keys, kind, old_pos, new_pos, similarity).

    Joins find what did not change. Only the remaining chunks of one document meet in a task. Either version is
    written once, as its places and hashes are read by many joins and its texts by one.
    """
    keys = keys or ["doc_id"]
    version = [*keys, "pos", "anchor", "content_hash", squash(F.col("content")).alias("_body")]
    matches, a, b = compare_exact(written(old.select(version)), written(new.select(version)), keys)
    left = a.select(*keys, F.col("pos").cast("long").alias("old_pos"), F.col("anchor").alias("_a"), F.col("_body").alias("_old"))
    right = b.select(*keys, F.col("pos").cast("long").alias("new_pos"), F.col("anchor").alias("_b"), F.col("_body").alias("_new"))
    names = [*keys, "old_pos", "new_pos", "stays", "score"]
    kinds = [f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    # Compared once, read for three kinds of change.
    chosen = cut_lineage(met.applyInArrow(_first_come(names), ", ".join([*kinds, "old_pos long", "new_pos long", "stays boolean", "score double"])))
    moved = ~F.col("stays") & (F.col("score") >= MOVED)
    paired = chosen.select(
        *keys, F.when(moved, "moved").otherwise("modified").alias("kind"), "old_pos", "new_pos", F.round("score", 6).alias("similarity")
    )
    none = F.lit(None)
    added = right.join(chosen.select(*keys, "new_pos"), [*keys, "new_pos"], "left_anti").select(
        *keys, F.lit("added").alias("kind"), none.cast("long").alias("old_pos"), "new_pos", none.cast("double").alias("similarity")
    )
    deleted = left.join(chosen.select(*keys, "old_pos"), [*keys, "old_pos"], "left_anti").select(
        *keys, F.lit("deleted").alias("kind"), "old_pos", none.cast("long").alias("new_pos"), none.cast("double").alias("similarity")
    )
    same = matches.select(
        *keys, F.lit("unchanged").alias("kind"), F.col("old_pos").cast("long").alias("old_pos"),
        F.col("new_pos").cast("long").alias("new_pos"), none.cast("double").alias("similarity"),
    )
    return same.unionByName(paired).unionByName(added).unionByName(deleted)


def change_summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS]
    return changes.groupBy(*keys).agg(*counts, F.count(F.when(F.col("kind") != "unchanged", 1)).alias("changed"))


def line_changes(old: DataFrame, new: DataFrame, keys: list[str], mark_numbers: bool = True) -> DataFrame:
    """Lines that one version of a text has more often than the other: (keys, kind, line, times, severity).

    Lines are compared without outer and repeated white space, as rows: counts per line and version, no
    text beside another in a task. A line with figures in it is severe.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        lines = df.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("_l"))
        lines = lines.select(*keys, squash(F.col("_l")).alias("line")).filter("line <> ''")
        return lines.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias(name))

    both = counted(old, "_a").join(counted(new, "_b"), [*keys, "line"], "full")
    more = F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))
    changed = both.select(*keys, "line", more.alias("_more")).filter("_more <> 0")
    severe = F.lit(mark_numbers) & F.col("line").rlike("[0-9]")
    return changed.select(
        *keys, F.when(F.col("_more") > 0, DIFF_LABELS["insert"]).otherwise(DIFF_LABELS["delete"]).alias("kind"), "line",
        F.abs("_more").alias("times"), F.when(severe, "高").otherwise("中").alias("severity"),
    )


def qa_differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Questions (white space ignored) only in one version or with different answers."""

    def keyed(df, name):
        bare = F.regexp_replace("question", f"{P.WS}+", "")
        return df.select(*keys, bare.alias("q"), F.col("answer").alias(name)).groupBy(*keys, "q").agg(F.max(name).alias(name))

    both = keyed(old, "_a").join(keyed(new, "_b"), [*keys, "q"], "full_outer")
    state = F.when(F.col("_a").isNull(), "only_new").when(F.col("_b").isNull(), "only_old").when(F.col("_a") != F.col("_b"), "different")
    return both.withColumn("state", state).filter("state IS NOT NULL").drop("_a", "_b")


def fact_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts that came and went, with a ``change`` column."""
    came, went = new.exceptAll(old).distinct(), old.exceptAll(new).distinct()
    return came.withColumn("change", F.lit("added")).unionByName(went.withColumn("change", F.lit("removed")))


def publish(versions: DataFrame, published: DataFrame) -> DataFrame:
    """Publish one version per document; other published versions become superseded."""
    target = published.select("document_id", F.col("version_id").alias("_new"))
    joined = versions.join(target, "document_id", "left")
    status = (
        F.when(F.col("version_id") == F.col("_new"), "published")
        .when(F.col("_new").isNotNull() & (F.col("status") == "published"), "superseded").otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("_new")


def activate_facts(facts: DataFrame, keys: list[str], coarse: Column) -> DataFrame:
    """Facts in order of (valid_at, fact_id) to validity intervals.

    A fact is closed by the next fact of its key with another value, together with all facts of
    its run. ``coarse`` grows with valid_at and cuts hot keys.
    """
    order = [F.col("valid_at"), F.col("fact_id")]
    rows = previous_row(facts, keys, order, coarse, F.col("value"), "_before")
    start = F.col("_before").isNull() | (F.col("_before") != F.col("value"))
    opening = F.when(start, F.struct(F.col("valid_at").alias("at"), F.col("fact_id").alias("by")))
    rows = next_value(rows, keys, order, coarse, opening, "_next")
    return rows.select(
        *facts.columns, F.col("_next.at").alias("invalid_at"), F.col("_next.by").alias("superseded_by"),
        F.when(F.col("_next").isNull(), "active").otherwise("superseded").alias("status"),
    )


def valid_at(facts: DataFrame, moment: Column) -> DataFrame:
    """Facts valid at a moment; NULL means open."""
    return facts.filter((F.col("valid_at") <= moment) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > moment)))


def still_active(records: DataFrame, moment: Column, column: str = "invalid_at") -> DataFrame:
    """Records whose textual end is empty or later; an unreadable end hides the record."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    return records.filter((text == "") | (F.try_to_timestamp(text) > moment))


def latest(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """Newest rows first, 1 to 200 of them."""
    return rows.orderBy(F.col(order).desc()).limit(min(200, max(1, limit)))


_LANES = ("h1", "h2", "h3", "h4")
_RING = 2**60  # a lane holds 15 hexadecimal digits


def _summed(rows: DataFrame, keys: list[str], n: Column) -> DataFrame:
    ring = F.lit(_RING).cast("decimal(38,0)")
    sums = [F.pmod(F.sum(lane), ring).cast("decimal(28,0)").alias(lane) for lane in _LANES]
    return rows.groupBy(*keys).agg(F.sum(n).alias("n"), *sums)


def multiset_state(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Hash of a multiset of items per key as sums of wide hashes: (keys, n, h1…h4).

    Sums do not depend on order, are combined before the shuffle and can be updated: see ``changed_state``.
    A NULL item counts as an item of its own.
    """
    digest = rows.select(*keys, F.sha2(F.coalesce(F.concat(F.lit("+"), item), F.lit("-")), 256).alias("_h"))
    number = lambda k: F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(28,0)")
    return _summed(digest.select(*keys, *[number(k).alias(lane) for k, lane in enumerate(_LANES)]), keys, F.lit(1).cast("long"))


def changed_state(state: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """A stored state with the states of added and removed items worked in; keys left without items go."""
    less = removed.select(*keys, (-F.col("n")).alias("n"), *[(-F.col(lane)).alias(lane) for lane in _LANES])
    return _summed(state.unionByName(added).unionByName(less), keys, F.col("n")).filter("n <> 0")


def state_fingerprint(state: DataFrame, keys: list[str]) -> DataFrame:
    parts = F.concat_ws("-", *[F.col(c).cast("string") for c in ("n", *_LANES)])
    return state.select(*keys, F.substring(F.sha2(parts, 256), 1, 16).alias("fingerprint"))


def fingerprint(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Order-free hash of all items per key."""
    return state_fingerprint(multiset_state(rows, keys, item), keys)


def corpus_revision(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Revision per document: hash of its sorted chunk ids."""
    rows = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list("chunk_id")).alias("_c"))
    return rows.select(id_col, F.substring(F.sha2(F.array_join("_c", "\n"), 256), 1, 16).alias("revision"))
