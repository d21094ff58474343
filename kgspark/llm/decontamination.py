"""Documents that hold benchmark items, found by SimHash over windows as long as an item.

A window of a document has as many words as an item. Those where a shared run of five words has the same
place in both are looked at, and for each item the first of the best windows wherever it stands: such a
window ends with a shared run, or a window one word earlier would be as good, so all windows are covered
by those that end with one. Texts whose shared runs nowhere lie close enough for the threshold are left
out first. Windows and items get 64-bit SimHash fingerprints, weighted by how often each run occurs. The
fingerprint is cut into RADIUS + 1 blocks, of which two fingerprints within RADIUS bits must share one,
so an equality join on blocks misses none of them. Survivors are verified by the exact weighted
similarity of their runs: sum of lesser counts over sum of greater counts.

Everything is DataFrame functions. A cheap test comes first: an item at the threshold keeps enough of its
runs that one of a few of them, chosen for their long words, must survive; texts without any of those
words cannot qualify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import cut_lineage

SIZE = 5
THRESHOLD = 0.8
RADIUS = 21  # similarity 0.8 means about 10 differing bits, give or take 3
PROBE_WORDS = 20_000  # as many are tested in the scan; more go through a join


def words_of(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def runs_of(words: str) -> Column:
    """Hash of every run of SIZE words, in order."""
    column = F.col(words)
    starts = F.slice(column, 1, F.greatest(F.size(column) - (SIZE - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(column, i + j) for j in range(1, SIZE)]))


def fingerprints(runs: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """SimHash of the runs of each key; a run counts as often as it has rows."""
    votes = [F.sum(F.expr(f"CASE WHEN (shiftright({run}, {i}) & 1) = 1 THEN 1 ELSE -1 END")).alias(f"_v{i}") for i in range(64)]
    bits = [F.when(F.col(f"_v{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return runs.groupBy(*keys).agg(*votes).select(*keys, total.alias("fingerprint"))


def blocks(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per block of the fingerprint: ``block`` and its ``value``."""
    count = radius + 1
    edges = [64 * i // count for i in range(count + 1)]
    cut = F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fingerprint", a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])
    return df.withColumn("_b", F.explode(cut)).select("*", "_b.block", "_b.value").drop("_b")


def item_runs(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Runs of items with SIZE words at least: item_id, words (count), at, run, probe (longest word)."""
    cut = items.select(F.col(item_id).alias("item_id"), words_of("text").alias("w")).where(F.size("w") >= SIZE)
    cut = cut.select("item_id", "w", F.size("w").alias("words"), F.posexplode(runs_of("w")).alias("at", "run"))
    longest = F.array_max(F.transform(F.slice("w", F.col("at") + 1, SIZE), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    return cut.select("item_id", "words", "at", "run", longest["word"].alias("probe"))


def probe_words(runs: DataFrame, threshold: float) -> DataFrame:
    """Distinct words of which every text with an item at the threshold has one.

    A text may lack ``1 - threshold`` of an item's runs: a window as long as the item fewer, but a text
    shorter than the item has no runs of its own instead of the missing ones.
    """
    first = F.row_number().over(W.partitionBy("item_id").orderBy(F.length("probe").desc(), "at"))
    need = F.floor((F.col("words") - (SIZE - 1)) * (1 - threshold) + 1e-9) + 1
    return runs.withColumn("_no", first).where(F.col("_no") <= need).select(F.col("probe").alias("word")).distinct()


def _suspects(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of ``docs`` (key, words) with a probe word."""
    few = [r[0] for r in probes.limit(PROBE_WORDS + 1).collect()]
    if len(few) <= PROBE_WORDS:  # checked: the set that travels with the plan is small
        return docs.where(F.exists("words", lambda w: w.isin(few))) if few else docs.where("false")
    hits = docs.select("key", F.explode(F.array_distinct("words")).alias("word")).join(probes, "word").select("key").distinct()
    return docs.join(hits, "key", "left_semi")


def _least_common(threshold: float) -> Column:
    """Runs that a window (``here`` of them at most) must share with an item of ``words`` words to reach the threshold."""
    either = F.col("here") + F.col("words") - (SIZE - 1)
    return F.greatest(F.lit(1), F.ceil(either * threshold / (1 + threshold) - 1e-9)).cast("int")


def _dense_hits(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits (key, length, words, p, run) of texts where a window holds enough of them; adds ``here`` and ``least``."""
    hits = hits.withColumn("here", F.least(F.col("words"), F.col("length")) - (SIZE - 1))
    hits = hits.withColumn("least", _least_common(threshold))
    packed = hits.groupBy("key", "length", "words", "here", "least").agg(F.sort_array(F.collect_list(F.struct("p", "run"))).alias("_h"))
    near = F.transform("_h", lambda x, j: F.get("_h", j - (F.col("least") - 1))["p"] > x["p"] - (F.col("words") - (SIZE - 1)))
    packed = packed.where(F.exists(near, lambda x: F.coalesce(x, F.lit(False))))
    return packed.withColumn("_x", F.explode("_h")).select("key", "length", "words", "here", "least", "_x.p", "_x.run")


def _best_windows(hits: DataFrame, there: DataFrame) -> DataFrame:
    """Of each text and item the first of the windows that share most, if that may reach the threshold: key, words, start.

    A run that an item has m times counts in a window unless m copies of it stand before it there, so every
    hit carries the place of its m-th predecessor (``old``).
    """
    of_item = ["key", "item_id", "words", "least"]
    met = hits.join(there.select("item_id", "words", "run", "m"), ["words", "run"])
    met = met.groupBy(*of_item, "run", "m").agg(F.sort_array(F.collect_list("p")).alias("_p"))
    olds = F.transform("_p", lambda p, j: F.struct(p.alias("p"), F.coalesce(F.get("_p", (j - F.col("m")).cast("int")), F.lit(-1)).alias("old")))
    met = met.select(*of_item, F.explode(olds).alias("x")).groupBy(*of_item).agg(F.sort_array(F.collect_list("x")).alias("_x"))
    size = F.col("words") - (SIZE - 1)

    def window(x: Column, j: Column) -> Column:
        """The window that ends with hit ``x``, or the text's first: what it shares, and where it starts."""
        start = F.greatest(F.lit(0), x["p"] - size + 1)
        inside = F.slice("_x", F.greatest(F.lit(1), j - size + 2), F.least(size, j + 1))
        both = F.size(F.filter(inside, lambda y: (y["p"] >= start) & (y["old"] < start)))
        enough = F.get("_x", j - (F.col("least") - 1))["p"] > x["p"] - size
        return F.when(enough, F.struct(both.alias("both"), (-start).alias("s")))

    met = met.select(*of_item, F.array_max(F.transform("_x", window)).alias("b")).where(F.col("b.both") >= F.col("least"))
    return met.select("key", "words", (-F.col("b.s")).alias("start"))


def _found(df: DataFrame, items: DataFrame, threshold: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """Suspect rows (doc_id, key, text_key), and the best window of each text and item (key, item_id, b).

    ``key`` names the words of a text, ``text_key`` the text itself.
    """
    runs = cut_lineage(item_runs(items.dropDuplicates(["item_id", "text"])))
    docs = df.select("doc_id", "text", words_of("text").alias("words"))
    docs = docs.withColumn("key", F.sha2(F.concat_ws(" ", "words"), 256))
    found = _suspects(docs, probe_words(runs, threshold)).select(
        "doc_id", "key", F.sha2("text", 256).alias("text_key"), F.size("words").alias("length"), runs_of("words").alias("runs")
    )
    found = cut_lineage(found)

    texts = found.groupBy("key").agg(F.first("length").alias("length"), F.first("runs").alias("runs"))  # copies once
    texts = cut_lineage(texts)
    there = runs.groupBy("item_id", "words", "run").agg(F.count(F.lit(1)).alias("m"))
    hits = texts.select("key", "length", F.posexplode("runs").alias("p", "run")).join(runs.select("run", "words").distinct(), "run")
    hits = cut_lineage(_dense_hits(hits, threshold))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("length") - F.col("words")))
    aligned = hits.join(runs.select("run", "words", "at").distinct(), ["run", "words"]).select("key", "words", start.alias("start"))
    windows = aligned.withColumn("aligned", F.lit(1)).union(_best_windows(hits, there).withColumn("aligned", F.lit(0)))
    windows = windows.groupBy("key", "words", "start").agg(F.max("aligned").alias("aligned"))
    held = windows.join(texts.select("key", "runs"), "key").select(
        "key", "words", "start", "aligned", F.explode(F.slice("runs", F.col("start") + 1, F.col("words") - (SIZE - 1))).alias("run")
    )
    held = cut_lineage(held)
    of_window, of_item = ["key", "words", "start", "aligned"], ["item_id", "words"]
    left = blocks(fingerprints(held, of_window), radius)
    right = blocks(fingerprints(runs, of_item), radius).withColumnRenamed("fingerprint", "item_print")
    near = left.join(right, ["words", "block", "value"])
    near = near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select(*of_window, "item_id").distinct()
    counted = held.groupBy(*of_window, "run").agg(F.count(F.lit(1)).alias("n"))
    common = near.join(counted, of_window).join(there.drop("words"), ["item_id", "run"], "left")
    common = common.groupBy(*of_window, "item_id").agg(
        F.sum("n").alias("here"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("both")
    )
    either = F.col("here") + F.col("words") - (SIZE - 1) - F.col("both")
    alike = common.withColumn("similarity", F.col("both") / either).where(F.col("similarity") >= threshold)
    return found, alike.groupBy("key", "item_id").agg(F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("s"))).alias("b"))


def find_items(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Items found in documents: doc_id, item_id, start_word, similarity, one row per document and item.

    Of several such windows the most similar is reported; of equals one where a shared run has the same place
    in both, then the first. Case and punctuation do not count.
    NULL and empty texts and items hold nothing; items of fewer than SIZE words take no part, since words
    so few occur by chance; a text shorter than an item is one window. Repeated rows of a document give
    one row, rows without an id are reported with NULL. Equal items are reported each. Empty tables give
    no rows, other columns are ignored.
    """
    found, best = _found(df, items, threshold, radius)
    named = found.select("doc_id", "key").distinct().join(best, "key")
    out = named.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.similarity").alias("similarity"))


def without_items(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows whose text holds an item. Rows go by their texts, whether they have or share an id or not."""
    found, best = _found(df, items, threshold, RADIUS)
    hits = found.join(best.select("key").distinct(), "key", "left_semi").select("text_key").distinct()
    return df.join(hits, F.sha2(df["text"], 256) == hits["text_key"], "left_anti")
