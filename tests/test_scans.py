import random

from pyspark.sql import functions as F

from kgspark.functions import scans
from kgspark.operators import chunking as C
from kgspark.operators import versioning as D


def test_prefix_scan_chain_and_search(spark):
    rng = random.Random(3)
    rows = [([],), ([7],)] + [([rng.randint(0, 9) for _ in range(rng.randint(2, 40))],) for _ in range(20)] + [(None,)]
    df = spark.createDataFrame(rows, "a ARRAY<INT>")
    out = df.select(
        "a", scans.prefix_scan(F.col("a"), lambda x, y: x + y).alias("s"),
        scans.chain(F.transform("a", lambda x, i: i + 1 + x)).alias("c"),
    ).withColumn("f", scans.first_above(F.col("s"), F.lit(12))).withColumn("g", scans.first_above(F.col("s"), F.lit(12), strict=False))
    for r in out.collect():
        if r["a"] is None:
            assert r["s"] is None and r["c"] is None
            continue
        sums = [sum(r["a"][: i + 1]) for i in range(len(r["a"]))]
        at, places = 0, []
        while at < len(r["a"]):
            places.append(at)
            at += 1 + r["a"][at]
        assert r["s"] == sums and r["c"] == places
        assert r["f"] == sum(x <= 12 for x in sums) and r["g"] == sum(x < 12 for x in sums)


def test_million_pieces_are_packed(spark):
    """One document of a million pieces: a fold that copies its output would not end."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.repeat(F.lit("x"), i % 7)).alias("p"))
    got = df.select(C.pack(F.col("p"), "-", 100).alias("o")).select(
        F.size("o").alias("n"), F.array_max(F.transform("o", F.length)).alias("most"),
        F.aggregate("o", F.lit(0).cast("long"), lambda acc, x: acc + F.length(F.replace(x, F.lit("-"), F.lit("")))).alias("all"),
    ).first()
    assert got["most"] <= 100 and got["all"] == sum(i % 7 for i in range(1, 1_000_001))
    assert got["n"] <= got["all"] / 70


def test_cutting_has_no_exchange(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz"), (2, ""), (3, None)], "doc_id LONG, text STRING")
    for df in (C.markdown_units(docs), C.markdown_sections(docs), C.hierarchical_chunks(docs, 40, 0)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"] for r in df.collect()} == {1}


def test_heading_stack_against_a_loop(spark):
    rng = random.Random(11)
    levels = [[rng.randint(1, 6) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    docs = [(i, "\n".join("#" * k + f" h{n}" for n, k in enumerate(ls))) for i, ls in enumerate(levels)]
    rows = C.markdown_sections(spark.createDataFrame(docs, "doc_id LONG, text STRING")).filter("section > 0").collect()
    got = {(r["doc_id"], r["section"]): [h["title"] for h in r["path"]] for r in rows}
    want = {}
    for i, ls in enumerate(levels):
        stack = []
        for n, k in enumerate(ls):
            stack = [(j, t) for j, t in stack if j < k] + [(k, f"h{n}")]
            want[i, n + 1] = [t for _, t in stack]
    assert got == want


def test_fingerprint_follows_changes(spark):
    rows = [(k, f"{i % 13}") for i in range(60) for k in ("a", "b")] + [("b", None), ("c", "1")]
    df = spark.createDataFrame(rows, "k STRING, v STRING")
    state = lambda d: D.multiset_state(d, ["k"], F.col("v"))
    gone, rest = df.filter("v = '1'"), df.filter("v IS NULL OR v <> '1'")
    after = D.state_fingerprint(D.changed_state(state(df), state(df.limit(0)), state(gone), ["k"]), ["k"])
    rebuilt = D.fingerprint(rest, ["k"], F.col("v"))
    assert sorted(after.collect()) == sorted(rebuilt.collect()) and after.count() == 2
    back = D.changed_state(state(rest), state(gone), state(df.limit(0)), ["k"])
    assert sorted(D.state_fingerprint(back, ["k"]).collect()) == sorted(D.fingerprint(df.repartition(7), ["k"], F.col("v")).collect())
