import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from kgspark.operators import conversation as C
from kgspark.operators import versioning as D
from kgspark.plans.search import containing
from kgspark.sources import storage as ST
from kgspark.streaming import jobs as J


def test_text_files_skip_known(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.md").write_text("three")
    (tmp_path / "c.bin").write_text("no")
    files = ST.text_files(spark, str(tmp_path))
    assert sorted(r["text"] for r in files.collect()) == ["one\ntwo", "three"]
    known = files.filter(F.col("file_path").endswith("a.txt"))
    assert [r["text"] for r in ST.text_files(spark, str(tmp_path), known).collect()] == ["three"]


def test_versions_compare(spark):
    old = spark.createDataFrame([(1, 0, "same text"), (1, 1, "moved words here"), (1, 2, "old number 12"), (1, 3, "gone completely")], "doc_id INT, pos INT, content STRING")
    new = spark.createDataFrame([(1, 0, "same  text"), (1, 1, "zzzz"), (1, 2, "old number 13"), (1, 3, "moved words here")], "doc_id INT, pos INT, content STRING")
    rows = D.compare(D.decorate(old), D.decorate(new)).collect()
    got = {(r["kind"], r["old_pos"], r["new_pos"]) for r in rows}
    assert got == {("unchanged", 0, 0), ("unchanged", 1, 3), ("added", None, 1), ("modified", 2, 2), ("deleted", 3, None)}
    ratio = SequenceMatcher(None, "old number 12", "old number 13").ratio() + 0.25
    assert [r["similarity"] for r in rows if r["kind"] == "modified"] == [round(ratio, 6)]
    summary = D.change_summary(D.compare(D.decorate(old), D.decorate(new)), ["doc_id"]).first()
    assert (summary["unchanged"], summary["changed"]) == (2, 3)


def test_line_changes_mark_numbers(spark):
    old = spark.createDataFrame([(1, "a\nb  1\nc\nc"), (2, None)], "doc_id INT, text STRING")
    new = spark.createDataFrame([(1, "a\nb 2\nc\nd\na\na")], "doc_id INT, text STRING")
    got = {tuple(r) for r in D.line_changes(old, new, ["doc_id"]).collect()}
    assert got == {(1, "删除", "b 1", 1, "高"), (1, "删除", "c", 1, "中"), (1, "新增", "b 2", 1, "高"), (1, "新增", "d", 1, "中"), (1, "新增", "a", 2, "中")}


def test_similar_chunks_choose_in_order(spark):
    """Against a loop over the chunks that are left: each new one takes the best old one nobody has."""
    rng = random.Random(4)
    words = "red green blue long short table number".split()
    make = lambda: [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(6)]
    for _ in range(3):
        before, after = make(), make()
        frames = [spark.createDataFrame([(1, i, t) for i, t in enumerate(x)], "doc_id INT, pos INT, content STRING") for x in (before, after)]
        rows = D.compare(*[D.decorate(f) for f in frames]).collect()
        kept = {r["old_pos"]: r["new_pos"] for r in rows if r["kind"] == "unchanged"}
        left, want = [i for i in range(6) if i not in kept], {}
        for j in range(6):
            if j in kept.values():
                continue
            scored = [(SequenceMatcher(None, before[i], after[j]).ratio() + (0.25 if i == j else 0), -i) for i in left]
            score, i = max(scored, default=(0, 0))
            if score >= D.SIMILAR:
                left.remove(-i)
                want[j] = -i
        assert {r["new_pos"]: r["old_pos"] for r in rows if r["kind"] in ("modified", "moved")} == want


def test_rounds(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "assistant", "more"), (1, 5, "system", "x"), (1, 6, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    assert [(r["turn"], r["round"]) for r in C.rounds(df).orderBy("turn").collect()] == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 4)]


def test_memory_budget_skips(spark):
    df = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 80), (1, 3, "c", 40)], "request_id INT, rank INT, memory_id STRING, n INT")
    assert sorted(r["memory_id"] for r in C.memory_budget(df, F.col("n"), 100).collect()) == ["a", "c"]


def test_memories_with_vectors(spark):
    memories = spark.createDataFrame(
        [("m1", "o", "global", "", True, None, 1, "likes tea", [1.0, 0.0]), ("m2", "o", "kb", "k2", True, None, 2, "tea", [1.0, 0.0]), ("m3", "o", "kb", "k1", True, None, 3, "else", [0.9, 0.1]), ("m4", "x", "global", "", True, None, 4, "tea", [1.0, 0.0])],
        "memory_id STRING, owner_id STRING, scope STRING, kb_id STRING, enabled BOOLEAN, expires_at TIMESTAMP, updated_at INT, text STRING, embedding ARRAY<DOUBLE>",
    )
    asked = spark.createDataFrame([("r", "o", "k1", "tea", [1.0, 0.0])], "request_id STRING, owner_id STRING, kb_id STRING, text STRING, embedding ARRAY<DOUBLE>")
    got = {r["memory_id"]: r["score"] for r in C.retrieve_memories(memories, asked, F.current_timestamp()).collect()}
    assert set(got) == {"m1", "m3"} and got["m1"] == 1.0 and 0.69 < got["m3"] < 0.7


def test_containing_equals_substring_search(spark):
    docs = spark.createDataFrame([(1, "xx one two three four yy"), (2, "one  two three four"), (3, "none"), (4, "wo")], "doc_id INT, text STRING")
    marks = spark.createDataFrame([(1, "ne two three fo"), (2, "wo")], "query_id INT, mark STRING")
    got = sorted((r["query_id"], r["doc_id"]) for r in containing(docs, marks).collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == sorted((q, d) for q, m in ((1, "ne two three fo"), (2, "wo")) for d, t in rows if m in t)


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_stream_ingest_over_several_batches(spark, tmp_path):
    schema = "position LONG, text STRING, file_path STRING"
    source = tmp_path / "in"
    for i in range(3):
        _write(spark, source, f"p{i}", [(i * 10, f"doc {i}", f"a{i}"), (i * 10 + 1, "same", f"b{i}")], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    table = J.BatchTable(spark, str(tmp_path / "t"))
    J.ingest(stream, table, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["text"] for r in table.read().collect()) == ["doc 0", "doc 1", "doc 2", "same"]
    _write(spark, source, "p9", [(99, "doc 1", "x"), (98, "late", "y")], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    J.ingest(stream, table, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["text"] for r in table.read().collect()) == ["doc 0", "doc 1", "doc 2", "late", "same"]


def test_stream_edges_equal_batch_and_replay_counts_once(spark, tmp_path):
    schema = "src STRING, tgt STRING, weight DOUBLE, keywords STRING"
    parts = [[("a", "b", 1.0, "x"), ("b", "a", 2.0, "y,x")], [("a", "b", 4.0, "z"), ("c", "a", 1.0, "")]]
    for i, rows in enumerate(parts):
        _write(spark, tmp_path / "in", f"p{i}", rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    table = J.BatchTable(spark, str(tmp_path / "t"))
    J.maintain_edges(stream, table, str(tmp_path / "c")).awaitTermination()
    want = [("a", "b", 7.0, "x,y,z", 3), ("a", "c", 1.0, "", 1)]
    read = lambda t: [(r["src"], r["tgt"], r["weight"], r["keywords"], r["n_records"]) for r in J.current_edges(t).orderBy("src", "tgt").collect()]
    assert read(table) == want
    first = spark.read.parquet(str(tmp_path / "t" / "batch=0"))
    table.write(spark.createDataFrame(first.collect(), first.schema), 0)  # a replayed batch
    assert read(table) == want
    small = J.BatchTable(spark, str(tmp_path / "s"))
    J.compact(table, small, J.current_edges)
    assert read(small) == want


def test_register_uploads(spark):
    rows = [(1, "d1", "o", "k", "n", "h1"), (2, "d2", "o", "k", "n", "h2"), (3, "d3", "o", "k", "n", "h1"), (4, "d4", "p", "k", "n", "h1")]
    df = spark.createDataFrame(rows, "position LONG, doc_id STRING, owner_id STRING, kb_id STRING, name STRING, content_hash STRING")
    got = {r["doc_id"]: (r["document_id"], r["previous_doc_id"], r["version"], r["duplicate_of"]) for r in ST.register_uploads(df, segment=2).collect()}
    assert got == {"d1": ("d1", None, 1, None), "d2": ("d1", "d1", 2, None), "d3": (None, None, None, "d1"), "d4": ("d4", None, 3, None)}
