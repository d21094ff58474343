import corpus_pipeline
from tests.llm.test_decontamination import by_hand as leaks
from tests.llm.test_near_duplicates import by_hand as groups

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark, shared):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near duplicates", "benchmark decontamination", "secret scans", "packing"
    ]
    good = corpus_pipeline.quality(spark, docs, SMALL).cache()
    kept = {r["doc_id"] for r in good.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(known[d] != (d in kept) for d in known) <= 0.05 * len(known)

    single = corpus_pipeline.deduplicate(spark, good, SMALL).cache()
    want = groups([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, (_, _, first) in want.items() if first)

    clean = corpus_pipeline.decontaminate(spark, single, SMALL).cache()
    bad = {d for d, *_ in leaks([(r["doc_id"], r["text"]) for r in single.collect()], items, 0.8)}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - bad

    masked = corpus_pipeline.mask_secrets(spark, clean, SMALL).cache()
    assert masked.count() == clean.count()
    for frame in (good, single, clean, masked):
        assert frame.columns == docs.columns
    packed = corpus_pipeline.pack(spark, masked, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in masked.collect()}


def test_stages_take_empty_tables_and_hard_cases(spark, edge, none, shared):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0, name
        assert stage(spark, edge, SMALL).count() >= 0, name
    once = corpus_pipeline.deduplicate(spark, edge, SMALL).collect()
    assert sorted(r["doc_id"] for r in once) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_other_texts_of_an_id_stay(spark, shared):
    rows = [(1, "one text of the first id", "b"), (1, "another text of the first id", "a"), (1, "one text of the first id", "a"), (2, "something else", "c"), (None, "no id", "d"), (None, "no id", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = sorted(map(str, map(tuple, corpus_pipeline.deduplicate(spark, df, SMALL).collect())))
    assert left == sorted(map(str, [rows[1], rows[2], *rows[3:]]))
