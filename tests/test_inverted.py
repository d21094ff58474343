import random

import pytest

from kgspark.operators import inverted
from kgspark.operators import lexical as L
from kgspark.operators.inverted import InvertedIndex


def corpus(rng, n):
    """Words of very different frequency, texts of very different length, and exact copies (ties)."""
    words = [f"w{int(1 / (rng.random() + 0.002))}" for _ in range(4000)] + ["图谱检索", "A_1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 20, 200]))) for _ in range(n)]
    return [(i, rng.choice(texts[:20]) if i % 5 == 0 else texts[i]) for i in range(n)] + [(n, None), (n + 1, "")]


def ranked(df):
    return {(r["query_id"], r["rank"]): (r["doc_id"], round(r["raw_score"], 8), round(r["keyword_score"], 8)) for r in df.collect()}


@pytest.mark.parametrize("shard_docs", [7, 16_384])
def test_hits_equal_those_of_full_scores(spark, tmp_path, shard_docs):
    rng = random.Random(1)
    docs = spark.createDataFrame(corpus(rng, 400), "doc_id long, text string").repartition(3)
    asked = [(i, t) for i, t in corpus(rng, 30)] + [(900, "unknown words only"), (901, "w1 w1 w1 图谱")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = InvertedIndex(spark, str(tmp_path / "index")).add(docs, shard_docs)
    for k in (1, 3, 50):
        assert ranked(index.search(queries, k)) == ranked(L.keyword_hits(docs, queries, k))


def test_an_index_that_grew_equals_one_built_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "GROUP", 5)
    rng = random.Random(2)
    docs = spark.createDataFrame(corpus(rng, 200), "doc_id long, text string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in corpus(rng, 20)], "query_id string, text string")
    index = InvertedIndex(spark, str(tmp_path / "index"))
    for third in range(3):
        index.add(docs.where(f"doc_id % 3 = {third}"))
    index.add(docs.where("false"))
    again = InvertedIndex(spark, str(tmp_path / "index"))  # opened by its folder alone
    assert ranked(again.search(queries, 10)) == ranked(L.keyword_hits(docs, queries, 10))
    assert again.search(queries.where("false"), 10).count() == 0


def test_blocks_that_cannot_reach_the_floor_are_skipped(spark, tmp_path):
    """A rare word decides; most postings of the frequent ones need not be scored."""
    rng = random.Random(3)
    rows = [(i, " ".join(["often"] * rng.randint(1, 4) + [f"u{i}"] * rng.randint(1, 30) + (["rare", "seldom"] if i % 400 == 7 else []))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "rare often seldom")], "query_id long, text string")
    index = InvertedIndex(spark, str(tmp_path / "index")).add(docs)
    assert ranked(index.search(queries, 5)) == ranked(L.keyword_hits(docs, queries, 5))
    assert index.skipped(queries, 5) > 0.9
