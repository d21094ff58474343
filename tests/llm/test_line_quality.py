import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kgspark.llm import line_quality as lq
from kgspark.llm.queries import op1_line_field_quality

SMALL = "/root/testdata/sf0.01"


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(5)
    lean, tie, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    got, pairs = lq.forward_backward(lean, tie, first)
    want, seen = [], np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        total, ones = 0.0, np.zeros(b - a)
        both = np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            steps = list(zip(labels, labels[1:]))
            weight = np.exp(sum(x * y for x, y in zip(lean[a:b], labels)) + sum(tie[s] for s in steps))
            total += weight
            ones += weight * np.array(labels)
            for s in steps:
                both[s] += weight
        want += list(ones / total)
        seen += both / total
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def test_neighbours_do_not_cross_documents():
    lines = lq.Lines(pa.array(["One line.\nAnother LINE here\n\n  \n", None, "x y\n$$$ |||"], pa.string()))
    assert lines.first.tolist() == [0, 2, 2, 4]
    features = lines.features()
    width = lq.SHAPES
    assert np.array_equal(features[0, 2 * width:3 * width], features[1, :width])
    assert not features[0, width:2 * width].any() and not features[1, 2 * width:3 * width].any()
    assert not features[2, width:2 * width].any() and np.array_equal(features[3, width:2 * width], features[2, :width])


def test_held_out_documents_are_told_apart(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = op1_line_field_quality(spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_hard_cases_and_missing_labels(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None), (6, 3)], "doc_id long, quality int")
    model = lq.train(edge, labels, F.lit(True))
    rows = lq.score_documents(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {model["share"]}
    assert lq.score_documents(none, model).count() == 0
    unlabelled = lq.train(none, labels, F.lit(True))
    assert {r["score"] for r in lq.score_documents(edge, unlabelled).collect()} == {0.5}
