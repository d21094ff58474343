import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kgspark.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def slow_lattice(lattice, counts, ends, word):
    """Log10 of the sum over all cuts of a word into pieces, by recursion over its bytes."""
    model = lm.load_pieces(PATH)
    total = counts.sum() + ends + len(counts) + 1
    weight = Counter()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", "\0").encode()
        weight[piece.replace(b"\0", b"\xff") if not model.is_byte(i) else piece] += (counts[i] + 1) / total
    text = b"\xff" + word
    reach = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        reach[end] = sum(reach[start] * weight.get(text[start:end], 0.0) for start in range(max(0, end - 48), end))
    return math.log10(reach[-1])


def test_marginals_sum_over_all_cuts():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, lm.load_pieces(PATH).get_piece_size())
    lattice = lm.Lattice(PATH, counts, 10)
    words = ["the", "international", "é漢字", "x", "a" * 100, "▁odd", "zq%%"]
    data = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.append(0, ends[:-1])
    got = lattice.words(np.frombuffer(data, np.uint8), starts, ends)
    for word, g in zip(words, got):
        assert g == pytest.approx(slow_lattice(lattice, counts, 10, word.encode()), rel=1e-9)


def test_base_scores_and_counts(spark, edge, none, shared):
    more = [(100 + i, f"the {i} word of the text number {i % 7} token") for i in range(60)]
    df = edge.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = lm.score_documents(df, PATH, ~held).collect()
    given = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in df.collect()]
    out = {d for d, _ in given if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d, ws in given if d not in out for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, d in out, len(ws), sum(counts[w] > 0 for w in ws), n) for d, ws in given)
    assert Counter(tuple(r)[:5] for r in rows) == want
    base = {d: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for d, ws in given}
    for r in rows:
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9)
        assert -math.inf < r["score"] < 0
    assert lm.score_documents(none, PATH, F.lit(True)).count() == 0


def test_without_training_texts_scores_stay_finite(spark, edge, shared):
    rows = lm.score_documents(edge, PATH, F.lit(False)).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) and r["n_known"] == 0 and r["held_out"] for r in rows)


def test_scores_do_not_depend_on_the_layout(spark, shared, monkeypatch):
    rows = [(i, f"the frequent international words {i} of unseenword{i % 9} and tokenisation{i % 5}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    one = {r["doc_id"]: r["score"] for r in lm.score_documents(df.coalesce(1), PATH, ~held).collect()}
    monkeypatch.setattr(lm, "RUN_BYTES", 200)  # many runs, each with the frequent words
    many = {r["doc_id"]: r["score"] for r in lm.score_documents(df.repartition(7), PATH, ~held).collect()}
    assert many == pytest.approx(one, rel=1e-12) and len(one) == 80


def test_words_are_known_by_their_bytes(spark, shared, thue_morse):
    df = spark.createDataFrame(list(enumerate(thue_morse)), "doc_id long, text string")
    rows = {r["doc_id"]: r["n_known"] for r in lm.score_documents(df, PATH, F.col("doc_id") == 0).collect()}
    assert rows == {0: 2, 1: 1}  # the other word is new, its end is not
