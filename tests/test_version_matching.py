import random
from difflib import SequenceMatcher

import pyarrow as pa

from kgspark.operators import versioning as D


def brute(old, new):
    """All pairs, then first come: what the rule says, word for word."""
    used, rows = set(), []
    for place, (anchor, text) in enumerate(new):
        scored = []
        for at, (a, t) in enumerate(old):
            score = SequenceMatcher(None, t, text).ratio() + (D.SAME_PLACE if a == anchor else 0.0)
            if at not in used and score >= D.SIMILAR:
                scored.append((-score, at, a == anchor))
        if scored:
            score, at, stays = min(scored)
            used.add(at)
            rows.append((at, place, stays, -score))
    return rows


def matched(old, new):
    left = pa.table({"doc_id": [7] * len(old), "old_pos": list(range(len(old))), "_a": [a for a, _ in old], "_old": [t for _, t in old]})
    right = pa.table({"doc_id": [7] * len(new), "new_pos": list(range(len(new))), "_b": [a for a, _ in new], "_new": [t for _, t in new]})
    found = D._first_come(["doc_id", "old_pos", "new_pos", "stays", "score"])(left, right)
    return [(r["old_pos"], r["new_pos"], r["stays"], r["score"]) for r in found.to_pylist()]


def texts(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_matches_are_those_of_all_pairs():
    for seed in range(6):
        words = ["the", "graph", "of", "知识", "图谱", "nodes", "é", "42"]
        old = [(f"index:{i}", t) for i, t in enumerate(texts(seed, 25, words))]
        new = [(f"index:{i}", t) for i, t in enumerate(texts(seed + 100, 20, words) + [t + " revised" for _, t in old[:6]])]
        assert matched(old, new) == brute(old, new)


def test_revised_texts_are_not_compared_with_all_others(monkeypatch):
    calls = []
    plain = SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: calls.append(1) or plain(self))
    rng = random.Random(3)
    old = [(f"o{i}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))) for i in range(150)]
    new = [(f"n{i}", t + " revised 42") for i, (_, t) in enumerate(old)]
    assert [(o, n) for o, n, _, _ in matched(old, new)] == [(i, i) for i in range(150)]
    assert len(calls) < 150 * 150 / 20


def test_summary_counts_kinds_without_scoring_all_pairs(spark):
    """Long versions: the summary follows from the same matching."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(50)) for _ in range(400)]
    frame = lambda rows: D.decorate(spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id INT, pos INT, content STRING"))
    new = [t + " revised 42" for t in lines[:200]] + lines[200:390]
    row = D.change_summary(D.compare(frame(lines), frame(new)), ["doc_id"]).first().asDict()
    assert row == {"doc_id": 1, "unchanged": 190, "added": 0, "modified": 200, "deleted": 10, "moved": 0, "changed": 210}


def test_versions_are_computed_once(spark):
    """Of every chunk the text is asked for once, although many joins read places and hashes."""
    from pyspark.sql import functions as F

    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        asked.add(1)
        return text

    def frame(rows):
        plain = spark.createDataFrame([(i % 3, i // 3, t) for i, t in enumerate(rows)], "doc_id INT, pos INT, content STRING")
        return plain.select("doc_id", "pos", F.explode(F.array(counted("content").alias("c"))).alias("content"))

    lines = [f"line {i} of a version" for i in range(30)]
    changes = D.compare(D.decorate(frame(lines)), D.decorate(frame(lines[:24] + ["something else 42"])))
    assert sorted(r["kind"] for r in changes.collect()).count("unchanged") == 24
    assert asked.value == 30 + 25
