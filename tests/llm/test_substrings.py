import hashlib
import random
from collections import Counter

from kgspark.llm.substrings import remove_repeats


def by_hand(rows, size):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i:i + size]) for _, w in words for i in range(len(w) - size + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_removed_words_are_those_under_repeated_windows(spark, edge, none, shared):
    rng = random.Random(2)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(2, 12))] for _ in range(8)]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 5)) for w in rng.choice(passages + [[f"u{i}"] * 3]))) for i in range(200)]
    rows += [(r["doc_id"], r["text"]) for r in edge.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, 7):
        found = remove_repeats(df, size).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == by_hand(rows, size)
        for r in found:
            assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
            assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))  # maximal intervals
    assert remove_repeats(none, 5).count() == 0


def test_windows_of_other_words_are_no_repeats(spark, shared, thue_morse):
    common = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([*common, last])) for i, last in enumerate(thue_morse)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect()
    assert [r["n_removed"] for r in found] == [0, 0]
    rows = [(i, " ".join(text)) for i, text in enumerate(thue_morse)]  # as sequences of one-letter words
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1024).collect()
    assert [r["n_removed"] for r in found] == [0, 0]
