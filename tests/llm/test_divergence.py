import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgspark.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, l, s in rows:
        found = [w.translate(LOWER) for w in WORD.findall(t)]
        counts[l, s].update(found)
        docs[l].update(set(found))
        groups[l].add(s)
    out = []
    for l, sources in groups.items():
        kept = sorted((w for w, n in docs[l].items() if n >= least), key=str.encode)
        every = Counter()
        for s in sources:
            every.update({w: counts[l, s][w] for w in kept})

        def shares(c):
            size = sum(c[w] for w in kept)
            return [1 + 10**9 * (c[w] + 5) // (size + 5 * len(kept)) for w in kept]

        p, q = {s: shares(counts[l, s]) for s in sources}, shares(every)
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [(a - b, w) for w, a, b in zip(kept, p[s], q) if counts[l, s][w] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(l, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return Counter(out)


def corpus(rng, n):
    words = [f"{a}{b}" for a in "ABcdé漢" for b in ("", "x", "Yz", "ü")]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["a", "a", "a", "b", "c", None, "long source"])
        rows.append((rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else " ".join(rng.choice(words[:rng.randint(1, len(words))]) + rng.choice(["", "1", "_"]) for _ in range(30)), lang, source))
    return rows + [("only once", "single", "a"), (None, "bare", "a"), ("rare", "bare", "b")]


@pytest.mark.parametrize("block, tile", [(16_384, 64), (3, 2)])
def test_rows_equal_plain_loops(spark, shared, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "RUN_BYTES", 500)
    rows = corpus(random.Random(6), 250)
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, source string, n int, term string")
    got = divergence.audit(df.repartition(3), least_docs=30, top=7, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == by_hand(rows, 30, 7)


def test_hard_cases(spark, edge, none, shared):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge.collect()]
    assert Counter(map(tuple, divergence.audit(edge, least_docs=1).collect())) == by_hand(rows, 1, 50)
    assert divergence.audit(none).count() == 0


def test_shares_are_exact_for_great_counts():
    n = np.array([0, 7, 10**10, 2**52 - 10**6], np.int64)
    for size, terms in ((int(n.sum()), 4), (2**53, 4), (0, 3)):
        if size >= n.max():
            assert divergence.shares(n, size, terms).tolist() == [1 + 10**9 * (x + 5) // (size + 5 * terms) for x in n.tolist()]
    assert divergence.shares(np.zeros(2, np.int64), 0, 3).tolist() == [1 + 10**9 // 3] * 2


def test_stretches_meet_at_all_boundaries():
    rng = random.Random(7)
    for _ in range(200):
        columns = [[rng.choice([0, 0, 0, 5, 9]) for _ in range(40)] for _ in range(2)]
        coded = []
        for c in columns:
            ends = [i for i in range(1, 41) if i == 40 or c[i] != c[i - 1]]
            coded.append((np.array(ends), np.array([c[e - 1] for e in ends])))
        (a, x), (b, y) = coded
        assert divergence.stretch_sum((a, b), (x, y)) == sum(abs(i - j) for i, j in zip(*columns))
