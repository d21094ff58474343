import random

import numpy as np

from kgspark.llm import near_duplicates as nd
from kgspark.llm import setsketch


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def by_hand(rows, size, per_cent):
    sets = {d: shingles(t, size) for d, t in rows if d is not None}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= per_cent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                group[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def corpus(rng, n):
    """Copies of a few texts with more and more words changed, chains of edits, and unrelated texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


def test_groups_equal_those_of_all_pairs(spark, shared):
    for size, seed in ((4, 1), (5, 2)):
        rows = list(enumerate(corpus(random.Random(seed), 300)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, size, 80).collect()}
        assert got == by_hand(rows, size, 80)


def test_large_groups_go_through_blocks(spark, shared, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "LUMP", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(80)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, 5, 80).collect()}
    assert got == by_hand(rows, 5, 80)


def test_long_chains_make_one_component(spark, shared):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_hard_cases(spark, edge, none, shared):
    extra = edge.unionByName(edge.limit(0)).collect()
    rows = {r["doc_id"]: r for r in nd.near_duplicates(edge, 5, 80).collect()}
    assert len(extra) == nd.near_duplicates(edge, 5, 80).count()
    assert [rows[i]["n_shingles"] for i in (1, 2, 3)] == [0, 0, 0] and all(rows[i]["kept"] for i in (1, 2, 3))
    assert (rows[6]["component_id"], rows[6]["kept"], rows[5]["kept"]) == (5, False, True)
    assert nd.near_duplicates(none, 5, 80).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(nameless, 5, 80).collect()), key=str) == [(3, 2, 3, True), (None, 2, None, True)]


def test_registers_estimate_similarity_and_merge():
    rng = np.random.default_rng(7)
    for true in (0.5, 0.8, 0.95):
        errors, equal = [], []
        for _ in range(60):
            common = int(round(600 * true))
            a = rng.integers(0, 2**63, 600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            b = np.concatenate([a[:common], rng.integers(0, 2**63, 600 - common, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
            exact = common / (1200 - common)
            both = setsketch.sketches(np.concatenate([a, b]), np.array([0, 600, 1200]))
            joined = setsketch.sketches(np.union1d(a, b), np.array([0, 1200 - common]))[0]
            assert np.array_equal(setsketch.merge(both[0], both[1]), joined)
            more, less = (both[0] > both[1]).sum(), (both[0] < both[1]).sum()
            found = setsketch.similarity(np.array([more]), np.array([less]), np.array([600.0]), np.array([600.0]))[0]
            errors.append(found - exact)
            equal.append((both[0] == both[1]).mean() - exact)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
        assert abs(np.mean(equal)) < 0.02


def test_other_words_do_not_link(spark, shared, thue_morse):
    df = spark.createDataFrame(list(enumerate(thue_morse)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df).collect()} == {0: 0, 1: 1}


def test_an_id_with_different_texts_is_one_document(spark, shared, monkeypatch):
    monkeypatch.setattr(nd, "TILE_BYTES", 400)  # few sets at once
    one, two, three = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(5, one), (5, two), (6, one), (7, two), (8, three), (5, one), (3, three + " more"), (9, None), (9, three)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {(r["doc_id"], r["component_id"]) for r in found}
    assert len(found) == len(rows) and (9, 9) in groups  # a row without a set links with nothing
    group = dict(groups - {(9, 9)})
    assert sorted(group) == [3, 5, 6, 7, 8, 9] and len(groups) == 7  # otherwise one group for each id
    assert group[3] == group[8] == group[9] == 3 and group[5] == 5
    assert sorted((group[6], group[7])) in ([5, 6], [5, 7])  # id 5 is linked by one of its texts


def test_sets_of_any_size_travel_in_bounded_tiles(spark, shared, monkeypatch):
    monkeypatch.setattr(nd, "TILE_BYTES", 2000)
    monkeypatch.setattr(nd, "LUMP_BYTES", 3000)
    rng = random.Random(9)
    rows = list(enumerate(corpus(rng, 80)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, 4, 80).collect()}
    assert found == by_hand(rows, 4, 80)
