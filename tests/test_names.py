import random
import subprocess
import sys
import time

from kgspark.operators import graph_query as N
from kgspark.operators.names import Finder, marks_in_own_texts, names_in_texts


def test_every_name_is_found_once_per_text(spark):
    rng = random.Random(1)
    names = [None, "", "a", "ab", "aba", "é漢", "the end", "nowhere else", "ab"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [(i, "".join(rng.choice("abcé漢 ") for _ in range(rng.randint(0, 80)))) for i in range(120)] + [(500, None), (501, ""), (502, "at the end")]
    want = sorted((i, n) for i, t in texts for n in {x for x in names if x} if n in (t or ""))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(n, 1) for n in names], "label string, text int")
    assert want
    for part_chars in (10**6, 40):  # one automaton that travels, or several that meet blocks of texts
        assert sorted(map(tuple, names_in_texts(docs, marks, part_chars=part_chars).collect())) == want
    assert names_in_texts(docs, marks.where("false")).count() == 0
    assert names_in_texts(docs.where("false"), marks, part_chars=40).count() == 0


def test_marks_are_looked_for_in_their_own_text_only(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "beta"), (1, "gamma"), (1, "beta"), (2, "a g"), (2, None), (2, ""), (3, "x"), (9, "beta")], "doc_id long, mark string")
    assert sorted(map(tuple, marks_in_own_texts(docs, marks).collect())) == [(1, "beta"), (2, "a g")]


def test_work_is_linear_in_the_text_and_not_in_the_names():
    rng = random.Random(2)
    names = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))) for _ in range(10_000)})
    text = "".join(rng.choice("abcdefgh") for _ in range(400_000))

    def seconds(finder, given):
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            finder.find(given)
            best = min(best, time.perf_counter() - start)
        return best

    many, few = Finder(names), Finder(names[:10])
    assert sorted(many.find(text[:50_000])) == sorted(n for n in names if n in text[:50_000])
    assert seconds(many, text) < 16 * seconds(many, text[:100_000]) and seconds(many, text) < 60 * seconds(few, text)


def test_names_of_a_million_characters():
    """In a process of its own: an automaton of that depth ended it with a segmentation fault."""
    code = f"""if True:
        import random
        import sys
        sys.path[:0] = {sys.path!r}
        from kgspark.operators.names import Finder
        rng = random.Random(4)
        body = "".join(rng.choices("abcdefgh", k=1_000_000))
        names = [body, body + "b", body[-2:] + "b", body[:10_000], body[:10_001], body[:10_001] + "x"]
        finder = Finder(names)
        for text in ("x" + body + "b", body[:10_001] + "x", body[:9_999]):
            there = [n for n in names if n in text]
            assert finder.find(text) == sorted(there, key=lambda n: (text.index(n) + len(n), -len(n)))
    """
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr


def test_longest_labels_win_and_ties_stay(spark):
    nodes = spark.createDataFrame([("n1", "graph"), ("n2", "graph store"), ("n3", "store one"), ("n4", "x"), ("n5", "graph store"), ("n6", None)], "name string, label string")
    asked = spark.createDataFrame([(1, "the graph store one"), (2, "a graph"), (3, "x"), (4, None)], "query_id long, text string")
    found = sorted((r["query_id"], r["name"]) for r in N.label_seeds(nodes, asked).collect())
    assert found == [(1, "n2"), (1, "n5"), (2, "n1")]
