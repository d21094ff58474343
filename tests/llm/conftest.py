import pytest

from kgspark.llm import exchange, near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: NULLs, empty and odd texts, ties and a repeated row; the long text has a megabyte.
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3),
    (5, "Some words, that are REPEATED here.\nAnd a second line.", "en", "b", 50),
    (6, "Some words, that are REPEATED here.\nAnd a second line.", "de", "b", 50),
    (7, "long text " * 100_000, "fr", "c", 1_000_000), (8, "é ß 漢字   x y <|endoftext|>", "xx", "c", 20),
    (9, "tie", "en", "d", 3), (9, "tie", "en", "d", 3),
]


@pytest.fixture
def edge(spark):
    """Documents with hard cases and extra columns whose names clash with ours."""
    rows = [(*r, 1, "x", 2) for r in EDGE]
    return spark.createDataFrame(rows, DOCS + ", score int, shard string, _n int")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    """Small inputs need few tasks."""
    monkeypatch.setattr(exchange, "LEAST_PARTS", 4)
    monkeypatch.setattr(near_duplicates, "LEAST_PARTS", 4)


@pytest.fixture
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return str(tmp_path_factory.mktemp("work"))


@pytest.fixture
def thue_morse():
    """Two strings of 1024 letters that collide under any polynomial modulo 2**64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
