import itertools
import zlib
from collections import Counter

from kgspark.llm.sharding import hilbert_cells, hilbert_shards


def test_curve_visits_every_cell_once_by_single_steps(spark):
    for dims, bits in ((2, 3), (3, 2)):
        names = [f"x{i}" for i in range(dims)]
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{n} int" for n in names))
        rows = sorted(hilbert_cells(cells, dims, bits).collect(), key=lambda r: r["curve"])
        assert [r["curve"] for r in rows] == list(range(1 << (dims * bits)))
        points = [tuple(r[f"c{i}"] for i in range(dims)) for r in rows]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_rows_are_dealt_evenly_and_slots_have_no_gaps(spark, edge):
    rows = hilbert_shards(edge, 4).collect()
    assert len(rows) == edge.count()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(4))
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in rows)


def test_more_shards_than_rows_and_empty_tables(spark, none):
    one = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [(r["shard"], r["slot"]) for r in hilbert_shards(one, 24).collect()] == [(0, 0)]
    assert hilbert_shards(none, 24).count() == 0
