import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kgspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text):
    found = words(text)
    return [zlib.crc32(" ".join(found[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def by_hand(rows, target, per_cent, least):
    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, x in rows:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in features(x))
        out.append([d, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[:per_cent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


def corpus(rng, n):
    vocabulary = ["the", "The", "a1", "é", "漢字" * 30, "y" * 100, "rare%d", "und"]
    return [(i, " ".join(rng.choice(vocabulary).replace("%d", str(i)) + rng.choice(["", ",", "_", "\x7f"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_states_are_put_together_to_crcs_of_whole_strings():
    rng = random.Random(1)
    ends = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 63, 64, 65, 200, 5000]))) for _ in range(300)]
    starts = [bytes(rng.randrange(256) for _ in range(rng.randrange(50))) for _ in ends]
    a, b = (np.array([zlib.crc32(x) for x in side], np.uint32) for side in (starts, ends))
    got = importance.shifted(a, np.array([len(x) for x in ends])) ^ b
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(starts, ends)]


def test_buckets_do_not_depend_on_the_head():
    texts = [None, "", "one", "?!"] + [t for _, t in corpus(random.Random(2), 100)]
    found = importance._words(pa.array(texts, pa.string()))
    want = [Counter(features(t)) for t in texts]
    for head in (importance.Head([], []), importance.Head([b"the", b"und", b"a1"], [b"the the", b"und the", b"the other"])):
        buckets, at = importance.buckets_of(found, head)
        got = [Counter() for _ in texts]
        for doc, bucket in zip(found.doc[at].tolist(), buckets.tolist()):
            got[doc][bucket] += 1
        assert got == want


def test_draw_equals_plain_loops(spark, edge, none, shared, monkeypatch):
    monkeypatch.setattr(importance, "RUN_BYTES", 3000)  # many runs
    rows = [(100 + i, t) for i, t in corpus(random.Random(3), 300)]
    rows += [(r["doc_id"], r["text"]) for r in edge.collect()] + [(None, "the und " * 20)] * 3 + rows[:2]
    target = [None, "", "The a1 é und", "the und the und rare7"]
    df = edge.select("doc_id", "text", "lang", "score").unionByName(
        spark.createDataFrame(rows[300 + 10:] + rows[:300], "doc_id long, text string"), allowMissingColumns=True
    )
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(target)], "item_id long, text string, rank int")
    found = importance.resample(df, bench, per_cent=20)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    assert Counter(map(tuple, found.collect())) == by_hand(rows, target, 20, 20)
    assert importance.resample(none, bench).count() == 0
    empty = importance.resample(df.where(F.col("doc_id") < 120), bench.where("false")).collect()
    assert Counter(map(tuple, empty)) == by_hand([r for r in rows if r[0] is not None and r[0] < 120], [], 5, 20)


def test_frequent_terms_are_counted_in_some_run(spark, shared):
    df = spark.createDataFrame([(i, f"often the pair of {i} and {i + 1000}") for i in range(50)], "doc_id long, text string")
    words_found, pairs = importance.head_of(df)
    assert {b"often", b"the", b"pair"} <= set(words_found) and b"the pair" in pairs and b"7" not in words_found[:4]
