import hashlib
import random
from collections import Counter

import numpy as np

from kgspark.llm import digests


def plain_digest(text):
    data, counts = text.encode(), [0] * 256
    for i in range(len(data) - 2):
        counts[(data[i] + 256 * data[i + 1] + 65536 * data[i + 2]) * digests.MULTIPLIER % 2**32 >> 24] += 1
    ordered = sorted(counts)
    q1, q2, q3 = ordered[63], ordered[127], ordered[191]
    code = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    n = len(data)
    size = 1 + 4 * (n.bit_length() - 1) + ((n << 2 >> (n.bit_length() - 1)) & 3) if n else 0
    ratios = [min(16 * q // max(q3, 1), 15) for q in (q1, q2)]
    body = bytes(sum(code[4 * i + j] << 2 * j for j in range(4)) for i in range(64))
    return bytes([size, 16 * ratios[0] + ratios[1]]) + body, code


def plain_likeness(a, b):
    (x, p), (y, q) = plain_digest(a), plain_digest(b)
    steps = sum({3: 6}.get(abs(i - j), abs(i - j)) for i, j in zip(p, q))
    steps += min(4 * abs(x[0] - y[0]), 48) + 2 * abs((x[1] >> 4) - (y[1] >> 4)) + 2 * abs((x[1] & 15) - (y[1] & 15))
    return 1 - min(steps, 512) / 512


def by_hand(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        moved = len(t) // 4
        edited = t[:len(t) - moved] + after[:moved]
        prints = [plain_digest(x)[0].hex() for x in (t, edited)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, plain_likeness(t, edited), plain_likeness(t, after)))
    return Counter(out)


def some_texts(rng, n):
    return ["".join(rng.choice("abcdefgh é漢🙂\n") for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 40, 900]))) for _ in range(n)]


def test_rows_equal_plain_loops(spark, edge, none, shared, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(20, 140)]), t) for t in some_texts(rng, 150)] + [(r["doc_id"], r["text"][:3000] if r["text"] else r["text"]) for r in edge.collect()]
    for run in (100, 1 << 20):
        monkeypatch.setattr(digests, "RUN_BYTES", run)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, part int").repartition(5)
        got = digests.compare_with_next(df, part_bytes=3000).collect()
        assert Counter(map(tuple, got)) == by_hand(rows)
    one = spark.createDataFrame([(3, "alone and its own successor")], "doc_id long, text string")
    assert Counter(map(tuple, digests.compare_with_next(one).collect())) == by_hand([(3, "alone and its own successor")])
    assert digests.compare_with_next(none).count() == 0


def test_long_texts_and_equal_texts(spark, edge):
    prints = {r["doc_id"]: r["fingerprint"] for r in digests.with_fingerprints(edge.withColumnRenamed("shard", "fingerprint")).collect()}
    assert prints[5] == prints[6] and prints[1] == prints[2] and prints[7] == plain_digest("long text " * 100_000)[0].hex()


def test_likeness_is_bounded_and_tells_edits_from_other_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(40)]
    edited = [t[:len(t) * 3 // 4] + u[:len(t) // 4] for t, u in zip(texts, texts[1:] + texts[:1])]
    own, new, other = (digests.of_texts([t.encode() for t in x]) for x in (texts, edited, texts[1:] + texts[:1]))
    near, far = digests.likeness(own, new), digests.likeness(own, other)
    assert near.min() > far.max() and (digests.likeness(own, own) == 1).all() and 0 <= far.min()
    assert np.array_equal(digests.likeness(own, other), digests.likeness(other, own))
