"""The registered queries without an SQL twin, on all documents of the smallest tables, against plain loops."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kgspark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def ids_of(documents, name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return {d: plain.encode(t or "", add_special_tokens=False).ids + [end] for d, t in documents.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) < set(QUERIES)


def test_packing_holds_every_id_once(spark, documents, shared):
    want, rows = ids_of(documents, "word_bpe_49k.json", 1), QUERIES["op3_best_fit_packing"](spark, SMALL).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, whole in ((pieces, lambda d: len(want[d])), (windows, lambda _: None)):
        for key, parts in spans.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == whole(key) if whole(key) is not None else at <= 2048
    assert set(pieces) == set(want)
    assert len(windows) <= 1.02 * sum(map(len, want.values())) / 2048 + 1


def test_token_files_give_all_ids_back(spark, documents, shared):
    want, start = ids_of(documents, "byte_bpe_50k.json", 0), 0
    rows = sorted(map(tuple, QUERIES["op6_token_files"](spark, SMALL).collect()))
    assert [r[0] for r in rows] == sorted(want)
    for doc_id, at, n, check in rows:
        assert (at, n, check) == (start, len(want[doc_id]), crc(want[doc_id]))
        start += n


def test_scores_of_the_word_unigram(spark, documents, shared):
    rows = QUERIES["op7_lattice_scores"](spark, SMALL).collect()
    words = {d: (t or "").encode().lower().split() + [None] for d, t in documents.items()}
    held = {d for d in words if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d, ws in words.items() if d not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(words)
    for r in rows:
        ws = words[r["doc_id"]]
        assert tuple(r)[1:5] == (r["doc_id"] in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert -math.inf < r["score"] < 0
