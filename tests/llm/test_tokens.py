import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kgspark.llm import arrays, packing, token_files, tokens
from kgspark.llm.tokens import Encoder, Known

LETTERS = "ab AB\n\t é ß漢'sS1.,   \x1c\r\x0b🙂ı́  "


def texts(n, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "\n\n", "  a b  "] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_are_those_of_bytes_split():
    given = texts(500)
    flat, offsets = arrays.text_bytes(pa.array(given, pa.string()))
    words = arrays.split_words(flat, offsets, lower=True)
    by_hash = defaultdict(set)
    for i, text in enumerate(given):
        span = slice(words.first[i], words.first[i + 1])
        found = [bytes(words.data[s:e]) for s, e in zip(words.start[span], words.end[span])]
        assert found == (text or "").encode().lower().split()
        for w, h in zip(found, words.hash[span]):
            by_hash[h].add(w)
    assert all(len(v) == 1 for v in by_hash.values())


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_whole_texts(name, spaces):
    given = texts(1000)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch([t or "" for t in given], add_special_tokens=False)]
    encoder = Encoder(public_tokenizers.path(name), spaces)
    for _ in range(2):  # the second time from the units that are known
        ids, first = encoder.encode(pa.array(given, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_are_told_apart_by_their_bytes(thue_morse, name, spaces):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    ids, first = Encoder(public_tokenizers.path(name), spaces).encode(pa.array(thue_morse))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in thue_morse]


def test_known_units_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 300)
    known = Known()
    for turn in range(3):
        units = [b"%d" % turn, b"x%d" % turn, b"long" * 20]
        known.add(units, np.arange(6, dtype=np.uint32), np.array([0, 2, 4]), np.array([2, 2, 2]))
        found = known.find([*units, b"none"])
        assert (found >= 0).tolist() == [turn < 1, turn < 1, False, False]  # full after the first; long units are not kept
    assert [known.pool[known.place[i]:known.place[i] + known.size[i]].tolist() for i in known.find([b"0", b"x0"])] == [[0, 1], [2, 3]]


def by_hand(df, name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return [(r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in df.collect()]


def test_blocks_round_trip_in_order_of_ids(spark, edge, none, shared, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(edge, f"{shared}/a", path, spaces=True, end_id=0)
    got = token_files.read_tokens(spark, f"{shared}/a").collect()
    want = sorted(by_hand(edge, "byte_bpe_50k.json", 0), key=lambda x: x[0])
    start = 0
    assert len(got) == len(want)
    for r, (doc_id, ids) in zip(sorted(got, key=lambda r: r["start"]), want):
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_files.write_tokens(none, f"{shared}/b", path, spaces=True, end_id=0)
    assert token_files.read_tokens(spark, f"{shared}/b").count() == 0


def test_one_document_is_read_alone():
    ids = [np.arange(5, dtype=np.uint32), np.arange(3, dtype=np.uint32)]
    block = token_files.Block(token_files.pack_block([None, 7], ids, b"", 4), b"")
    assert block.doc_ids == [None, 7] and block.read(1).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        token_files.Block(token_files.pack_block([1], ids[:1], b"x" * 100, 4), b"")


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([1, 5, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        plan = packing.best_fit(Counter(lengths), capacity)
        want, fill, taken = slow_best_fit(lengths, capacity), defaultdict(list), 0
        stops = [*plan[1:, 0], len(lengths)] if len(plan) else []
        for (no, window, per, offset, length), stop in zip(plan, stops):
            for j in range(stop - no):
                fill[window + j // per].append((offset + j % per * length, length))
                taken += 1
        assert taken == len(lengths)
        for spans in fill.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in s) for s in fill.values()) == sorted(want)


def test_pieces_hold_every_id_once(spark, edge, none, shared):
    path = public_tokenizers.path("word_bpe_49k.json")
    placed = packing.pack(packing.cut_documents(edge, path, end_id=1, with_ids=True)).cache()
    rows = placed.collect()
    want = Counter((d, tuple(ids)) for d, ids in by_hand(edge, "word_bpe_49k.json", 1))
    by_doc = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["ids"]))
    for (doc_id, ids), copies in want.items():
        assert len(by_doc[doc_id]) == copies * -(-len(ids) // 2048)
        pieces = dict(by_doc[doc_id])
        assert [i for s in sorted(pieces) for i in pieces[s]] == list(ids)
    assert sorted({r["sequence_id"] for r in rows}) == list(range(len({r["sequence_id"] for r in rows})))
    packed = packing.sequences(placed).collect()
    assert all(len(r["ids"]) == 2048 for r in packed)
    assert packing.pack(packing.cut_documents(none, path, end_id=1)).count() == 0
