"""Document probabilities of a subword lattice.

A vocabulary of subword pieces is given; its unigram weights are learnt from the distinct words of the
training documents, each cut into pieces once: words are made distinct in runs of RUN_BYTES of text, then
by their hashes in buckets over the whole corpus. The
probability of a word is the sum over all ways to cut it into pieces of the product of their weights, by
a forward recursion in log space; that of a text is the product over its words and the end of the text.
A word is its bytes after a word mark. Every byte is a piece too, so every text has a probability. Words
met in training are entries of the lattice as well: of N tokens and V distinct ones, a word met c times
has the share c / (N + V + 1), and all cuts into pieces together (V + 1) / (N + V + 1).

Beside it stands a plain word unigram with one added to every count, whose counts come from the whole
training corpus through ``exchange``: no table of words is broadcast or gathered.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import arrays
from kgspark.llm.common import cut_lineage
from kgspark.llm.exchange import PART_BYTES, bucket_slices, dump, load, part_count, with_parts

RUN_BYTES = 4 << 20
WORD_MARK = 0xFF  # no byte of UTF-8
END_KEY = np.uint64(0x5BD1E9955BD1E995)  # stands for the end of a text among word hashes
LONG_WORD = 64  # longer words go through the recursion by themselves
LATTICE_WORDS = 50_000
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Log10 weights of pieces by their bytes, and the forward recursion over many words at once."""

    def __init__(self, path: str, counts: np.ndarray, ends: int):
        """``counts``: uses of each piece in words of training; ``ends``: training texts. Every event gets one more."""
        model = load_pieces(path)
        weights = np.log10((counts + 1.0) / (counts.sum() + ends + len(counts) + 1.0))
        self.end = math.log10((ends + 1.0) / (counts.sum() + ends + len(counts) + 1.0))
        self.bytes = np.full(256, -np.inf)
        by_size: dict[int, list[tuple[bytes, float]]] = {}
        for i, w in enumerate(weights.tolist()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.bytes[value] = np.logaddexp(self.bytes[value] * np.log(10), w * np.log(10)) / np.log(10)
            else:
                piece = model.id_to_piece(i).replace("▁", "\0").encode().replace(b"\0", bytes([WORD_MARK]))
                by_size.setdefault(len(piece), []).append((piece, w))
        for piece, w in by_size.pop(1, []):
            self.bytes[piece[0]] = np.logaddexp(self.bytes[piece[0]] * np.log(10), w * np.log(10)) / np.log(10)
        self.sizes = []
        for size in sorted(by_size):
            pieces = by_size[size]
            data = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
            start = np.arange(len(pieces)) * size
            sums = arrays.prefix_hashes(data.astype(np.uint64) + np.uint64(1), arrays.BYTE_BASE)
            keys, order = np.unique(arrays.range_hashes(sums, start, start + size, arrays.BYTE_BASE), return_index=True)
            seen = np.zeros(1 << 16, bool)  # most substrings are no pieces; this tells at once
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.sizes.append((size, keys, np.array([w for _, w in pieces])[order], seen))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log10 probability of every word data[start:end]."""
        out = np.empty(len(start))
        size = end - start
        short = np.flatnonzero(size <= LONG_WORD)
        short = short[np.argsort(size[short], kind="stable")]  # words of like length share the loop's turns
        for low in range(0, len(short), LATTICE_WORDS):
            some = short[low:low + LATTICE_WORDS]
            out[some] = self._forward(data, start[some], size[some])
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = self._forward(data, start[i:i + 1], size[i:i + 1])[0]
        return out

    def _forward(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = size + 1  # with the word mark
        first = np.cumsum(n) - n
        word = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(word)) - first[word]
        text = np.where(inside == 0, WORD_MARK, data[np.minimum(start[word] + inside - 1, len(data) - 1)]).astype(np.uint8)
        left = n[word] - inside
        sums = arrays.prefix_hashes(text.astype(np.uint64) + np.uint64(1), arrays.BYTE_BASE)
        at, stop, weight = [np.arange(len(text))], [inside + 1], [self.bytes[text]]
        for length, keys, values, seen in self.sizes:
            here = np.flatnonzero(left >= length)
            if not len(here):
                break
            found = arrays.range_hashes(sums, here, here + length, arrays.BYTE_BASE)
            maybe = np.flatnonzero(seen[(found & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(keys, found[maybe]), len(keys) - 1)
            hit = keys[slot] == found[maybe]
            at.append(here[maybe[hit]])
            stop.append(inside[at[-1]] + length)
            weight.append(values[slot[hit]])
        at, stop, weight = np.concatenate(at), np.concatenate(stop), np.concatenate(weight) * np.log(10)
        order = np.argsort(stop.astype(np.int16) if len(n) > 1 else stop, kind="stable")
        at, weight, stop = at[order], weight[order], stop[order]
        bounds = np.searchsorted(stop, np.arange(1, int(n.max()) + 2))
        reached = np.full(len(text) + 1, -np.inf)  # log probability of what stands before each byte
        reached[first] = 0.0
        total = np.full(len(n), -np.inf)
        for low, high in zip(bounds, bounds[1:]):
            edge = at[low:high]
            value, target = reached[edge] + weight[low:high], word[edge]
            best = np.full(len(n), -np.inf)
            np.maximum.at(best, target, value)
            top = np.where(np.isfinite(best), best, 0.0)
            with np.errstate(divide="ignore"):
                now = top + np.log(np.bincount(target, np.exp(value - top[target]), len(n)))
            place = int(stop[low]) if high > low else 0
            live = np.flatnonzero(n > place)
            reached[first[live] + place] = now[live]
            done = n == place
            total[done] = now[done]
        return total / np.log(10)


def whole_or_cut(counts: np.ndarray, cut: np.ndarray, base: float) -> np.ndarray:
    """Log10 of a word's share as an entry of its own (``counts / 10**base``) plus ``10**cut``."""
    with np.errstate(divide="ignore"):
        whole = np.log(counts.astype(float)) - base * np.log(10)
    return np.logaddexp(whole, cut * np.log(10)) / np.log(10)


_lattices: dict[str, Lattice] = {}
_models: dict = {}
COUNTED = "bucket long, keys binary, counts binary, words binary"


def _train_counts(buckets: int):
    """Task function: distinct words of training texts by bucket, with their hashes and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.row_runs(batch.column(0), RUN_BYTES):
                words = arrays.split_words(*arrays.text_bytes(batch.column(0).slice(low, high - low)), lower=True)
                keys, where, counts = np.unique(words.hash, return_index=True, return_counts=True)
                raw = words.data.tobytes()
                some = [raw[s:e] for s, e in zip(words.start[where].tolist(), words.end[where].tolist())]
                at = int(np.searchsorted(keys, END_KEY))
                keys, counts = np.insert(keys, at, END_KEY), np.insert(counts, at, high - low)
                some.insert(at, b"")  # the end has no spelling
                found, bounds = bucket_slices(keys, buckets)
                spans = list(zip(bounds, bounds[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, pa.int64()), pa.array([dump(keys[a:b], ascending=True) for a, b in spans], pa.binary()),
                        pa.array([dump(counts[a:b]) for a, b in spans], pa.binary()), pa.array([b" ".join(some[a:b]) for a, b in spans], pa.binary()),
                    ],
                    ["bucket", "keys", "counts", "words"],
                )

    return count


def _learn(path: str, salts: int):
    """Group function: one bucket's words with their counts summed, and uses of pieces in them (a bucket below 0)."""

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        if path not in _models:
            _models[path] = load_pieces(path)
        model, bucket = _models[path], key[0].as_py()
        pieces = np.zeros(model.get_piece_size(), np.int64)
        keys = np.concatenate([load(x.as_py(), ascending=True) for x in table.column("keys")])
        _, first = np.unique(keys, return_index=True)  # once per distinct word: pieces stand for new ones
        words = [w for x in table.column("words") for w in x.as_py().split(b" ")]
        some = [words[i].decode() for i in first.tolist() if words[i]]
        for a in range(0, len(some), 10_000):
            flat = np.array([i for ids in model.encode(some[a:a + 10_000]) for i in ids], np.int64)
            pieces += np.bincount(flat, minlength=len(pieces))
        used = np.flatnonzero(pieces)
        if not len(used):
            return _add_up(key, table)
        in_words = {"keys": dump(used, ascending=True), "counts": dump(pieces[used])}
        uses = pa.table({"bucket": pa.array([-1 - bucket % salts], pa.int64())} | {n: pa.array([x], pa.binary()) for n, x in in_words.items()} | {
            "tokens": pa.array([0], pa.int64()), "distinct": pa.array([0], pa.int64()),
        })
        return pa.concat_tables([_add_up(key, table), uses])

    return learn


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Sums the counts of equal keys of one bucket."""
    keys = np.concatenate([load(x.as_py(), ascending=True) for x in table.column("keys")])
    counts = np.concatenate([load(x.as_py()) for x in table.column("counts")])
    distinct, which = np.unique(keys, return_inverse=True)
    sums = np.bincount(which, counts.astype(np.float64), len(distinct)).astype(np.int64)  # exact below 2**53
    return pa.table({
        "bucket": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([dump(distinct, ascending=True)], pa.binary()),
        "counts": pa.array([dump(sums)], pa.binary()), "tokens": pa.array([int(sums.sum())], pa.int64()),
        "distinct": pa.array([len(distinct)], pa.int64()),
    })


SUMMED = "bucket long, keys binary, counts binary, tokens long, distinct long"


def _ask(buckets: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        words = arrays.split_words(*arrays.text_bytes(table.column("text").combine_chunks()), lower=True)
        keys = np.unique(np.append(words.hash, END_KEY))
        found, bounds = bucket_slices(keys, buckets)
        return pa.table({
            "bucket": pa.array(found, pa.int64()), "asker": pa.array([key[0].as_py()] * len(found), pa.int64()),
            "wanted": pa.array([dump(keys[a:b], ascending=True) for a, b in zip(bounds, bounds[1:])], pa.binary()),
        })

    return ask


def _answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    if known.num_rows:
        keys, counts = load(known.column("keys")[0].as_py(), ascending=True), load(known.column("counts")[0].as_py())
    else:
        keys = counts = np.zeros(1, np.uint64)
    out = []
    for blob in asked.column("wanted"):
        wanted = load(blob.as_py(), ascending=True)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out.append(dump(np.where(keys[at] == wanted, counts[at], 0)))
    return pa.table({
        "part": asked.column("asker"), "bucket": pa.array([key[0].as_py()] * len(out), pa.int64()), "told": pa.array(out, pa.binary()),
    })


def score_documents(df: DataFrame, path: str, train, part_bytes: int = PART_BYTES) -> DataFrame:
    """Scores every row of ``df``; the models learn from the rows for which column ``train`` holds.

    NULL and empty texts consist of the end alone. Repeated rows count and are scored each; without any
    training row all counts are 0 and both models still give finite scores; an empty table gives no rows.
    Other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    parts = part_count(docs, part_bytes)
    salts = math.isqrt(parts) + 1
    counted = docs.where("train").select("text").mapInArrow(_train_counts(parts), COUNTED)
    table = cut_lineage(counted.groupBy("bucket").applyInArrow(_learn(path, salts), SUMMED))
    # At most ``salts`` vectors of one number per piece of the vocabulary meet here.
    used = table.where("bucket < 0").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_add_up, SUMMED)
    used = used.select(F.lit(-1).cast("long").alias("bucket"), "keys", "counts").groupBy("bucket").applyInArrow(_add_up, SUMMED).collect()
    words = table.where("bucket >= 0")
    total, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = docs.where("train").count()
    pieces = np.zeros(load_pieces(path).get_piece_size(), np.int64)
    for row in used:
        pieces[load(bytes(row["keys"]), ascending=True).astype(np.int64)] = load(bytes(row["counts"])).astype(np.int64)
    model_id = uuid.uuid4().hex

    def apply(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if model_id not in _lattices:
            _lattices.clear()
            _lattices[model_id] = Lattice(path, pieces, ends)
        lattice = _lattices[model_id]
        words = arrays.split_words(*arrays.text_bytes(texts.column("text").combine_chunks()), lower=True)
        keys, where, which = np.unique(words.hash, return_index=True, return_inverse=True)
        asked = np.unique(np.append(keys, END_KEY))
        found, bounds = bucket_slices(asked, parts)
        told = {b.as_py(): t.as_py() for b, t in zip(answers.column("bucket"), answers.column("told"))}
        counts = np.empty(len(asked), np.int64)
        for b, low, high in zip(found.tolist(), bounds, bounds[1:]):
            counts[low:high] = load(told[b]).astype(np.int64)
        known, end = counts[np.searchsorted(asked, keys)], int(counts[np.searchsorted(asked, END_KEY)])
        base = math.log10(total + distinct + 1)
        logs = np.log10(known + 1.0) - base
        pieces_share = math.log10((distinct + 1) / (total + distinct + 1))
        subwords = lattice.words(words.data, words.start[where], words.end[where]) + pieces_share
        marginal = whole_or_cut(known, subwords, base)
        last = float(whole_or_cut(np.array([end]), np.array([lattice.end + pieces_share]), base)[0])
        n = words.counts()

        def summed(per_word: np.ndarray) -> np.ndarray:  # one after another, so that long texts stay exact
            return np.array([math.fsum(per_word[a:b]) for a, b in zip(words.first, words.first[1:])])

        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array([not t for t in texts.column("train").to_pylist()], pa.bool_()),
            "n_tokens": pa.array(n + 1), "train_tokens": pa.array(np.full(len(n), total)),
            "n_known": pa.array(summed((known > 0)[which].astype(float)).astype(np.int64) + (end > 0)),
            "base_score": pa.array(summed(logs[which]) + math.log10(end + 1.0) - base),
            "score": pa.array(summed(marginal[which]) + last),
        }).select([c.split()[0] for c in RESULT.split(", ")])

    docs = with_parts(docs, parts)
    asked = docs.groupBy("part").applyInArrow(_ask(parts), "bucket long, asker long, wanted binary")
    answers = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_answer, "part long, bucket long, told binary")
    return docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(apply, RESULT)
