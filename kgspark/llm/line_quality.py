"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. What speaks for a label are the shape of the line (letters, digits,
symbols, capitals, repeated words and lines) and the shapes of the lines before and after it; neighbouring
labels are tied by a transition weight. Forward-backward gives each line's probability of being good, and
their mean, weighted by line length, the quality of the document, which a logistic curve fitted on the
training documents turns into a score.

The field is fitted on a bounded sample of labelled documents (SAMPLE_DOCUMENTS), in which every line has its
document's label. Of a document with more than SAMPLE_LINES lines, that many neighbouring ones from a place
set by its hash are learnt from, so all parts of long documents are seen; lines of more than SAMPLE_BYTES together
are no sample. Scoring uses whole texts and needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm import arrays
from kgspark.llm.common import hash_sample

SAMPLE_DOCUMENTS = 4_000
SAMPLE_LINES = 200
SAMPLE_BYTES = 64 << 10
RUN_BYTES = 2 << 20
STEPS = 250
PENALTY = 1e-3

_UPPER, _LETTER, _DIGIT, _SPACE, _SOFT, _BAR, _SYMBOL = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x41:0x5B] = _UPPER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = _SOFT
_CLASS[ord("|")] = _BAR
SHAPES = 13


class Lines:
    """Non-blank lines of several texts: shapes, lengths, and first line of each text."""

    def __init__(self, column: pa.Array):
        words = arrays.split_words(*arrays.text_bytes(column), lower=True)
        flat, offsets = arrays.text_bytes(column)
        data, edges = flat[offsets[0]:offsets[-1]], offsets - offsets[0]
        mark = np.zeros(len(data) + 1, bool)
        mark[np.flatnonzero(data == 0x0A) + 1] = True
        mark[edges] = True
        mark[-1] = False
        start = np.flatnonzero(mark)
        end = np.append(start[1:], len(data))
        kind = _CLASS[data]
        counts = []
        for k in range(7):
            upto = np.zeros(len(data) + 1, np.int32)
            np.cumsum(kind == k, dtype=np.int32, out=upto[1:])
            counts.append((upto[end] - upto[start]).astype(np.float64))
        solid = (end - start) > counts[_SPACE]
        start, end, counts = start[solid], end[solid], [c[solid] for c in counts]
        self.length = end - start - counts[_SPACE]
        self.first = np.searchsorted(start, edges)
        doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        bounds = np.searchsorted(words.start, np.append(start, len(data)))
        n_words = np.maximum(np.diff(bounds), 1).astype(np.float64)
        same = np.zeros(len(words.hash) + 1)
        if len(words.hash) > 1:
            again = words.hash[1:] == words.hash[:-1]
            same[2:] = np.cumsum(again)
        inner = np.minimum(bounds[:-1] + 1, bounds[1:])  # a line's first word has no word before it
        repeated = same[bounds[1:]] - same[inner]
        line, _ = arrays.distinct(data, start, end)
        _, which, copies = np.unique(line * len(column) + doc, return_inverse=True, return_counts=True)
        letters = counts[_UPPER] + counts[_LETTER]
        size = np.maximum(self.length, 1)
        self.shape = np.stack([
            np.log1p(self.length) / 10, counts[_UPPER] / np.maximum(letters, 1), letters / size, counts[_DIGIT] / size,
            counts[_SOFT] / size, counts[_BAR] / size, counts[_SYMBOL] / size, np.minimum(counts[_SYMBOL] / n_words, 4) / 4,
            np.minimum(counts[_BAR] / n_words, 2) / 2, repeated / n_words, np.minimum(size / n_words, 40) / 40,
            (copies[which] > 1).astype(float), np.minimum(n_words, 50) / 50,
        ], axis=1).reshape(-1, SHAPES)

    def features(self) -> np.ndarray:
        """A line's shape, those of its neighbours (zeros beyond the ends), whether it is at an end, and 1."""
        n = len(self.shape)
        inside_first, inside_last = np.ones(n, bool), np.ones(n, bool)
        has = np.flatnonzero(np.diff(self.first))
        inside_first[self.first[has]] = False
        inside_last[self.first[has + 1] - 1] = False
        before = np.zeros_like(self.shape)
        before[1:] = self.shape[:-1] * inside_first[1:, None]
        after = np.zeros_like(self.shape)
        after[:-1] = self.shape[1:] * inside_last[:-1, None]
        return np.hstack([self.shape, before, after, ~inside_first[:, None], ~inside_last[:, None], np.ones((n, 1))])


def forward_backward(lean: np.ndarray, tie: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for chains lean[first[i]:first[i + 1]], and expected pair counts (2 x 2).

    ``lean``: log weight of label 1 over 0 for each line; ``tie[a, b]``: log weight of label b after a.
    All chains take each step together; messages are kept as log odds of the two labels.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")  # chains that reach step t
    odds = np.array(lean, np.float64)  # what the lines up to here say, then all lines

    def passed(x: np.ndarray, m: np.ndarray) -> np.ndarray:  # log odds of the next label
        return np.logaddexp(m[0, 1], m[1, 1] + x) - np.logaddexp(m[0, 0], m[1, 0] + x)

    for t in range(1, len(live)):
        at = begin[:live[t]] + t
        odds[at] += passed(odds[at - 1], tie)
    back = np.zeros(len(lean))  # what the lines after say
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 1, 0, -1):
        at = begin[:live[t]] + t
        own = lean[at] + back[at]
        back[at - 1] = np.logaddexp(tie[1, 0], tie[1, 1] + own) - np.logaddexp(tie[0, 0], tie[0, 1] + own)
        joint = np.stack([np.zeros(len(at)) + tie[0, 0], tie[0, 1] + own, tie[1, 0] + odds[at - 1], tie[1, 1] + odds[at - 1] + own])
        joint = np.exp(joint - joint.max(0))
        pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
    return 1 / (1 + np.exp(-np.clip(odds + back, -500, 500))), pairs


def quality(marginal: np.ndarray, lines: Lines) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; NaN for texts without lines."""
    weight = np.append(0, np.cumsum(lines.length))
    value = np.append(0, np.cumsum(lines.length * marginal))
    with np.errstate(invalid="ignore"):
        return (value[lines.first[1:]] - value[lines.first[:-1]]) / (weight[lines.first[1:]] - weight[lines.first[:-1]])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(lines: Lines, labels: np.ndarray) -> dict:
    """Weights of the field and of the score's curve. Without both labels the score is the share of label 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    counted = np.flatnonzero(np.diff(lines.first))
    if not len(counted) or len(np.unique(labels[counted])) < 2:
        return {"share": share}
    x = lines.features()
    centre, spread = x.mean(0), x.std(0)
    centre[-1], spread = 0.0, np.where(spread > 1e-9, spread, 1.0)
    spread[-1] = 1.0
    z = (x - centre) / spread
    y = np.repeat(labels, np.diff(lines.first)).astype(np.float64)
    weights, tie = np.zeros(z.shape[1]), np.zeros((2, 2))
    same = float((np.maximum(np.diff(lines.first) - 1, 0) * labels).sum())
    steps = float(np.maximum(np.diff(lines.first) - 1, 0).sum())
    seen = np.array([[steps - same, 0.0], [0.0, same]])
    moment, power = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, STEPS + 1):  # gradient ascent with a step size for each weight
        marginal, expected = forward_backward(z @ weights, tie, lines.first)
        slope = np.append(z.T @ (y - marginal) / len(y) - PENALTY * weights, ((seen - expected) / len(y) - PENALTY * tie).ravel())
        moment, power = 0.9 * moment + 0.1 * slope, 0.99 * power + 0.01 * slope**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        weights, tie = weights + move[:-4], tie + move[-4:].reshape(2, 2)
    marginal, _ = forward_backward(z @ weights, tie, lines.first)
    lean, target = _logit(quality(marginal, lines)[counted]), labels[counted].astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, with a little penalty so that clean splits stay finite
        p = 1 / (1 + np.exp(-np.clip(a * lean + b, -500, 500)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((target - p) * lean).sum() - 0.1 * a, (target - p).sum() - 0.1 * b])
        hess = np.array([[(w * lean * lean).sum() + 0.1, (w * lean).sum()], [(w * lean).sum(), w.sum() + 0.1]])
        change = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a + change[0], b + change[1]
    return {
        "share": share, "weights": (weights / spread).tolist(), "bias": float(-(centre / spread) @ weights), "tie": tie.tolist(),
        "slope": float(a), "shift": float(b),
    }


def score_lines(lines: Lines, model: dict) -> np.ndarray:
    if "weights" not in model:
        return np.full(len(lines.first) - 1, model["share"])
    lean = lines.features() @ np.array(model["weights"]) + model["bias"]
    marginal, _ = forward_backward(lean, np.array(model["tie"]), lines.first)
    found = quality(marginal, lines)
    score = 1 / (1 + np.exp(-np.clip(model["slope"] * _logit(found) + model["shift"], -500, 500)))
    return np.where(np.isnan(found), model["share"], score)


def train(df: DataFrame, labels: DataFrame, use: Column) -> dict:
    """Fits the field on documents of ``df`` labelled 0 or 1 in ``labels`` (doc_id, quality) where ``use`` holds.

    The sample is the SAMPLE_DOCUMENTS labelled ids with the smallest hash; rows with other or NULL labels
    or ids take no part, and of several labels of one document the least counts. One task fits, so the
    driver sees weights only.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & use)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    sample = hash_sample(known, "doc_id", SAMPLE_DOCUMENTS)
    # The sample is bounded, so it can go to every task of the scan.
    rows = df.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.withColumn("_l", F.split("text", "\n")).withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("_l") - SAMPLE_LINES, F.lit(0)) + 1))
    limited = F.array_join(F.slice("_l", (F.col("_at") + 1).cast("int"), SAMPLE_LINES), "\n")
    rows = rows.select("doc_id", limited.alias("text"), "_label").where(F.octet_length("text") <= SAMPLE_BYTES).repartition(1).sortWithinPartitions("doc_id", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        texts = pa.chunked_array([b.column(1) for b in held], pa.string()).combine_chunks() if held else pa.array([], pa.string())
        labels = np.concatenate([b.column(2).to_numpy() for b in held]) if held else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(Lines(texts), labels))])], ["model"])

    found = rows.mapInArrow(arrays.giving_back(learn), "model string").first()  # none where nothing is labelled
    return json.loads(found[0]) if found else {"share": 0.5}


def score_documents(df: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``df`` with column ``name`` (0 to 1, higher for label 1) after its own; an own column of that name is replaced.

    Texts without a line (NULL, empty, blank) get the training share of label 1. Rows are scored one by
    one, so repeated rows get equal scores; an empty table gives no rows.
    """
    df = df.drop(name)
    place = df.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            found = [score_lines(Lines(column.slice(a, b - a)), model) for a, b in arrays.row_runs(column, RUN_BYTES)]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(arrays.giving_back(score), f"{fields}, `{name}` double")
