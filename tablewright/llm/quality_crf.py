"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of character classes,
word shape and repetition, its own and its neighbours'; the chain's transition
weights let the lines around decide with it. A document's label stands for each
of its lines in training. Scores are the forward-backward marginals of "good",
weighted by line length, put on a probability scale by a one-dimensional
logistic fit over the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import flat_bytes, mixed, slices

#: At most so many labelled documents are learned from: those with the smallest hash of doc_id.
TRAIN_ROWS = 3000
FOLDS, THRESHOLD, GRAM = 5, 0.3, 5
#: Bytes of text whose features are made at once; each takes about a hundred bytes of arrays.
SLICE = 2 << 20
STEPS, RATE, PENALTY = 150, 0.1, 1e-3

# Byte classes: 0 white, 1 upper, 2 lower, 3 digit, 4 mark-up sign, 5 other sign, 6 start of a longer character, 7 rest of it.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "#*$%&|<>!@^~_=\\{}[]"]] = 4
_CLASS[128:192], _CLASS[192:] = 7, 6

N_FEATURES = 15
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of ``flags`` within [start, end) of each line."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeated(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the value has occurred earlier in its group; groups ascend."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])  # lexsort is stable: the first one is not marked
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, each line's weight, and each text's first line (one more at the end)."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # A text has one line more than it has breaks.
    per_doc = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(n_docs), per_doc)
    ends = np.empty(len(doc), dtype=np.int64)
    ends[first[1:] - 1] = offsets[1:]
    inner = np.ones(len(doc), dtype=bool)
    inner[first[1:] - 1] = False
    ends[inner] = breaks
    starts = np.empty(len(doc), dtype=np.int64)
    starts[first[:-1]] = offsets[:-1]
    outer = np.ones(len(doc), dtype=bool)
    outer[first[:-1]] = False
    starts[outer] = breaks + 1

    kind = _CLASS[data]
    n = _sums(kind != 7, starts, ends).astype(float)
    solid = kind != 0
    at_start = solid.copy()
    at_start[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    at_start[edges] = solid[edges]
    at_end = solid.copy()
    at_end[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    at_end[last] = solid[last]
    words = _sums(at_start, starts, ends).astype(float)
    n1, w1 = np.maximum(n, 1), np.maximum(words, 1)
    letters = np.maximum(_sums((kind == 1) | (kind == 2) | (kind == 6), starts, ends), 1)
    word_from, word_to = np.flatnonzero(at_start), np.flatnonzero(at_end) + 1
    # Words as hashes: sums of mixed (byte, position in word) terms.
    if len(word_from):
        length = word_to - word_from
        index = np.arange(len(data))
        index[word_from[0] :] -= np.repeat(word_from, np.diff(np.concatenate([word_from, [len(data)]])))
        terms = mixed(data.astype(np.uint64) | (index.astype(np.uint64) << np.uint64(8)))
        terms[~solid] = 0
        code = mixed(np.add.reduceat(terms, word_from))
        word_doc = np.searchsorted(offsets, word_from, side="right") - 1
        seen = _repeated(word_doc, code)
        twice = np.zeros(len(code), dtype=bool)
        twice[1:] = (code[1:] == code[:-1]) & (word_doc[1:] == word_doc[:-1])
        gram = code.copy()
        with np.errstate(over="ignore"):
            for k in range(1, min(GRAM, len(code))):
                gram[: len(code) - k] = gram[: len(code) - k] * _BASE + code[k:]
        whole = np.zeros(len(code), dtype=bool)
        if len(code) >= GRAM:
            whole[: len(code) - GRAM + 1] = word_doc[: len(code) - GRAM + 1] == word_doc[GRAM - 1 :]
        again = np.zeros(len(code), dtype=bool)
        again[whole] = _repeated(word_doc[whole], gram[whole])
        word_line = np.searchsorted(starts, word_from, side="right") - 1
        # Empty lines share their start with the next line; the last line that starts there has the word.
        count = lambda x: np.bincount(word_line, weights=x, minlength=len(starts))
        seen_n, again_n, long_n, short_n, twice_n = (count(x) for x in (seen, again, length > 14, length <= 3, twice))
        line_code = np.zeros(len(starts), dtype=np.uint64)
        position = np.arange(len(code)) - np.searchsorted(word_from, starts)[word_line]
        np.add.at(line_code, word_line, mixed(code + position.astype(np.uint64) * _BASE))
    else:
        seen_n = again_n = long_n = short_n = twice_n = np.zeros(len(starts))
        line_code = np.zeros(len(starts), dtype=np.uint64)
    line_again = _repeated(doc, line_code) & (words > 0)
    features = np.stack(
        [
            np.log1p(n) / 5,
            np.log1p(words) / 4,
            n / w1 / 10,
            _sums(kind == 1, starts, ends) / letters,
            _sums(kind == 3, starts, ends) / n1 * 4,
            _sums(kind == 4, starts, ends) / n1 * 4,
            _sums(kind == 5, starts, ends) / n1 * 4,
            _sums(at_end & (kind == 4), starts, ends) / w1,
            seen_n / w1,
            again_n / w1,
            long_n / w1 * 2,
            short_n / w1,
            twice_n / w1 * 4,
            line_again.astype(float),
            (words == 0).astype(float),
        ],
        axis=1,
    )
    return features, n + 1, first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its text, and a constant."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([features, before, after, np.ones((len(features), 1))], axis=1)


def _steps(first: np.ndarray) -> tuple[np.ndarray, int]:
    """Texts by falling line count, and the largest count."""
    counts = np.diff(first)
    return np.argsort(-counts, kind="stable"), int(counts.max(initial=0))


def forward_backward(emission: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good per line, expected transitions (2 x 2), and the log partition per text.

    ``emission`` is the score of good against bad, ``change[i, j]`` that of going from i to j.
    All texts move together, line by line; a text takes part as long as it has lines.
    """
    order, longest = _steps(first)
    start, counts = first[:-1][order], np.diff(first)[order]
    n = len(emission)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), emission], axis=1)
    lse = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    alpha[start] = score[start]
    for t in range(1, longest):
        rows = start[: np.searchsorted(-counts, -t, side="left")] + t
        step = alpha[rows - 1][:, :, None] + change[None]
        alpha[rows] = np.logaddexp(step[:, 0], step[:, 1]) + score[rows]
    for t in range(longest - 2, -1, -1):
        rows = start[: np.searchsorted(-counts, -(t + 1), side="left")] + t
        beta[rows] = lse(change[None] + (score[rows + 1] + beta[rows + 1])[:, None, :])
    last = first[1:] - 1
    log_z = lse(alpha[last])
    line_z = np.repeat(log_z, np.diff(first))
    good = np.exp(alpha[:, 1] + beta[:, 1] - line_z)
    inner = np.ones(n, dtype=bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at][:, :, None] + change[None] + (score[at + 1] + beta[at + 1])[:, None, :] - line_z[at][:, None, None])
    return good, pair.sum(axis=0), log_z


@dataclass
class Model:
    weights: np.ndarray
    change: np.ndarray
    slope: float
    offset: float

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, weight, first = line_features(data, offsets)
        return self.from_lines(features, weight, first)

    def from_lines(self, features: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean marginal of good."""
        if len(first) < 2:
            return np.zeros(0)
        good, _, _ = forward_backward(with_neighbours(features, first) @ self.weights, self.change, first)
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(data, offsets) + self.offset)))


def fit(features: np.ndarray, weight: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum likelihood with a small penalty, by Adam; every line has its document's label."""
    x = with_neighbours(features, first)
    y = np.repeat(labels, np.diff(first)).astype(float)
    counts = np.diff(first)
    told = x.T @ y
    moves = np.zeros((2, 2))
    for k in (0, 1):
        moves[k, k] = (counts[labels == k] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pairs, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        gradient = np.concatenate([x.T @ good - told, (pairs - moves).ravel()]) / len(y) + PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    raw = model.from_lines(features, weight, first)
    # Newton steps of a logistic fit of label on the raw score; the small ridge keeps separable samples finite.
    a, z = np.array([1.0, 0.0]), np.stack([raw, np.ones_like(raw)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ a)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        a -= np.linalg.solve(h, z.T @ (p - labels) + 0.1 * (a - np.array([1.0, 0.0])))
    model.slope, model.offset = float(max(a[0], 0.0)), float(a[1])
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_t", SLICE):
        features, weight, first = line_features(*flat_bytes(batch.column(1)))
        cut = lambda a: [a[s:e].astype("<f8").tobytes() for s, e in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut(features), pa.binary()), pa.array(cut(weight), pa.binary())], ["_row", "features", "weight"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents outside fold 0.

    Only ``text`` and ``labels.quality`` are used. Without labels of both kinds
    every score is the share of good labels seen (0.5 if none).
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("_t")).join(F.broadcast(chosen), "doc_id")
    made = sample.select(F.struct("doc_id", "quality").alias("_row"), "_t").mapInArrow(
        _feature_rows, f"_row struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},quality:{labels.schema['quality'].dataType.simpleString()}>, features binary, weight binary"
    )
    found = sorted(((r._row.doc_id, int(r._row.quality), bytes(r.features), bytes(r.weight)) for r in made.collect()), key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in found])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    weight = [np.frombuffer(r[3], "<f8") for r in found]
    features = np.concatenate([np.frombuffer(r[2], "<f8").reshape(-1, N_FEATURES) for r in found])
    first = np.concatenate([[0], np.cumsum([len(w) for w in weight])])
    return fit(features, np.concatenate(weight), first, y)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", SLICE):
            p = model.score(*flat_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text is one empty line and is scored
    like any other. A null doc_id is never held out. Rows that repeat are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("_t")).mapInArrow(_scorer(model), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _filter(model: Model, threshold: float, at: int):
    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            keep = model.score(*flat_bytes(batch.column(at))) >= threshold
            yield batch.filter(pa.array(keep))

    return good


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they were."""
    return docs.mapInArrow(_filter(model, threshold, docs.columns.index("text")), docs.schema)
