"""Quality classifier: Naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of word n-grams and of n-grams of word shapes, hashed to ``BITS`` bits.
Each is scaled by its class log-count ratio, rows are scaled to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent (Hsieh et al., 2008). Margins of held-back thirds of the
training sample calibrate a logistic curve, so a score is the likelihood of label 1 at the label
table's own class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import bounded_batches
from .wordgrid import Words, grams, mix, words

BITS = 20

# classes of bytes in a word's shape
_CLASS = np.full(256, 1 << 5, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = 1 << 0
_CLASS[ord("A") : ord("Z") + 1] = 1 << 1
_CLASS[ord("0") : ord("9") + 1] = 1 << 2
_CLASS[[ord(x) for x in ".,;:'\"()-"]] = 1 << 3
_CLASS[[ord(x) for x in "!?"]] = 1 << 4
_CLASS[[ord(x) for x in "#$%&*|<>{}[]/\\=_~^@+`"]] = 1 << 6


def _shapes(chunk: Words) -> np.ndarray:
    """Classes of bytes in each word, its last byte where that is a mark, a class of its length."""
    if not len(chunk.starts):
        return np.zeros(0, np.uint64)
    kinds = _CLASS[chunk.data]
    kinds[chunk.data <= 32] = 0
    mask = np.bitwise_or.reduceat(kinds, chunk.starts).astype(np.uint64)
    last = chunk.data[chunk.ends - 1]
    mark = np.where(_CLASS[last] & 0b1011000, last, 0).astype(np.uint64)
    size = np.minimum(chunk.ends - chunk.starts, 40).astype(np.uint64) // np.uint64(20)
    return mask | (mark << np.uint64(8)) | (size << np.uint64(16))


def features(chunk: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: (feature, text), sorted by text."""
    owner = chunk.owner()
    shape, h = _shapes(chunk), chunk.hash
    parts = [(mix(h, 1), owner)]
    two, at = grams(chunk, 2)
    parts.append((mix(two, 2), np.repeat(np.arange(chunk.texts), np.diff(at))))
    parts.append((mix(shape, 3), owner))
    if len(h) > 1:
        beside = owner[1:] == owner[:-1]
        pair = mix(shape[:-1] * np.uint64(31) + shape[1:], 4)
        parts.append((pair[beside], owner[1:][beside]))
        again = beside & (h[1:] == h[:-1])
        parts.append((np.full(int(again.sum()), mix(np.uint64([5]), 5)[0]), owner[1:][again]))
        # how much of the text repeats pairs of words, in tenths
        whole = np.diff(at)
        order = np.lexsort((two, np.repeat(np.arange(chunk.texts), whole)))
        held, who = two[order], np.repeat(np.arange(chunk.texts), whole)[order]
        new = np.concatenate(([True], (held[1:] != held[:-1]) | (who[1:] != who[:-1])))
        distinct = np.bincount(who[new], minlength=chunk.texts)
        tenth = 10 * (whole - distinct) // np.maximum(whole, 1)
        parts.append((mix(tenth.astype(np.uint64), 6), np.arange(chunk.texts)))
    feature = np.concatenate([p[0] for p in parts]) & np.uint64((1 << BITS) - 1)
    text = np.concatenate([p[1] for p in parts]).astype(np.uint64)
    both = np.unique((text << np.uint64(BITS)) | feature)
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), (both >> np.uint64(BITS)).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); weight: float32 of 2**BITS."""

    weight: np.ndarray
    scale: np.ndarray  # squared class log-count ratios, for a row's length
    bias: float
    slope: float
    shift: float

    def scores(self, chunk: Words) -> np.ndarray:
        feature, text = features(chunk)
        n = chunk.texts
        margin = np.bincount(text, self.weight[feature], n) / np.sqrt(np.maximum(np.bincount(text, self.scale[feature], n), 1e-12))
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -50, 50)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label)][x] += 1
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    seen = (counts[0] + counts[1]) > 2 * smooth + 1  # a feature of one row says nothing of others
    return np.where(seen, np.log(p / q), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear L1-loss support vectors; y is -1 or 1, cost bounds each row's dual variable."""
    weight, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                weight[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight, bias


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a little ridge."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * weight) @ margin + 1e-2 * a, ((p - y) * weight).sum() + 1e-2 * b])
        s = p * (1 - p) * weight
        h = np.array([[s @ margin**2 + 1e-2, s @ margin], [s @ margin, s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int], counts: dict[int, int], cost: float = 1.0, epochs: int = 10, seed: int = 7) -> Model:
    """Fit on feature sets; counts: class counts of the whole label table, for calibration.

    One class alone, or no rows, gives a model with a constant score: that class's share.
    """
    total = max(1, sum(counts.values()))
    share = (counts.get(1, 0) + 1) / (total + 2)
    flat = Model(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        return flat
    size = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], float)

    def train(at: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        ratio = log_count_ratios([rows[i] for i in at], y[at])
        values = [(v := ratio[rows[i]]) / max(1e-6, float(np.sqrt(v @ v))) for i in at]
        balance = np.where(y[at] > 0, len(at) / 2 / max(1, (y[at] > 0).sum()), len(at) / 2 / max(1, (y[at] == 0).sum()))
        w, b = dual_coordinate_descent([rows[i] for i in at], values, np.where(y[at] > 0, 1.0, -1.0), cost * balance, epochs, seed)
        return w, b, ratio

    fold = np.random.default_rng(seed).permutation(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside])) < 2:
            continue
        w, b, ratio = train(inside)
        for i in np.flatnonzero(fold == k):
            v = ratio[rows[i]]
            margin[i] = w[rows[i]] @ v / max(1e-6, float(np.sqrt(v @ v))) + b
    # rows of the sample stand for the table's class shares
    weigh = np.where(y > 0, counts.get(1, 1) / size[1], counts.get(0, 1) / size[0])
    slope, shift = _logistic(margin, y, weigh / weigh.mean())
    w, b, ratio = train(np.arange(len(rows)))
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(b), slope, shift)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = 1500, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``each`` labelled rows per class that are not held out.

    The driver receives the sample's hashed features only, never texts. Of several labels of one key the
    largest holds; rows that repeat a key are all learned from. Null labels, keys without a row and rows
    without a label don't count; a null text counts as empty, a long one is read whole. Without labels of
    both classes the model is constant. Other columns don't matter.
    """
    bounded_batches(docs.sparkSession)
    chosen, counts = labelled.sample(labels, label, each, key)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words(batch.column(2)):
                feature, owner = features(chunk)
                cut = np.searchsorted(owner, np.arange(1, chunk.texts))
                part = slice(chunk.first, chunk.first + chunk.texts)
                got = [x.astype("<i4").tobytes() for x in np.split(feature, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(got, pa.binary())], names=["k", "y", "f"])

    kept = docs.select(F.col(key), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), key).select(F.col(key).cast("string").alias("k"), "_y", "_t")
    found = sorted((r[0], r[1], bytes(r[2])) for r in kept.mapInArrow(hashed, "k string, y int, f binary").toLocalIterator())
    return fit([np.frombuffer(f, "<i4") for _, _, f in found], [y for _, y, _ in found], counts)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row's whole text, however long; a null text counts as empty.

    Repeated rows score alike. An empty text scores by the bias alone. No rows give no rows; other columns
    don't matter.
    """
    return labelled.with_scores(docs.select(F.col(key), F.col(text).cast("string").alias("_text")), model, text="_text").select(key, "score")
