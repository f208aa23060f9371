"""Quality classifier: a naive Bayes support vector machine over n-gram indicators.

Features are indicators of n-grams, hashed into a table of fixed size: byte trigrams, and
trigrams of word shapes (lower, title or upper case, digits, symbols, equal to the word before).
Their class counts over all labelled rows give log-count ratios (naive Bayes); the indicators,
scaled by them and brought to unit length, train a linear model with hinge loss by dual
coordinate descent.  A logistic curve over held-back margins turns margins into scores.

Spark counts (pre-aggregated in each task, one row a feature and task) and scores; the fit runs in
one task on at most FIT_ROWS labelled rows, chosen by hash: that sample is bounded by this parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import fits_broadcast, slices, stored, text_col, utf8

#: Size of the feature table (a power of 2), labelled rows for the fit, smoothing of counts, weight of the loss.
TABLE_BITS, FIT_ROWS, SMOOTHING, LOSS, EPOCHS = 17, 8_000, 1.0, 1.0, 12
_SHAPES = np.zeros(256, np.uint8)  # of a word's first and last byte: 1 lower, 2 upper, 3 digit, 4 symbol, 5 beyond ASCII
_SHAPES[97:123], _SHAPES[65:91], _SHAPES[48:58], _SHAPES[128:] = 1, 2, 3, 5
_SHAPES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4


def features(text: bytes, bits: int = TABLE_BITS, seen: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text: numbers below 2**bits, in no order.  seen: scratch space of 2**bits ints."""
    raw = np.frombuffer(text, np.uint8)
    codes = []
    if len(raw) >= 3:
        tri = (raw[:-2].astype(np.uint32) << 16) | (raw[1:-1].astype(np.uint32) << 8) | raw[2:]
        codes.append((tri * np.uint32(2654435761)) >> np.uint32(32 - bits))
    words = text.split()
    if words:
        first, last = (_SHAPES[np.fromiter([w[i] for w in words], np.uint8, len(words))].astype(np.uint32) for i in (0, -1))
        second = _SHAPES[np.fromiter([w[1] if len(w) > 1 else 0 for w in words], np.uint8, len(words))].astype(np.uint32)
        again = np.fromiter([0, *(a == b for a, b in zip(words, words[1:], strict=False))], np.uint32, len(words))
        shape = ((first * 6 + second) * 6 + last) * 2 + again + 1
        for n in (1, 2, 3):
            if len(shape) >= n:
                code = np.full(len(shape) - n + 1, n, np.uint32)
                for k in range(n):
                    code = code * np.uint32(433) + shape[k : len(shape) - n + 1 + k]
                codes.append((code * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)) >> np.uint32(32 - bits))
    if not codes:
        return np.zeros(0, np.int64)
    code = np.concatenate(codes).astype(np.int64)
    if seen is None:
        return np.unique(code)
    at = np.arange(len(code))
    seen[code] = at  # the last place of each code is the one that counts
    return code[seen[code] == at]


@dataclass
class Model:
    """margin = sum of weights of a text's features / length + bias; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray = field(repr=False)
    squares: np.ndarray = field(repr=False)
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[found].sum())) if len(found) else 0.0
        return (float(self.weights[found].sum()) / length if length else 0.0) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, loss: float, epochs: int, seed: int = 1) -> np.ndarray:
    """Dual coordinate descent for the linear model with hinge loss: weights of size + 1 (the last is the bias).

    rows, values: each row's feature numbers and values, the bias among them; y: -1 or 1.
    """
    w = np.zeros(size + 1)
    alpha, square = np.zeros(len(rows)), np.array([float((v * v).sum()) for v in values])
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * loss  # classes weigh alike
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), weight[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(labelled: list[tuple[np.ndarray, int]], ratios: np.ndarray, loss: float = LOSS, epochs: int = EPOCHS) -> Model:
    """Fits on four fifths, calibrates on the rest.  Without both classes every text scores 1."""
    size = len(ratios)
    y = np.array([1 if q else -1 for _, q in labelled])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), np.ones(size), 0.0, 1.0, 30.0)
    rows, values = [], []
    for found, _ in labelled:
        v = ratios[found]
        length = float(np.sqrt((v * v).sum()))
        rows.append(np.append(found, size).astype(np.int32))
        values.append(np.append(v / length if length else v, 1.0).astype(np.float32))
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    w = descend([rows[i] for i in train], [values[i] for i in train], y[train], size, loss, epochs)
    back = np.flatnonzero(held) if len({*y[held].tolist()}) == 2 else train
    margins = np.array([float(w[rows[i]] @ values[i]) for i in back])
    slope, shift = _logistic(margins, (y[back] > 0).astype(float))
    return Model(w[:size] * ratios, ratios * ratios, float(w[size]), slope, shift)


def _logistic(m: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Newton steps for the slope and shift of a logistic curve, lightly regularised; targets drawn in from 0 and 1."""
    n1, n0 = target.sum(), len(target) - target.sum()
    t = np.where(target > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones_like(m)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * b * [1, 0])
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a feature and its documents of either class, summed over the task; feature -1 counts the documents."""
    total, seen = np.zeros((2, 2**bits), np.int64), np.zeros(2**bits, np.int64)
    rows = [0, 0]
    for batch in batches:
        for part in slices(batch):
            for text, label in zip(utf8(part.column("text")), part.column("label").to_pylist(), strict=True):
                total[label][features(text, bits, seen)] += 1
                rows[label] += 1
    at = np.flatnonzero(total.any(axis=0))
    numbers = [np.append(at, -1), *(np.append(total[c][at], rows[c]) for c in (0, 1))]
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in numbers], names=["feature", "zeros", "ones"])


def _as_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [zlib.compress(features(t, bits).astype(np.int32).tobytes(), 1) for t in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, bits: int = TABLE_BITS) -> Model:
    """labels: (doc_id, label) with 0 or 1; other labels, rows without a document, and doc_ids that have both labels are passed over."""
    spark = docs.sparkSession
    given = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
    usable = given.agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("other")).where("label = other").drop("other")
    known = stored(usable, "labels")
    small = fits_broadcast(known.count(), 16)
    rows = docs.select("doc_id", text_col().alias("text")).join(F.broadcast(known) if small else known, "doc_id")
    per_task = rows.select("text", "label").mapInArrow(lambda it: _counts(it, bits), "feature long, zeros long, ones long")
    # at most 2**bits + 1 rows, however large the corpus
    total = per_task.groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    counts = np.zeros((2, 2**bits))
    at = total["feature"] >= 0
    counts[:, total["feature"][at].to_numpy()] = total.loc[at, ["zeros", "ones"]].to_numpy().T
    shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    ratios = np.log(shares[1] / shares[0])

    sample = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(fit_rows)
    chosen = docs.select("doc_id", text_col().alias("text")).join(F.broadcast(sample), "doc_id").mapInArrow(lambda it: _as_rows(it, bits), "doc_id long, label int, features binary")

    def fit_one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(at=frame["features"].map(zlib.crc32)).sort_values(["at", "doc_id"])
        model = fit([(np.frombuffer(zlib.decompress(f), np.int32), q) for f, q in zip(frame["features"], frame["label"], strict=True)], ratios)
        return pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    fitted = chosen.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit_one, "weights binary, bias double, slope double, shift double").collect()
    if not fitted:
        return fit([], ratios)
    r = fitted[0]
    return Model(np.frombuffer(r["weights"], "<f4").astype(np.float64), ratios * ratios, r["bias"], r["slope"], r["shift"])


def score(docs: DataFrame, model: Model, rest: Column | None = None) -> DataFrame:
    """doc_id, score (0 to 1): one row for each row of docs.  Empty and null texts get the bias's score.

    rest: something else of each row to carry along, as a column of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen, bits = np.zeros(len(m.weights), np.int64), len(m.weights).bit_length() - 1
        for batch in batches:
            for part in slices(batch):
                margins = np.array([m.margin(features(t, bits, seen)) for t in utf8(part.column("text"))])
                yield part.drop_columns(["text"]).append_column("score", pa.array(m.score(margins)))

    rows = docs.select("doc_id", text_col().alias("text"), *([] if rest is None else [rest.alias("rest")]))
    return rows.mapInArrow(run, rows.drop("text").schema.add("score", "double"))
