"""Operator 2: toxicity by a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased characters (n counts UTF-8 bytes). Each is scaled by the log ratio of its
smoothed document shares among toxic and clean training texts; a logistic regression is fitted on the scaled features.
Training uses a bounded sample of labelled rows in which both classes weigh the same; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_rows, mix, not_replaced, table
from .learning import labelled_sample, minimise, sigmoid

SIZES = (4, 6, 8)
BITS = 20
#: Training rows of each class at most; features kept at most (they bound the driver's memory while it fits); documents of the sample that a feature must be in; smoothing; L2 penalty.
PER_CLASS = 2500
FEATURES = 60_000
MIN_DOCS = 4
SMOOTHING = 1.0
PENALTY = 1.0
THRESHOLD = 0.7

_MULT, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []
BLOCK = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        n = BLOCK + 16
        up, down = np.full(n, _MULT, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        _TABLES.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))
    return _TABLES[0]


def grams(text: str | None, sizes: tuple[int, ...] = SIZES, bits: int = BITS):
    """Hashed n-grams of the text, block by block: white space counts as one blank, and the text has a blank at either end."""
    data = f" {' '.join((text or '').lower().split())} ".encode()
    powers, inverses = _tables()
    longest = max(sizes)
    for at in range(0, len(data), BLOCK):
        codes = np.frombuffer(data, np.uint8, count=min(BLOCK + longest - 1, len(data) - at), offset=at).astype(np.uint64) + np.uint64(1)
        n = len(codes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers[:n], out=sums[1:])
        for size in sizes:
            m = min(n - size + 1, BLOCK)
            if m > 0:
                yield (mix((sums[size : size + m] - sums[:m]) * inverses[:m], size) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_grams(text: str | None) -> np.ndarray:
    found = [np.unique(g) for g in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Model:
    """Feature numbers, their weights (ratio times fitted weight), and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept


def train(texts: list[str], y: np.ndarray, row_weights: np.ndarray) -> Model:
    """Fit the model; with one class only, every text gets that class's smoothed share."""
    pos, neg = float(row_weights[y == 1].sum()), float(row_weights[y == 0].sum())
    if not pos or not neg:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))))
    # The texts are read twice, so that only the chosen features of each are ever held.
    counts = np.zeros((2, 1 << BITS), dtype=np.float32)
    rows = np.zeros(2, dtype=np.float32)
    for t, k in zip(texts, y.astype(int), strict=True):
        counts[k, distinct_grams(t)] += 1
        rows[k] += 1
    ratio = np.log((counts[1] + SMOOTHING) / (rows[1] + 2 * SMOOTHING)) - np.log((counts[0] + SMOOTHING) / (rows[0] + 2 * SMOOTHING))
    strength = np.where(counts[0] + counts[1] >= MIN_DOCS, np.abs(ratio) * np.sqrt(np.maximum(counts[0] / rows[0], counts[1] / rows[1])), 0.0)
    keep = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    keep = keep[strength[keep] > 0]
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    r = ratio[keep].astype(np.float64)
    del counts, strength, ratio
    columns = []
    for t in texts:
        c = place[distinct_grams(t)]
        columns.append(c[c >= 0])
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    column = np.concatenate(columns).astype(np.int64)
    del columns, place

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        v = x[:-1] * r
        z = np.bincount(row, v[column], minlength=len(y)) + x[-1]
        p = sigmoid(z)
        value = float((row_weights * (np.logaddexp(0.0, z) - y * z)).sum() + 0.5 * PENALTY * (x[:-1] ** 2).sum())
        d = row_weights * (p - y)
        return value, np.append(np.bincount(column, d[row], minlength=len(keep)) * r + PENALTY * x[:-1], d.sum())

    x = minimise(loss, np.zeros(len(keep) + 1), steps=60)
    weights = x[:-1] * r
    return Model(keep, weights, float(x[-1]))


class _Score:
    factory = True

    def __init__(self, model: Model):
        self.model = model

    def __call__(self):
        weight = np.zeros(1 << BITS)
        weight[self.model.features] = self.model.weights
        intercept = self.model.intercept

        def score(text: str | None) -> tuple[float]:
            found = [g[weight[g] != 0] for g in grams(text)]
            hit = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            return (float(sigmoid(np.float64(weight[hit].sum() + intercept))),)

        return score


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 3, held: int = 1) -> Model:
    """A model from the labelled rows outside the held-out fold (crc32 of the id modulo ``folds`` is ``held``)."""
    return train(*labelled_sample(docs, labels, "toxic", crc_mod("doc_id", folds) != held, per_class, balanced=True))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted of every document. Null and empty texts get the score of a text without features; rows are independent; other columns are ignored, and a kept column that has the name of a result gives way to it."""
    scored = map_rows(docs, _Score(model), [T.StructField("score", T.DoubleType())], not_replaced(keep, ["predicted"]), ["text"])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
