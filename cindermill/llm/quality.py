"""Operator 4: document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own binned measures and those of its two neighbours; labels of
adjacent lines interact. Training takes a document's label for each of its lines; scoring runs forward-backward over
all lines of a text and averages the marginals of "good", weighted by line length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_rows, not_replaced, table
from .learning import labelled_sample, minimise, sigmoid

#: Training rows of each class at most; L2 penalty; score from which a document is kept.
PER_CLASS = 3000
PENALTY = 0.3
THRESHOLD = 0.3

# Bin edges of each measure of a line, and how many bins that makes.
EDGES = {
    "length": (1, 20, 40, 80, 160, 320, 640, 1280, 2560),
    "words": (1, 2, 4, 8, 16, 32, 64, 128, 512),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14),
    "upper": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "digit": (0.001, 0.01, 0.03, 0.1, 0.3),
    "symbol": (0.001, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4),
    "odd": (0.0005, 0.003, 0.01, 0.03, 0.1, 0.2, 0.4),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99),
    "top_word": (0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5),
    "same_next": (0.001, 0.02, 0.05, 0.2, 0.5),
    "short": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "full_stops": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4),
    "seen": (0.5, 1.5, 3.5),
    "ends": (0.5, 1.5),
}
_OFFSETS = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])
OWN = int(_OFFSETS[-1])
#: Own measures, those of the line before, those of the line after, no line before, no line after, always.
FEATURES = 3 * OWN + 3
_MATRIX = np.full((len(EDGES), max(map(len, EDGES.values()))), np.inf)
for _i, _e in enumerate(EDGES.values()):
    _MATRIX[_i, : len(_e)] = _e

_LETTERS_OUT = re.compile(r"[^\W\d_]+")
_PLAIN_OUT = re.compile(r"[\w\s.,;:!?'\"()\-]+")
_STOPS = re.compile(r"[.!?]")


def measures(line: str, seen: int) -> tuple:
    """The measures of a line, in the order of ``EDGES``; ``seen`` is how often it came before in the text."""
    words = line.split()
    n, k = len(line), len(words)
    if not k:
        return (0,) * 12 + (seen, 0)
    letters = n - len(_LETTERS_OUT.sub("", line))
    blanks = line.count(" ")
    digits = sum(map(line.count, "0123456789"))
    odd = len(_PLAIN_OUT.sub("", line))
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    same = sum(map(str.__eq__, lower, lower[1:]))
    upper = sum(map(str.isupper, words))
    short = sum(1 for w in words if len(w) <= 3)
    last = line.rstrip()[-1]
    return (
        n, k, (n - blanks) / k, upper / k, digits / n, max(0, n - letters - blanks - digits) / n, odd / n, len(counts) / k, max(counts.values()) / k, same / k, short / k,
        len(_STOPS.findall(line)) / k, seen, 2 if last in ".!?\"'" else 1 if last.isalnum() else 0,
    )


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of each line, length of each line). A text always has a line at least."""
    lines = (text or "").split("\n")
    seen: Counter = Counter()
    rows = []
    for line in lines:
        rows.append(measures(line, seen[line]))
        seen[line] += 1
    values = np.array(rows, dtype=np.float64)
    own = (values[:, :, None] >= _MATRIX).sum(axis=2) + _OFFSETS[:-1]
    n, m = own.shape
    out = np.empty((n, 3 * m + 1), dtype=np.int64)
    out[:, :m] = own
    out[1:, m : 2 * m] = own[:-1] + OWN
    out[0, m : 2 * m] = 3 * OWN
    out[:-1, 2 * m : 3 * m] = own[1:] + 2 * OWN
    out[-1, 2 * m : 3 * m] = 3 * OWN + 1
    out[:, -1] = 3 * OWN + 2
    return out, np.array([len(x) for x in lines], dtype=np.float64)


def marginals(unary: np.ndarray, stay: float, turn: float) -> np.ndarray:
    """P(good) of each line of one chain. ``unary``: score of good over bad; ``stay`` and ``turn``: scores of equal and unequal neighbours."""
    n = len(unary)
    u = unary.tolist()
    d = stay - turn
    hi = lambda x: x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))
    # Each message is a log ratio of good to bad: m -> log((e^m e^d + 1) / (e^m + e^d)).
    pass_on = lambda m: hi(m + d) - (max(m, d) + math.log1p(math.exp(-abs(m - d))))
    ahead, back = [0.0] * n, [0.0] * n
    for i in range(1, n):
        ahead[i] = pass_on(ahead[i - 1] + u[i - 1])
    for i in range(n - 2, -1, -1):
        back[i] = pass_on(back[i + 1] + u[i + 1])
    return sigmoid(unary + np.array(ahead) + np.array(back))


class Model:
    """Weights of the features for good over bad, and the scores of equal and unequal neighbours."""

    def __init__(self, weights: np.ndarray, stay: float, turn: float):
        self.weights, self.stay, self.turn = weights, stay, turn

    def score(self, text: str | None) -> float:
        feats, lengths = features(text)
        good = marginals(self.weights[feats].sum(axis=1), self.stay, self.turn)
        weight = lengths + (lengths.sum() == 0)
        return float(good @ weight / weight.sum())


class ChainLoss:
    """Negative weighted log-likelihood of labelled chains of lines, and its gradient; lines carry their document's label.

    Chains run side by side, the longest first, so step t has lines of the first ``active[t]`` chains only. All tables
    are laid out step by step in one flat array: their size is the number of lines.
    """

    def __init__(self, chains: list[np.ndarray], labels: np.ndarray, weights: np.ndarray):
        order = np.argsort([-len(c) for c in chains], kind="stable")
        sizes = np.array([len(chains[i]) for i in order])
        self.good, self.weight, self.count = labels[order], weights[order], len(order)
        turns = np.bincount(sizes - 1, minlength=int(sizes[0]))
        self.active = len(order) - np.concatenate([[0], np.cumsum(turns)[:-1]])
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.steps = sizes - 1
        self.chain = np.concatenate([np.arange(k) for k in self.active])
        self.flat = np.empty((len(self.chain), chains[0].shape[1]), dtype=np.int16, order="F")
        for c, i in enumerate(order):
            self.flat[self.at[: len(chains[i])] + c] = chains[i]

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        w, stay, turn = x[:-2], x[-2], x[-1]
        at, active, longest = self.at, self.active, len(self.active)
        u = np.zeros(len(self.chain))
        for column in self.flat.T:
            u += w[column]
        # Log-space forward and backward tables for [bad, good]; unary scores stand on good only.
        a = np.zeros((2, len(u)))
        b = np.zeros((2, len(u)))
        part = lambda t, k: slice(at[t], at[t] + k)
        a[1, part(0, active[0])] = u[part(0, active[0])]
        for t in range(1, longest):
            here, before = part(t, active[t]), part(t - 1, active[t])
            a[0, here] = np.logaddexp(a[0, before] + stay, a[1, before] + turn)
            a[1, here] = np.logaddexp(a[0, before] + turn, a[1, before] + stay) + u[here]
        for t in range(longest - 2, -1, -1):
            here, after = part(t, active[t + 1]), part(t + 1, active[t + 1])
            ok = b[1, after] + u[after]
            b[0, here] = np.logaddexp(b[0, after] + stay, ok + turn)
            b[1, here] = np.logaddexp(b[0, after] + turn, ok + stay)
        first = part(0, self.count)
        total = np.logaddexp(a[0, first] + b[0, first], a[1, first] + b[1, first])
        gold = self.good * np.bincount(self.chain, u, minlength=self.count) + stay * self.steps
        value = float((self.weight * (total - gold)).sum() + 0.5 * PENALTY * (x @ x))
        p = np.exp(a[1] + b[1] - total[self.chain])
        diff = self.weight[self.chain] * (p - self.good[self.chain])
        grad = np.zeros_like(x)
        for column in self.flat.T:
            grad[:-2] += np.bincount(column, diff, minlength=FEATURES)
        for t in range(1, longest):
            here, before = part(t, active[t]), part(t - 1, active[t])
            z = total[: active[t]]
            same = np.exp(a[0, before] + stay + b[0, here] - z) + np.exp(a[1, before] + stay + u[here] + b[1, here] - z)
            grad[-2] += (self.weight[: active[t]] * (same - 1.0)).sum()
            grad[-1] += (self.weight[: active[t]] * (1.0 - same)).sum()
        return value, grad + PENALTY * x


def train(texts: list[str], y: np.ndarray, row_weights: np.ndarray) -> Model:
    """Maximise the weighted likelihood of all chains, whose lines carry their document's label."""
    if not texts:
        return Model(np.zeros(FEATURES), 0.0, 0.0)
    loss = ChainLoss([features(t)[0].astype(np.int16) for t in texts], np.asarray(y, dtype=np.float64), np.asarray(row_weights, dtype=np.float64))
    x = minimise(loss, np.zeros(FEATURES + 2), steps=80)
    return Model(x[:-2], float(x[-2]), float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 5, held: int = 0) -> Model:
    """A model from the labelled rows outside the held-out fold (crc32 of the id modulo ``folds`` is ``held``)."""
    return train(*labelled_sample(docs, labels, "quality", crc_mod("doc_id", folds) != held, per_class))


class _Score:
    factory = True

    def __init__(self, model: Model):
        self.model = model

    def __call__(self):
        return lambda text: (self.model.score(text),)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted of every document. A null or empty text is one empty line and is scored as such; rows are independent; other columns are ignored, and a kept column that has the name of a result gives way to it."""
    scored = map_rows(docs, _Score(model), [T.StructField("score", T.DoubleType())], not_replaced(keep, ["predicted"]), ["text"])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold. Null and empty texts are judged as one empty line; repeated rows and null ids each by their own text; an empty table stays empty."""
    marked = map_rows(docs, _Score(model), [T.StructField("__quality", T.DoubleType())], docs.columns, ["text"])
    return marked.filter(F.col("__quality") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
