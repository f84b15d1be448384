"""Helpers of the trained operators: bounded samples of labelled rows, and a small L-BFGS."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Characters of a class's training texts together, and of one of them, at most: what the driver holds has a bound, whatever the rows.
CLASS_CHARS = 40_000_000
TEXT_CHARS = CLASS_CHARS // 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int, balanced: bool = False, class_chars: int = CLASS_CHARS, text_chars: int = TEXT_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of at most ``per_class`` labelled documents and ``class_chars`` characters of each class, for the driver.

    Only labels for which ``fold`` holds are used, and texts of at most ``text_chars`` characters. The rows taken are
    those with the smallest hash of their id; the weights restore the classes' shares among all rows that could have
    been taken, or are equal for both if ``balanced``. Rows without an id, text or label are left out; of labels that
    repeat an id one counts; a document id that repeats is a row each time.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(fold & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = docs.select("doc_id", F.length("text").alias("chars")).filter(F.col("chars") <= text_chars)
    scratch = Scratch(docs.sparkSession)
    candidates = scratch(sizes.join(usable, "doc_id").groupBy("doc_id", "label").agg(F.max("chars").alias("chars"), F.count("*").alias("rows")), "labelled")
    order = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    totals = {r["label"]: r["rows"] for r in candidates.groupBy("label").agg(F.sum("rows").alias("rows")).collect()}
    picked = []
    for y in (0, 1):
        held = 0
        for row in candidates.filter(F.col("label") == y).orderBy(order, "doc_id").limit(per_class).collect():
            held += row["chars"] * row["rows"]
            if held > class_chars:
                break
            picked.append((row["doc_id"], y))
    scratch.clear()
    if not picked:
        return [], np.zeros(0), np.zeros(0)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(picked, T.StructType([T.StructField("doc_id", usable.schema["doc_id"].dataType), T.StructField("label", T.IntegerType())]))
    # The sample has 2 * per_class rows of an id and a label, whatever the input: it may be broadcast.
    texts = docs.select("doc_id", "text").filter(F.length("text") <= text_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    weights = np.ones(len(rows))
    for k in (0, 1):
        n = int((y == k).sum())
        if n:
            weights[y == k] = (1 if balanced else totals.get(k, 0)) / n
    return [r["text"] for r in rows], y, weights / max(weights.mean(), 1e-12)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` returns (value, gradient)."""
    value, grad = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q = grad.copy()
        kept = []
        for s, y, rho in reversed(moves):
            a = rho * (s @ q)
            q -= a * y
            kept.append(a)
        if moves:
            s, y, _ = moves[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.abs(grad).sum()))
        for (s, y, rho), a in zip(moves, reversed(kept), strict=True):
            q += (a - rho * (y @ q)) * s
        slope = float(grad @ q)
        if slope <= 0:
            q, slope, moves = grad.copy(), float(grad @ grad), []
        step = 1.0
        while True:
            new = x - step * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step *= 0.5
        s, y = new - x, new_grad - grad
        done = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        if s @ y > 1e-10:
            moves = [*moves, (s, y, 1.0 / float(s @ y))][-memory:]
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
