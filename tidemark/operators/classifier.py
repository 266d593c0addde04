"""A linear model of three classes (-1, 0, 1), fitted over partitions, and its answers as expressions.

The model is multinomial: logits are linear in the features, and a penalty on all weights makes the best ones unique. Each
round of Newton's method is one pass: tasks sum gradient, curvature and loss of their rows in blocks of columns, these
few sums are added by index, and the driver solves a system of 3 (features + 1) unknowns. So the fit does not depend on
the order of rows, unlike one that follows single rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import cut

CLASSES = (-1, 0, 1)


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]  # a row for each class: bias, then a weight a feature
    loss: float
    rounds: int

    def logits(self) -> list[Column]:
        return [sum((F.lit(w) * F.col(f).cast("double") for f, w in zip(self.features, row[1:], strict=True)), F.lit(row[0])) for row in self.weights]

    def probabilities(self) -> dict[int, Column]:
        """Each class's probability; null where a feature is."""
        logits = self.logits()
        most = F.greatest(*logits)
        exps = [F.exp(z - most) for z in logits]
        total = sum(exps[1:], exps[0])
        known = F.lit(True)
        for z in logits:
            known = known & z.isNotNull()
        return {c: F.when(known, e / total) for c, e in zip(CLASSES, exps, strict=True)}

    def label(self) -> Column:
        """The likeliest class, of equal ones the least; null where a feature is."""
        low, middle, high = self.logits()
        return F.when(low.isNotNull() & middle.isNotNull() & high.isNotNull(), F.when((low >= middle) & (low >= high), -1).when(middle >= high, 0).otherwise(1))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and the curvature's upper triangle of rows (with a leading 1) of classes 0 to 2."""
    logits = x @ w.T
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -(weight * np.log(np.maximum(p[at, y], 1e-300))).sum()
    miss = p.copy()
    miss[at, y] -= 1
    gradient = ((miss * weight[:, None]).T @ x).ravel()
    d = x.shape[1]
    curvature = np.empty((len(w) * d, len(w) * d))
    for a in range(len(w)):
        for b in range(len(w)):
            scale = weight * p[:, a] * ((a == b) - p[:, b])
            curvature[a * d : (a + 1) * d, b * d : (b + 1) * d] = (x * scale[:, None]).T @ x
    return np.concatenate([[loss], gradient, curvature[np.triu_indices(len(curvature))]])


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """Rows over three times a class's rows; a class without rows has weight 0."""
    n = {r[label]: r["count"] for r in df.filter(F.col(label).isin(*CLASSES)).groupBy(label).count().collect()}  # three rows
    return {c: sum(n.values()) / (3 * n[c]) if n.get(c) else 0.0 for c in CLASSES}


def fit(df: DataFrame, features: Sequence[str], label: str, l2: float = 1e-4, weights: Mapping[int, float] | None = None, most_rounds: int = 50, tolerance: float = 1e-9) -> Model:
    """The weights with the least mean loss plus ``l2`` / 2 times their squares. Rows with a null or another label are left out.

    ``weights`` of classes, 1 by default, multiply their rows' losses. Without rows all weights are 0.
    """
    known = df.select(F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f"_{k}") for k, f in enumerate(features)])
    known = cut(known.filter(F.col("_y").isin(*CLASSES)).dropna())
    d, n = len(features) + 1, known.count()
    scale = np.array([1.0 if weights is None else float(weights.get(c, 0.0)) for c in CLASSES])
    upper = np.triu_indices(3 * d)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + 3 * d + len(upper[0]))
            for batch in batches:
                y = batch.column(0).to_numpy() + 1
                x = np.column_stack([np.ones(len(y)), *(c.to_numpy() for c in batch.columns[1:])])
                total += _sums(x, y, scale[y], w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        found = known.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy() / n  # a number for each sum
        curvature = np.zeros((3 * d, 3 * d))
        curvature[upper] = found[1 + 3 * d :]
        curvature = curvature + np.triu(curvature, 1).T + l2 * np.eye(3 * d)
        flat = w.ravel()
        return found[0] + l2 / 2 * flat @ flat, found[1 : 1 + 3 * d] + l2 * flat, curvature

    w, rounds = np.zeros((3, d)), 0
    if not n:
        return Model(tuple(features), tuple(map(tuple, w.tolist())), 0.0, 0)
    loss, gradient, curvature = at(w)
    while rounds < most_rounds and np.abs(gradient).max() > tolerance:
        step = np.linalg.solve(curvature, gradient).reshape(w.shape)
        share = 1.0
        while True:  # a full step, but where it overshoots
            new = w - share * step
            found = at(new)
            if found[0] <= loss + 1e-15 or share < 1e-4:
                break
            share /= 2
        w, (loss, gradient, curvature), rounds = new, found, rounds + 1
    return Model(tuple(features), tuple(map(tuple, w.tolist())), float(loss), rounds)
