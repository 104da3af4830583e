"""A two-layer classifier fitted by the cluster: tasks send summed gradients, rows stay where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetra.operators.sequence import cut_lineage


@dataclass(frozen=True)
class Head:
    """Weights of x -> relu(x A + a) B + b, and the loss after each step of the fit."""

    a: np.ndarray
    a0: np.ndarray
    b: np.ndarray
    b0: np.ndarray
    losses: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.a + self.a0, 0.0)
        return hidden, hidden @ self.b + self.b0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x)[1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (self.a, self.a0, self.b, self.b0)])

    def like(self, flat: np.ndarray, losses: tuple[float, ...] = ()) -> Head:
        parts, at = [], 0
        for v in (self.a, self.a0, self.b, self.b0):
            parts.append(flat[at:at + v.size].reshape(v.shape))
            at += v.size
        return Head(*parts, losses)


def start(width: int, hidden: int, classes: int, seed: int) -> Head:
    rng = np.random.default_rng(seed)
    return Head(rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden),
                rng.normal(0, np.sqrt(1 / hidden), (hidden, classes)), np.zeros(classes))


def gradient(head: Head, x: np.ndarray, y: np.ndarray, weights: np.ndarray, smoothing: float) -> tuple[np.ndarray, float, float]:
    """Summed gradient, loss and weight of some rows: class-weighted cross-entropy with smoothed labels."""
    hidden, _ = head.scores(x)
    p = head.probabilities(x)
    classes = p.shape[1]
    target = np.full(p.shape, smoothing / classes)
    target[np.arange(len(y)), y] += 1 - smoothing
    # Every class's share of a smoothed label carries the weight of that class.
    target *= weights
    loss = -(target * np.log(np.maximum(p, 1e-300))).sum()
    dz = p * target.sum(axis=1, keepdims=True) - target
    dh = (dz @ head.b.T) * (hidden > 0)
    grads = (x.T @ dh, dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0))
    return np.concatenate([g.ravel() for g in grads]), float(loss), float(weights[y].sum())


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def _sums(head: Head, weights: np.ndarray, smoothing: float):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = head.a.shape[0]
        total = np.zeros(head.flat().size + 2)
        for batch in batches:
            grad, loss, weight = gradient(head, _matrix(batch.column(1), width), np.asarray(batch.column(0)), weights, smoothing)
            total += np.r_[grad, loss, weight]
        # One row a position, so that Spark adds the tasks' sums up and the driver gets a model's worth of numbers.
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["pos", "value"])
    return sums


def inverse_weights(train: DataFrame, label: str, classes: int) -> list[float]:
    """Weight of each class: rows of the largest class to its own; 1 for a class without rows."""
    n = {r[label]: r["n"] for r in train.filter(F.col(label).between(0, classes - 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(n.values(), default=1)
    return [most / n[c] if c in n else 1.0 for c in range(classes)]


def fit_head(
    train: DataFrame, width: int, hidden: int = 256, classes: int = 2, vec: str = "vec", label: str = "label", weights: list[float] | None = None,
    smoothing: float = 0.1, rate: float = 0.02, decay: float = 1e-4, epochs: int = 50, patience: int = 5, seed: int = 42,
) -> Head:
    """Weighted cross-entropy minimised by Adam with decoupled weight decay, one step a pass over all rows.

    A class weighs `weights` (by default as `inverse_weights`), and `smoothing` of each label goes to all classes alike.
    The fit ends after `epochs` passes, or when `patience` passes in a row had no smaller loss than the best before; the
    weights of the pass with the smallest loss are the result. Rows without a label, with one outside 0 to classes - 1,
    or whose vector is not `width` finite numbers take no part; no rows give the start as it is. Fits agree up to the
    order of sums.
    """
    rows = train.select(F.col(label).cast("int").alias("label"), F.transform(vec, lambda v: v.cast("double")).alias("x"))
    rows = cut_lineage(rows.filter(F.col("label").between(0, classes - 1) & usable("x", width)))
    if weights is None:
        weights = inverse_weights(rows, "label", classes)
    w = np.asarray(weights, dtype=float)
    head = best = start(width, hidden, classes, seed)
    m = v = np.zeros(head.flat().size)
    least, idle, losses = float("inf"), 0, []
    for step in range(1, epochs + 1):
        sums = rows.mapInArrow(_sums(head, w, smoothing), "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
        total = np.zeros(head.flat().size + 2)
        for r in sums.collect():  # as many numbers as the model has
            total[r["pos"]] = r["value"]
        if total[-1] == 0:
            break
        grad, loss = total[:-2] / total[-1], total[-2] / total[-1]
        losses.append(loss)
        if loss < least:
            best, least, idle = head, loss, 0
        else:
            idle += 1
            if idle >= patience:
                break
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        move = m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        head = head.like(head.flat() * (1 - rate * decay) - rate * move)
    return best.like(best.flat(), tuple(losses))


def usable(vec: str, width: int):
    """Whether a vector has `width` finite numbers."""
    return F.coalesce((F.size(vec) == width) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def apply_head(df: DataFrame, head: Head, vec: str = "vec") -> DataFrame:
    """`df` with prob_1 (probability of class 1) and pred (the class with the highest one, the lowest of equals).

    Both are null where the vector is not `width` finite numbers.
    """
    width = head.a.shape[0]

    def judge(x: pa.Array) -> pa.Array:
        there = np.asarray(x.is_valid())
        p = head.probabilities(_matrix(x.drop_null(), width))
        prob, pred = np.zeros(len(x)), np.zeros(len(x), np.int32)
        prob[there], pred[there] = p[:, 1], p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(prob, mask=~there), pa.array(pred, mask=~there)], ["prob_1", "pred"])

    judged = F.arrow_udf(judge, "prob_1 double, pred int")
    x = F.transform(vec, lambda v: v.cast("double"))
    out = df.withColumn("_x", x).withColumn("_x", F.when(usable("_x", width), F.col("_x"))).withColumn("_p", judged("_x"))
    return out.select(*df.columns, F.col("_p.prob_1").alias("prob_1"), F.col("_p.pred").alias("pred"))
