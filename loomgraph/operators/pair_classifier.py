"""A trained classifier of concept pairs: multinomial logistic regression by Newton steps over sums of partitions.

Features come from the pair itself (score, common tokens, lengths, groups), so a pair is classified by column expressions, and the same model serves as a
batched classifier behind the cache of answers. Each step adds up gradient and curvature where the rows are; matrices of the model's size, not
rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from .tables import summed

#: What every pair is described by.
FEATURES = ("score", "common", "jaccard", "contained", "equal", "length_gap", "other_group")


def key(name: Column) -> Column:
    """What names are compared by; null is an empty name."""
    return name_key(F.coalesce(name, F.lit("")))


def _names(ka: Column, kb: Column) -> dict[str, Column]:
    ta, tb = F.array_distinct(F.split(ka, " ")), F.array_distinct(F.split(kb, " "))
    common, every = F.size(F.array_intersect(ta, tb)).cast("double"), F.size(F.array_union(ta, tb)).cast("double")
    number = lambda c: c.cast("double")
    return {
        "common": common, "jaccard": common / every, "contained": number((ka != "") & (kb != "") & (F.contains(ka, kb) | F.contains(kb, ka))), "equal": number((ka != "") & (ka == kb)),
        "length_gap": F.log1p(F.abs(F.length(ka) - F.length(kb)).cast("double")),
    }


def features(a: Column, b: Column, score: Column, group_a: Column, group_b: Column, keyed: bool = False) -> Column:
    """The features of a pair as array<double>; nulls are empty names, 0 and no group. With ``keyed``, names are given by their ``key`` (made once for a name, not for each pair)."""
    found = _names(a, b) if keyed else _names(key(a), key(b))
    found["score"] = F.coalesce(score.cast("double"), F.lit(0.0))
    found["other_group"] = F.coalesce((group_a != group_b).cast("double"), F.lit(0.0))
    return F.array(*[found[f] for f in FEATURES])


@dataclass(frozen=True)
class PairModel:
    """Weights (class, 1 + feature) over features that are centred and scaled; the first class has zeros."""

    classes: tuple[str, ...]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def chances(self, x: Column) -> Column:
        """Chance of each class, by built-in functions."""
        w = self.weights[:, 1:] / self.scale
        b = self.weights[:, 0] - w @ self.mean
        # sums written out, in the order of the features: plain arithmetic is compiled, and evaluated once for all classes
        linear = [sum((x[j] * F.lit(float(c)) for j, c in enumerate(w[k])), F.lit(float(b[k]))) for k in range(len(self.classes))]
        top = F.greatest(*linear) if len(linear) > 1 else linear[0]
        raised = [F.exp(v - top) for v in linear]
        total = sum(raised[1:], raised[0])
        return F.array(*[v / total for v in raised])

    def classified(self, pairs: DataFrame, x: Column) -> DataFrame:
        """pairs with rel_type and confidence; ties go to the class named first."""
        rows = pairs.withColumn("_p", self.chances(x)).withColumn("confidence", F.array_max("_p"))
        names = F.array(*[F.lit(c) for c in self.classes])
        return rows.withColumn("rel_type", F.element_at(names, F.array_position("_p", F.col("confidence")).cast("int"))).drop("_p")

    def classifier(self) -> Callable[[list[dict]], list[dict]]:
        """The model for ``classify_misses``: dicts with ``x`` (the features), answered by pair_index."""

        def run(pairs: list[dict]) -> list[dict]:
            x = (np.array([p["x"] for p in pairs], float) - self.mean) / self.scale
            p = softmax(np.hstack([np.ones((len(x), 1)), x]) @ self.weights.T)
            return [{"pair_index": k, "rel_type": self.classes[c], "confidence": float(p[k, c]), "direction": None, "description": "", "evidence": ""} for k, c in enumerate(p.argmax(axis=1).tolist())]

        return run


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: float) -> np.ndarray:
    """Newton step for the weights of all classes but the first; the ridge leaves intercepts alone."""
    k, d = w.shape
    free = w[1:].ravel()
    penalty = np.tile(np.r_[0.0, np.full(d - 1, ridge)], k - 1)
    move = np.linalg.solve(curvature + np.diag(penalty + 1e-12), gradient - penalty * free)
    return np.vstack([np.zeros(d), (free + move).reshape(k - 1, d)])


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and curvature of rows (with a leading 1) of classes y."""
    p = softmax(x @ w.T)
    k, d = w.shape
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y] = 1
    g = ((hit - p)[:, 1:].T @ x).ravel()
    h = np.zeros(((k - 1) * d, (k - 1) * d))
    for a in range(1, k):
        for b in range(1, k):
            v = p[:, a] * ((a == b) - p[:, b])
            h[(a - 1) * d : a * d, (b - 1) * d : b * d] = (x * v[:, None]).T @ x
    return float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()), g, h


def fit(rows: DataFrame, classes: tuple[str, ...], x: str = "x", label: str = "label", ridge: float = 1.0, steps: int = 25) -> PairModel:
    """Fit over (x array<double>, label string); rows of other labels or without one are left out, an error if none is left.

    The model knows the classes that occur, in the order given. Steps are halved while they lower the penalised likelihood.
    """
    there = {r[0] for r in rows.select(label).where(F.col(label).isin(*classes)).distinct().collect()}  # classes at most
    classes = tuple(c for c in classes if c in there)
    if not classes:
        raise ValueError("no labelled pairs")
    names = F.array(*[F.lit(c) for c in classes])
    data = rows.where(F.col(label).isin(*classes)).select(F.col(x).alias("x"), (F.array_position(names, F.col(label)) - 1).cast("int").alias("y"))

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(0)
        return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(len(lists), -1), batch.column(1).to_numpy(zero_copy_only=False)

    moments = summed(data, lambda b: np.concatenate([[b.num_rows], (m := matrix(b)[0]).sum(axis=0), (m * m).sum(axis=0)]))
    n, d = moments[0], (len(moments) - 1) // 2
    mean = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0))
    scale[scale < 1e-12] = 1.0

    def evaluate(w: np.ndarray):
        def part(batch: pa.RecordBatch) -> np.ndarray:
            m, y = matrix(batch)
            f, g, h = sums(np.hstack([np.ones((len(m), 1)), (m - mean) / scale]), y, w)
            return np.concatenate([[f], g, h.ravel()])

        total = summed(data, part)
        size = (len(classes) - 1) * (d + 1)
        return total[0] - ridge / 2 * (w[:, 1:] ** 2).sum(), total[1 : size + 1], total[size + 1 :].reshape(size, size)

    w = np.zeros((len(classes), d + 1))
    if len(classes) == 1:
        return PairModel(classes, w, mean, scale)
    value, g, h = evaluate(w)
    for _ in range(steps):
        target = step(w, g, h, ridge)
        for _ in range(8):
            new = evaluate(target)
            if new[0] >= value - 1e-9 * abs(value):
                break
            target = (target + w) / 2
        moved = np.abs(target - w).max()
        w, (value, g, h) = target, new
        if moved < 1e-9:
            break
    return PairModel(classes, w, mean, scale)
