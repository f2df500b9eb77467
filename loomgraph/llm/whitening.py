"""Whitening of embeddings by an exact-to-double covariance and its leading eigenvectors.

Each finite entry c becomes the whole number x = floor(64 * c) + 1000000. Per-dimension sums S are exact. Rows are centred
before they are multiplied, by a mean held in double-double. A block of centred rows is split, without error, into three slices
of few bits, so that the matrix products of slices have no rounding either (sums of whole numbers below 2^53);
the products are added up in double-double by two-sums, high and low parts are merged across tasks row by
row of the matrix. The covariance, rounded once, goes to LAPACK's dsyevd (reduction to a tridiagonal matrix, divide and
conquer), which is what ``numpy.linalg.eigh`` calls.

Only sums of one matrix's size leave the tasks. Components are fixed on the driver, so all rows see the same signs.

Rows whose vector is null or empty, or holds null, non-finite or very large entries (|64 * c| >= 2^48: no exact sums) take no part, nor do
vectors of another length than most rows have (ties: the longer). A null vec_id is an id; repeated rows are rows each. Components
without variance (eigenvalue at most 1e-11 of the trace) can't be whitened and are left out, so a table of equal rows gives no rows, like
an empty one. ``deviation`` is exact; beyond the range of a long it is held at its end. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows multiplied at once, and bits of a slice: 2 * 21 + 11 bits are exact in a double.
BLOCK, BITS = 2048, 21
#: Share of the trace up to which an eigenvalue is rounding.
NO_VARIANCE = 1e-11
_LARGE = 2.0**48


def two_sum(a, b):
    """a + b as its rounded value and the exact rest (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Sum:
    """Double-double sum of arrays."""

    def __init__(self, shape):
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, high, low=0.0):
        s, rest = two_sum(self.high, high)
        rest = rest + (self.low + low)
        self.high, self.low = two_sum(s, rest)


def slices_of(high: np.ndarray, low: np.ndarray | float) -> list[np.ndarray]:
    """Three parts of high + low: two of at most ``BITS`` bits on a common grid for each column, and the rest."""
    top = np.abs(high).max(axis=0, initial=0.0)
    grid = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - BITS)
    first = np.rint(high / grid) * grid
    rest = high - first
    grid = np.ldexp(grid, -BITS - 1)
    second = np.rint(rest / grid) * grid
    return [first, second, (rest - second) + low]


def add_products(total: Sum, high: np.ndarray, low: np.ndarray | float) -> None:
    """Add the products of all columns of high + low, summed over rows."""
    for at in range(0, len(high), BLOCK):
        part = slice(at, at + BLOCK)
        s = slices_of(high[part], low[part] if isinstance(low, np.ndarray) else low)
        for i in range(3):
            for j in range(i, 3):
                g = s[i].T @ s[j]
                total.add(g)
                if i != j:
                    total.add(g.T)


@dataclass(frozen=True)
class Mean:
    """S / n: the whole part of each dimension, and the fraction in double-double."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    high: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, sums: list[int], n: int) -> Mean:
        whole = [s // n for s in sums]
        rest = [s - w * n for s, w in zip(sums, whole, strict=True)]
        high = [r / n for r in rest]
        low = [float(Fraction(r, n) - Fraction(h)) for r, h in zip(rest, high, strict=True)]
        return cls(n, np.array(whole, np.int64), np.array(rest, np.int64), np.array(high), np.array(low))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = two_sum((x - self.whole).astype(float), -self.high)
        return high, low - self.low

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exact."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1)
        exact = (self.n * y.astype(object) - self.rest.astype(object)) ** 2
        return np.array([min(int(v), 2**63 - 1) for v in exact.sum(axis=1)], np.int64)


def vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, int, int]:
    """(vec_id, v array<double>) of the rows that take part, their length and number."""
    x = F.col(vec_col)
    small = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * SCALE) < _LARGE))
    rows = df.where(x.isNotNull() & (F.size(x) > 0) & small).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.where(F.size("v") == top.d), top.d, top.n) if top else (rows, 0, 0)


def _whole(column: pa.Array, d: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


def sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension of x."""

    def part(batches):
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _whole(batch.column(0), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["i", "s"])

    parts = rows.select("v").mapInArrow(part, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    return [int(r.s) for r in sorted(parts.collect(), key=lambda r: r.i)]


def products(rows: DataFrame, centre, d: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the d x d sums of products of the rows of ``centre`` (matrix of v -> high, low), over all rows of ``v``."""
    out = "i int, high binary, low binary"

    def rows_of(total: Sum, ids):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([r.tobytes() for r in total.high]), pa.array([r.tobytes() for r in total.low])], ["i", "high", "low"])

    def part(batches):
        total = Sum((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                add_products(total, *centre(batch.column(0).slice(at, BLOCK)))
        yield rows_of(total, list(range(d)))

    def merge(batches):
        held: dict[int, Sum] = {}
        for batch in batches:
            for i, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(i, Sum(d)).add(np.frombuffer(high), np.frombuffer(low))
        if held:
            total = Sum((len(held), d))
            total.high, total.low = np.stack([s.high for s in held.values()]), np.stack([s.low for s in held.values()])
            yield rows_of(total, list(held))

    merged = rows.select("v").mapInArrow(part, out).repartition(min(d, 64), "i").mapInArrow(merge, out).collect()
    merged.sort(key=lambda r: r.i)
    return np.stack([np.frombuffer(r.high) for r in merged]), np.stack([np.frombuffer(r.low) for r in merged])


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: columns of ``basis`` are the unit eigenvectors over the roots of their eigenvalues, by falling eigenvalue."""

    mean: Mean
    basis: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        high, low = self.mean.centred(x)
        return high @ self.basis + low @ self.basis


def fit(rows: DataFrame, d: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Fit over (v) rows of one length d."""
    mean = Mean.of(sums(rows, d), n)
    high, low = products(rows, lambda column: mean.centred(_whole(column, d)), d)
    v = (high + low) / n
    e, u = np.linalg.eigh((v + v.T) / 2)  # dsyevd
    e, u, trace = e[::-1], u[:, ::-1], float(np.trace(v))
    kept = min(components, int((e > NO_VARIANCE * trace).sum()) if trace > 0 else 0)
    return Whitening(mean, u[:, :kept] / np.sqrt(e[:kept]), e[:kept] / trace if kept else e[:0])


def identity_error(rows: DataFrame, w: Whitening, d: int) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    k, n = w.basis.shape[1], w.mean.n

    def means(batches):
        total = Sum(k)
        for batch in batches:
            for row in w(_whole(batch.column(0), d)):
                total.add(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total.high), pa.array(total.low)], ["i", "high", "low"])

    parts = rows.select("v").mapInArrow(means, "i int, high double, low double").groupBy("i").agg((F.sum("high") + F.sum("low")).alias("s")).collect()
    mean = np.array([r.s for r in sorted(parts, key=lambda r: r.i)]) / n
    high, low = products(rows, lambda column: (w(_whole(column, d)) - mean, 0.0), k)
    return float(np.abs((high + low) / n - np.eye(k)).max())


def whitened(df: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and component."""
    rows, d, n = vectors(df, vec_col, id_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    w = fit(rows, d, n, components) if n else None
    if w is None or not w.explained.size:
        return df.sparkSession.createDataFrame([], out)
    error, k = identity_error(rows, w, d), w.explained.size

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, m = _whole(part.column(1), d), part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(w.mean.deviations(x), k)), pa.array(w(x).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
