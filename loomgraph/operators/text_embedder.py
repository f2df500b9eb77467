"""Vectors of texts from a corpus: TF-IDF, reduced by a randomised range finder.

Tokens are hashed to ``COLUMNS`` columns, so the vocabulary needs no dictionary. The leading right singular vectors of the weighted matrix are
found by power iteration on a random block over the counted columns of each text, which are made once and written: each pass sums A^T (A Q) over partitions, matrices of COLUMNS x (dimension + ``SPARE``) values, and
orthogonalises on the driver. A text's vector is its weighted row times those vectors, of length one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, summed

COLUMNS, SPARE, PASSES = 8192, 16, 8
#: Rows multiplied at once.
_ROWS = 512


def columns_of(text: str, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the distinct tokens of a normalised text, and how often each stands."""
    at = np.fromiter(map(xxhash.xxh64_intdigest, text.split()), np.uint64) % np.uint64(columns)
    return np.unique(at.astype(np.int64), return_counts=True)


@dataclass(frozen=True)
class Embedder:
    """idf of each column, and the basis (column, dimension)."""

    idf: np.ndarray
    basis: np.ndarray

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """Weighted rows of normalised texts, dense; blank texts are zero."""
        pairs = [columns_of(text or "", len(self.idf)) for text in texts]
        at, n = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in range(2))
        return self.weighted(at, n, np.array([len(p[0]) for p in pairs], np.int64))

    def weighted(self, at: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same from the columns of all texts and their counts, one text after the other, and how many columns each has."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        w = (1 + np.log(n)) * self.idf[at]
        length = np.sqrt(np.bincount(text, w * w, len(sizes)))
        out = np.zeros((len(sizes), len(self.idf)))
        out[text, at] = w / np.where(length > 0, length, 1.0)[text]
        return out

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of length one of weighted rows, zero where nothing of a text is known."""
        v = rows @ self.basis
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(length > 1e-12, length, 1.0)

    def __call__(self, texts: list[str | None]) -> list[list[float]]:
        """Vectors of length one (zero where nothing of a text is known), for ``embed_misses``."""
        plain = [" ".join((t or "").lower().split()) for t in texts]
        return [v for at in range(0, len(plain), _ROWS) for v in self.vectors(self.rows(plain[at : at + _ROWS])).tolist()]


def counted(df: DataFrame, id_col: str | None = None, text_col: str = "text", columns: int = COLUMNS) -> DataFrame:
    """at, n (arrays) of each text: the columns of its tokens and how often each stands; and id, if asked for. Texts are split here only."""
    names = [*(["id"] if id_col else []), "at", "n"]

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                pairs = [columns_of(text, columns) for text in part.column(part.num_columns - 1).to_pylist()]
                starts = np.cumsum([0, *(len(p[0]) for p in pairs)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(starts, np.concatenate([p[k] for p in pairs]).astype(np.int32)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names)

    kept, kind = ([F.col(id_col).alias("id")], f"id {dict(df.dtypes)[id_col]}, ") if id_col else ([], "")
    return df.select(*kept, F.lower(F.coalesce(text_col, F.lit(""))).alias("text")).mapInArrow(run, f"{kind}at array<int>, n array<int>")


def _slices(batch: pa.RecordBatch):
    """Columns, counts and sizes of some texts at a time of a batch whose last two columns are ``at`` and ``n``."""
    for first in range(0, batch.num_rows, _ROWS):
        at, n = batch.slice(first, _ROWS).columns[-2:]
        yield pc.list_flatten(at).to_numpy(zero_copy_only=False), pc.list_flatten(n).to_numpy(zero_copy_only=False), pc.list_value_length(at).to_numpy(zero_copy_only=False)


def fit(df: DataFrame, dimension: int = 64, text_col: str = "text", seed: int = 1, passes: int = PASSES, columns: int = COLUMNS) -> Embedder:
    """Embedder of a corpus; an empty one gives vectors of zeros."""
    return fit_counted(cut(counted(df, None, text_col, columns)), dimension, seed, passes, columns)


def fit_counted(texts: DataFrame, dimension: int = 64, seed: int = 1, passes: int = PASSES, columns: int = COLUMNS) -> Embedder:
    """``fit`` over a cut table of what ``counted`` gives: all passes read it, not the texts."""
    texts = texts.select("at", "n")

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        seen = np.zeros(columns + 1)
        for at, _, _ in _slices(batch):
            seen[:-1] += np.bincount(at, minlength=columns)
        seen[-1] = batch.num_rows
        return seen

    found = summed(texts, counts)
    if found is None:
        return Embedder(np.zeros(columns), np.zeros((columns, dimension)))
    # one more document with every token; a token of all keeps the weight 1
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    wide = dimension + SPARE
    blank = Embedder(idf, np.zeros((columns, 0)))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, wide)))[0]
    context = texts.sparkSession.sparkContext
    for _ in range(passes):
        shared = context.broadcast(q)

        def product(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            total = np.zeros((columns, wide))
            for part in _slices(batch):
                a = blank.weighted(*part)
                total += a.T @ (a @ shared.value)
            return total.ravel()

        g = summed(texts, product).reshape(columns, wide)
        e, u = np.linalg.eigh(q.T @ g)  # of A^T A within the block
        last = q @ u[:, ::-1][:, :dimension]
        q = np.linalg.qr(g)[0]
        shared.destroy()
    # one sign for each vector, whatever the library: its largest entry is positive
    top = np.abs(last).argmax(axis=0)
    return Embedder(idf, last * np.sign(last[top, np.arange(dimension)]))


def embedded(df: DataFrame, model: Embedder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, vector array<float> of each row."""
    return embedded_counted(counted(df, id_col, text_col, len(model.idf)), model)


def embedded_counted(texts: DataFrame, model: Embedder) -> DataFrame:
    """``embedded`` over what ``counted`` gives with an id."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for k, part in enumerate(_slices(batch)):
                v = shared.value.vectors(shared.value.weighted(*part)).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k * _ROWS, _ROWS), lists], ["id", "vector"])

    return texts.select("id", "at", "n").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, vector array<float>")
