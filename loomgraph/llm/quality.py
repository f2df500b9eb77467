"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

1. Each whole text gives a fixed vector of document statistics (``FEATURES``). Labels,
   language, source, doc_id and length columns are never inputs.
2. Statistics are scaled by sums over the labelled rows; cosines of fixed random projections
   (seeded) approximate a Gaussian kernel over them.
3. Each partition of the labelled rows adds up its part of the normal equations (a matrix of
   fixed size); the sums are reduced in a tree and solved on the driver.
4. Raw scores of the labelled rows are counted into ``BINS`` fixed bins (positives and all);
   pool-adjacent-violators over the bins gives the calibration, a step function made
   linear between block means.

What reaches the driver has a fixed size whatever the input. All labelled rows take part.

Null, empty and blank texts have all-zero statistics and get a score like any other text.
Labels that are null or not 0/1 are ignored; a doc_id with several labels counts once for each.
With no usable label, or labels of one class only, every score is the share of label 1
(0.5 with none). Rows with null doc_id are scored and never learnt from; repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, summed, without

#: Random features, kernel width in units of scaled statistics, ridge weight, calibration bins.
RANDOM_FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 4.0, 1e-3, 512, 11
CHUNK_BYTES = 2 << 20

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "upper", "lower", "digit", "space", "marks", "stops", "other",
    "pipes", "exclaims", "repeated_marks", "upper_words", "same_as_last", "distinct_words", "lines_per_word", "distinct_lines",
    "short_lines", "max_char", "odd_chars", "url_marks", "mean_sentence",
)

#: A mark that stands twice or more in a row.
_REPEATED = re.compile(rb"([!-/:-@\[-`{-~])\1+")
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
    "stops": b".,;:?'\"()-", "marks": b"#$%&*+/<=>@[\\]^_`{|}~!", "other": range(128, 256),
    "pipes": b"|", "exclaims": b"!", "odd_chars": (*range(9), *range(14, 32), 127), "url_marks": b"/@",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v), _k] = 1


def statistics(text: str | None) -> list[float]:
    """The document statistics of one whole text, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = dict(zip(_CLASSES, counts @ _TABLE / chars, strict=True))
    lens = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    upper_words = sum(map(bytes.isupper, words)) / n
    repeated_marks = len(_REPEATED.findall(raw)) / n
    letters = counts.copy()
    letters[32] = 0
    return [
        np.log1p(chars), np.log1p(n), lens.mean(), (lens > 20).mean(), share["upper"], share["lower"], share["digit"], share["space"],
        share["marks"], share["stops"], share["other"], share["pipes"], share["exclaims"], repeated_marks, upper_words,
        same, distinct / n**0.8, len(lines) / n, len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        letters.max() / chars, share["odd_chars"], share["url_marks"], n / (1 + raw.count(b".") + raw.count(b"!") + raw.count(b"?")),
    ]


def profile(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``stats`` array<double>, one row per row of ``df``."""
    wide = df.select(*keep, F.col(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches, "text", CHUNK_BYTES):
            stats = np.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.float64)
            offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))], [*keep, "stats"])

    return wide.mapInArrow(run, wide.drop("text").select("*", F.lit(None).cast("array<double>").alias("stats")).schema)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("stats"))
    return pc.list_flatten(col).to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


class Model:
    """Fitted scaling, random features, ridge weights and calibration."""

    def __init__(self, base: float, scale=None, weights=None, knots=None):
        self.base, self.scale, self.weights, self.knots = base, scale, weights, knots

    @staticmethod
    def projection() -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return rng.normal(0, 1 / WIDTH, (len(FEATURES), RANDOM_FEATURES)), rng.uniform(0, 2 * np.pi, RANDOM_FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        mean, std = self.scale
        w, b = self.projection()
        z = np.clip((stats - mean) / std, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / RANDOM_FEATURES) * np.cos(z @ w + b)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        # twelve places: the order of summation does not show
        return np.round(np.clip(np.interp(self.raw(stats), *self.knots), 0, 1), 12)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means of x (weighted) and of y."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    xs, ys, ws = np.array(blocks).T
    return xs / ws, ys / ws


def fit(rows: DataFrame) -> Model:
    """Model of ``rows`` (stats, label 0/1)."""
    k = len(FEATURES)

    def moments(batch):
        s = _stats_of(batch)
        y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([[len(s), y.sum()], s.sum(0), (s**2).sum(0)])

    got = summed(rows, moments)
    if got is None:
        return Model(0.5)
    n, positive = got[:2]
    if positive in (0, n):
        return Model(positive / n)
    mean = got[2 : 2 + k] / n
    std = np.sqrt(np.maximum(got[2 + k :] / n - mean**2, 0))
    std[std < 1e-9] = 1.0
    model = Model(positive / n, (mean, std))
    d = RANDOM_FEATURES + 1

    def normal(batch):
        y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
        # both classes weigh the same in the fit; calibration goes back to true shares
        w = np.where(y == 1, n / (2 * positive), n / (2 * (n - positive)))
        z = model.features(_stats_of(batch))
        return np.concatenate([(z.T @ (z * w[:, None])).ravel(), z.T @ (w * (2 * y - 1))])

    sums = summed(rows, normal)
    matrix, right = sums[: d * d].reshape(d, d), sums[d * d :]
    model.weights = np.linalg.solve(matrix + RIDGE * n / d * np.eye(d), right)

    def counted(batch):
        y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
        raw = np.clip(model.raw(_stats_of(batch)), -2, 2)
        at = np.minimum(((raw + 2) / 4 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, v, BINS) for v in (np.ones(len(y)), y, raw)])

    count, hits, total = summed(rows, counted).reshape(3, BINS)
    some = count > 0
    model.knots = _isotonic(total[some] / count[some], hits[some] / count[some], count[some])
    return model


def learnable(df: DataFrame) -> DataFrame:
    """Rows that may teach: crc32(doc_id as text) mod 3 is not 1."""
    return df.where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``documents``."""
    stats = cut(profile(documents), "stats")
    marked = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(cut(learnable(stats).join(learnable(marked), "doc_id").select("stats", "label"), "taught"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stats_of(batch)))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted to be of low quality (all its columns).

    Rows with null doc_id stay: a rejection needs a document to name.
    """
    return without(documents, scores(documents, labels).where("predicted = 0"))
