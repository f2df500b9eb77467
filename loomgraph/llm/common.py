"""Shared plumbing: durable scratch tables, word hashing, chunking of Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based operator: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"

_dirs: dict[str, str] = {}
_scopes: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session. It goes when the driver ends.

    Where the setting is absent, a temporary folder stands in for it on one machine (unit tests); a cluster must have it.
    """
    app = spark.sparkContext.applicationId
    if app not in _dirs:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="loomgraph-")
        _dirs[app] = f"{base.rstrip('/')}/loomgraph-{app}"
        files, path = _files(spark, _dirs[app])
        files.deleteOnExit(path)
    return "/".join([_dirs[app], *_scopes])


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


@contextmanager
def scope(spark: SparkSession, name: str):
    """What ``cut`` writes inside is deleted at the end; results that read it must have been written by then."""
    _scopes.append(f"{name}-{uuid.uuid4().hex}")
    folder = scratch_dir(spark)
    try:
        yield
    finally:
        _scopes.pop()
        remove(spark, folder)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with a replicated or shared copy, so a lost executor costs
    a reread and not the whole history.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; ``trim`` keeps it bounded."""

    def __init__(self, seed: int, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, seed=self.seed)
        return h

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (other letters stay)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def give_back() -> None:
    """Return freed memory to the system: a worker that is kept for later stages would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``limit`` bytes, or items of lists, in each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        length = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
        size = np.cumsum(np.asarray(pc.fill_null(length, 0)).astype(np.int64))
        at = 0
        while at < n:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
        del batch, col
        give_back()


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``pick`` of the ragged array (values, offsets), joined; and the length of each."""
    lens = offsets[pick + 1] - offsets[pick]
    total = int(lens.sum())
    if not total:
        return values[:0], lens
    ends = np.cumsum(lens)
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[pick] - (ends - lens), lens)
    return values[at], lens


#: Keys of a side of a join that is broadcast, at most (16 MB as longs with their hash table).
BROADCAST_KEYS = 1_000_000


def bounded(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys``, a cut table, to be broadcast if it has up to ``limit`` rows; a join with more of them shuffles."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def without(df: DataFrame, keys: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys``; null never is."""
    keys = cut(keys.select(column).where(F.col(column).isNotNull()).distinct(), "keys")
    return df.join(bounded(keys), column, "left_anti").select(*df.columns)


def summed(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of the arrays of one fixed size that ``per_batch`` gives for each Arrow batch; None without rows.

    Parts are made where the rows are; only parts are moved, and eight sums reach the driver.
    """

    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = per_batch(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()])], ["part"])

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    parts = rows.mapInArrow(part, "part binary").repartition(8).mapInArrow(add, "part binary").collect()
    return np.sum([np.frombuffer(r.part) for r in parts], axis=0) if parts else None
