"""Durable tables between steps, in the folder that the cluster shares, and broadcasts of checked size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 200_000
#: Rows that ``spread`` gives to a task, about.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``; a temporary one only on one machine where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix=f"loomgraph-{uuid.uuid4().hex[:8]}-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write as Parquet in the folder the cluster shares and read back: computed once, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """Rows of the same keys in one task, about ``rows`` in each whatever the session's number of partitions: what a task holds does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1 + df.count() // rows), *keys)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A cut table, broadcast if it has up to ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def summed(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of the float arrays of one size that ``per_batch`` gives for an Arrow batch; None without rows.

    Partitions add up their own, then eight tasks what partitions have; the driver gets eight arrays.
    """

    def total(arrays):
        out = None
        for a in arrays:
            out = a if out is None else out + a
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(out, float).tobytes()])], ["part"])

    def own(batches):
        yield from total(per_batch(b) for b in batches if b.num_rows)

    def others(batches):
        yield from total(np.frombuffer(x) for b in batches for x in b.column(0).to_pylist())

    parts = rows.mapInArrow(own, "part binary").repartition(8).mapInArrow(others, "part binary").collect()
    return np.sum([np.frombuffer(r.part) for r in parts], axis=0) if parts else None
