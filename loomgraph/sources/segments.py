"""Sorted key-value segments with a sparse index, for scans of a key prefix.

Segments are Parquet files of key ranges, sorted by key; the index holds the first and the last key of each. A scan opens only the segments whose range
meets the prefix, and inside them the reader skips row groups by their own statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_segments(rows: DataFrame, path: str, segments: int, key: str = "key", mode: str = "errorifexists") -> None:
    """Write rows as at most ``segments`` sorted segments and their index. Rows without a key are left out, as a key-value store has none."""
    ordered = rows.where(F.col(key).isNotNull()).repartitionByRange(segments, key).sortWithinPartitions(key)
    ordered.write.mode(mode).parquet(f"{path}/segments")
    files = rows.sparkSession.read.schema(ordered.schema).parquet(f"{path}/segments")
    index = files.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    index.write.mode(mode).parquet(f"{path}/index")


def _files(spark: SparkSession, path: str, prefix: str) -> list[str]:
    index = spark.read.parquet(f"{path}/index")
    # keys with the prefix lie from the prefix on; a segment meets them unless it ends before or begins beyond
    beyond = (F.col("first") > F.lit(prefix)) & ~F.col("first").startswith(prefix)
    met = index.where((F.col("last") >= F.lit(prefix)) & ~beyond).select("file")
    return sorted(f"{path}/segments/{r.file}" for r in met.toLocalIterator())


def scan_prefix(spark: SparkSession, path: str, prefix: str, key: str = "key") -> DataFrame:
    """Rows whose key starts with the prefix (all rows for an empty one), from the segments that can hold it."""
    schema = spark.read.parquet(f"{path}/segments").schema
    found = _files(spark, path, prefix)
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return rows.where(F.col(key).startswith(prefix)) if prefix else rows


def get(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """Rows of one key."""
    return scan_prefix(spark, path, value, key).where(F.col(key) == F.lit(value))
