"""Rating events as a stream: deduplicated, counted in windows and sessions, and merged into a table (2.11; an extension of the batch queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RATING_OF = {"click": "correct", "view": "partial", "purchase": "correct", "signup": "missing", "error": "wrong"}
EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Events of a folder of Parquet files, as a stream."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rated(events: DataFrame) -> DataFrame:
    """event_id, at, reviewer, rating; unknown event types count as partial."""
    kinds = F.create_map(*[F.lit(x) for kv in RATING_OF.items() for x in kv])
    return events.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("reviewer"), F.coalesce(kinds[F.col("event_type")], F.lit("partial")).alias("rating"))


def windowed_counts(ratings: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """start, rating, n for each window; repeated event ids within the delay count once, events later than it are dropped."""
    once = ratings.withWatermark("at", delay)
    if ratings.isStreaming:
        once = once.dropDuplicatesWithinWatermark(["event_id"])
    else:
        once = once.dropDuplicates(["event_id"])
    out = once.groupBy(F.window("at", window).alias("w"), "rating").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "rating", "n")


def sessions(ratings: DataFrame, gap: str = "30 minutes", delay: str = "2 days") -> DataFrame:
    """reviewer, start, end, n: sessions of a reviewer without a gap that long."""
    out = ratings.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "reviewer").agg(F.count(F.lit(1)).alias("n"))
    return out.select("reviewer", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merge_into(ratings: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Latest rating of each (reviewer, event_id): each batch replaces its own version, so a repeated batch changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("reviewer", "event_id").agg(F.max(F.struct("at", "rating")).alias("last")).select("reviewer", "event_id", "last.at", "last.rating")
        latest.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return ratings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The table that ``merge_into`` keeps: the latest version of each key."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("reviewer", "event_id").agg(F.max(F.struct("at", "batch", "rating")).alias("last")).select("reviewer", "event_id", "last.at", "last.rating")
