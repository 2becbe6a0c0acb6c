"""Streams over event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream with a UTC timestamp.

    The stream source lists folders; a glob with one bracketed letter names a single file.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return agg.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return agg.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select("w.start", "w.end", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return agg.agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_phase(events: DataFrame, period_seconds: float) -> DataFrame:
    """Z2 of a fold per event type, kept up to date as events arrive (three sums of state)."""
    phase = 2.0 * 3.141592653589793 * F.pmod(F.unix_micros("ts") / 1e6 / period_seconds, F.lit(1.0))
    sums = events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("s"))
    return sums.select("event_type", "n", (2.0 / F.col("n") * (F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("z2"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is and return its memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream into a Parquet table and read it."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def for_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
