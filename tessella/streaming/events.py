"""Event operators. Those on DataFrames work on batches and streams alike where Spark allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Events of a folder of Parquet files as a stream, with ts as an instant, which watermarks need."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, total: counts and values of fixed windows. late: how long a stream waits for late events."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, n: runs of a user's events with less than the gap between them."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def distinct(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """A stream without repeated keys within the time that late events are waited for."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """user_id, day, n: the counter that admission compares with its limit."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.to_date("w.start").alias("day"), "n")


def admission(events: DataFrame, limit: int) -> DataFrame:
    """events with nth of the user's day, admitted and remaining."""
    nth = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return events.withColumn("nth", nth).withColumns({"admitted": F.col("nth") <= limit, "remaining": F.greatest(F.lit(0), limit - F.col("nth"))})


def sliding_limit(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """events with recent, the user's events in the seconds up to each, and allowed."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= limit)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The 2 n turns before the last one of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", back).filter(F.col("back") <= 2 * n + 1).filter("back > 1").drop("back")


def last_write(events: DataFrame, keys: list[str], value: str, valid: list) -> DataFrame:
    """The last valid value of each key: an aggregate, so a hot key is combined before it is shuffled."""
    return events.filter(F.col(value).isin(valid)).groupBy(*keys).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))


def ready(jobs: DataFrame, now) -> DataFrame:
    """Jobs that were rendering and whose time has come are ready."""
    return jobs.withColumn("status", F.when((F.col("status") == "rendering") & (F.col("ready_at") <= now), "ready").otherwise(F.col("status")))
