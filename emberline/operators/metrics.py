"""Sensor queries over the metrics table: all topics at once, each an aggregation, filter or top-k that Spark plans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def step_seconds(step_ms: float) -> int:
    """Whole seconds of a step in milliseconds, at least 1."""
    if isinstance(step_ms, bool) or not isinstance(step_ms, (int, float)) or step_ms != step_ms:
        raise ValueError("step must be a number of milliseconds")
    return max(1, int(step_ms // 1000))


def bucket_start(at: datetime, seconds: int) -> datetime:
    """Start of the bucket that holds `at`; buckets are counted from 1970."""
    return EPOCH + timedelta(seconds=(at - EPOCH) // timedelta(seconds=1) // seconds * seconds)


def of_topic(metrics: DataFrame, *topics: str) -> DataFrame:
    return metrics.where(F.col("topic").isin(*topics)) if topics else metrics


def with_unit(measured: DataFrame, sensors: DataFrame | None = None, unit: str | None = None) -> DataFrame:
    """Measurements with their unit: a constant, or the sensor dimension's by topic."""
    return measured.join(sensors.select("topic", "unit"), "topic", "left") if sensors is not None else measured.withColumn("unit", F.lit(unit).cast("string"))


def downsample(metrics: DataFrame, start: datetime, end: datetime, step_ms: float, clip_end: bool = False, ordered: bool = False) -> DataFrame:
    """topic, timestamp (bucket start) and mean value of each bucket with rows; by topic and time if ordered.

    The first bucket is the one that holds `start`, whole. The last is the one that holds `end`: whole, or only up to
    `end` if clip_end. Both bounds are on the raw time, so that they reach the scan.
    """
    seconds = step_seconds(step_ms)
    first, after = bucket_start(start, seconds), bucket_start(end, seconds) + timedelta(seconds=seconds)
    within = (F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz") if clip_end else F.col("ts") < F.lit(after).cast("timestamp_ntz"))
    means = metrics.where(within).groupBy("topic", F.window("ts", f"{seconds} seconds")["start"].alias("timestamp")).agg(F.avg("value").alias("value"))
    return means.orderBy("topic", "timestamp") if ordered else means


def measurements(metrics: DataFrame, start: datetime, end: datetime, ascending: bool | None = None) -> DataFrame:
    """Raw rows from start to end, both included; by time, rising or falling, if ascending is given."""
    rows = metrics.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).withColumnRenamed("ts", "timestamp")
    return rows if ascending is None else rows.orderBy(F.col("timestamp").asc() if ascending else F.col("timestamp").desc(), "seq")


def latest(metrics: DataFrame) -> DataFrame:
    """The newest row of each topic; of equal times the one ingested last."""
    newest = F.max_by(F.struct("ts", "value"), F.struct("ts", "seq"))
    return metrics.groupBy("topic").agg(newest.alias("_m")).select("topic", F.col("_m.ts").alias("timestamp"), F.col("_m.value").alias("value"))


def latest_or_default(metrics: DataFrame, sensors: DataFrame, now: Column) -> DataFrame:
    """The newest value of each sensor of the dimension; 0 at `now` where its topic has no rows."""
    met = sensors.join(latest(metrics), "topic", "left")
    return met.withColumns({"timestamp": F.coalesce("timestamp", now), "value": F.coalesce("value", F.lit(0.0))})


def cursor_page(metrics: DataFrame, since: datetime, since_seq: int | None = None, limit: int = 100) -> DataFrame:
    """The first `limit` rows after a cursor in (ts, seq) order. With since_seq no row of the cursor's time is lost."""
    at = F.lit(since).cast("timestamp_ntz")
    after = F.col("ts") > at
    if since_seq is not None:
        after = after | ((F.col("ts") == at) & (F.col("seq") > since_seq))
    return metrics.where(after).orderBy("ts", "seq").limit(limit)
