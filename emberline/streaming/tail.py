"""Tails of the metrics table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from emberline.operators.metrics import cursor_page, step_seconds
from emberline.streaming.run import Subscription, every


class PolledTail:
    """Pages of new rows after a cursor, for stores that can only be asked.

    The cursor is (ts, seq), so rows that share the time of a page's last row come with the next page. Rows that
    arrive behind the cursor are not seen, as with any cursor.
    """

    def __init__(self, read: Callable[[], DataFrame], since: datetime, limit: int = 100) -> None:
        self.read, self.since, self.seq, self.limit = read, since, None, limit

    def poll(self) -> list[Row]:
        page = cursor_page(self.read(), self.since, self.seq, self.limit).collect()  # at most `limit` rows
        if page:
            self.since, self.seq = page[-1]["ts"], page[-1]["seq"]
        return page

    def start(self, spark: SparkSession, step_ms: int, callback: Callable[[Row], None]) -> Subscription:
        """Poll each step and call back for each row, in order."""

        def tick(_: int) -> None:
            for row in self.poll():
                callback(row)

        return every(spark, step_ms, tick)


def tail_files(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """New rows of a folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def after(stream: DataFrame, since: datetime) -> DataFrame:
    return stream.where(F.col("ts") > F.lit(since).cast(stream.schema["ts"].dataType))


def downsample_stream(stream: DataFrame, step_ms: float, lateness: str = "1 minute") -> DataFrame:
    """topic, timestamp and mean value of each bucket, over a stream of metrics (ts with or without zone)."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    bucket = F.window("ts", f"{step_seconds(step_ms)} seconds")
    means = timed.groupBy("topic", bucket).agg(F.avg("value").alias("value"))
    return means.select("topic", F.col("window.start").cast("timestamp_ntz").alias("timestamp"), "value")
