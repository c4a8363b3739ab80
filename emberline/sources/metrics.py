"""Metrics table readers. One DataFrame over all topics replaces a connection for each sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def metrics_from(df: DataFrame, topic: str = "topic", ts: str = "ts", value: str = "value", seq: str | None = "seq") -> DataFrame:
    """df as a metrics table (topic, ts without zone in UTC, value, seq)."""
    order = F.col(seq) if seq else F.lit(None)
    return df.select(F.col(topic).alias("topic"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(value).cast("double").alias("value"), order.cast("bigint").alias("seq"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return metrics_from(spark.read.parquet(path))


def read_jdbc(spark: SparkSession, url: str, table: str, partitions: int = 16, bounds: tuple[str, str] | None = None, seq: str | None = None, **options: str) -> DataFrame:
    """Metrics from a database; with bounds on ts the read is split into so many ranges.

    seq names a column that tells rows of one time apart. Where the table has none, a hash of topic and value stands in,
    so that pages of a cursor lose none of several rows of one time unless these are alike.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        reader = reader.option("partitionColumn", "ts").option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    rows = reader.load()
    return metrics_from(rows, seq=seq) if seq else metrics_from(rows.withColumn("_seq", F.xxhash64("topic", "value")), seq="_seq")


def keep_last(metrics: DataFrame) -> DataFrame:
    """One row for each topic and time, that with the largest seq: the table of a store that overwrites."""
    newest = Window.partitionBy("topic", "ts").orderBy(F.col("seq").desc_nulls_last())
    return metrics.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append, laid out by day and sorted by topic and time within files, so that topic and time filters skip data."""
    by_day = metrics.withColumn("day", F.to_date("ts"))
    by_day.repartition("day", F.xxhash64("topic") % 8).sortWithinPartitions("topic", "ts").write.mode("append").partitionBy("day").parquet(path)
