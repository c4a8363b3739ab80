"""Open properties of events as VARIANT: any keys, and values of any type under one key.

A stored log is shredded: Parquet has a typed column for each key whose values mostly share a type, so that a filter on
one property reads that column and its statistics, not the whole of the properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.streaming.run import settings


def with_variant(log: DataFrame) -> DataFrame:
    """An event log whose properties are VARIANT in place of JSON; null where they aren't JSON."""
    return log.withColumn("properties", F.try_parse_json("properties"))


def with_json(log: DataFrame) -> DataFrame:
    """The same log with its properties as JSON again."""
    return log.withColumn("properties", F.to_json("properties"))


def value_of(name: str, kind: str) -> Column:
    """A property as this type; null where it is missing or can't be that type."""
    return F.try_variant_get("properties", f"$.{name}", kind)


def kind_of(name: str) -> Column:
    """What type a property has in each event, as SQL writes it; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get("properties", f"$.{name}", "variant"))


def write_events(log: DataFrame, path: str) -> None:
    """Append a log with VARIANT properties, by day and in order of time within files, shredded by what its values are."""
    by_day = log.withColumn("day", F.to_date("ts"))
    with settings(log.sparkSession, spark__sql__variant__writeShredding__enabled="true", spark__sql__variant__inferShreddingSchema="true"):
        by_day.repartition("day").sortWithinPartitions("ts", "seq").write.mode("append").partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stored log. Asked-for properties alone are read, where spark.sql.variant.pushVariantIntoScan is on."""
    spark.conf.set("spark.sql.variant.pushVariantIntoScan", "true")
    return spark.read.parquet(path)
