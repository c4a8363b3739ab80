"""Event and alert logs: append-only rows with ids in insertion order, predicate scans, latest version by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.scratch import written


def with_sequence(df: DataFrame, order_by: list[str], start: int = 0, out: str = "seq") -> DataFrame:
    """df with consecutive numbers from `start` in the order of the columns, without one task sorting all rows.

    Rows are dealt out by ranges and numbered within; each range then adds the rows of the ranges before it, a table
    with one row for each partition. The numbered ranges are written once, since ranges are cut by a sample.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order_by]).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + F.col("_nth") - 1 + start).cast("bigint")).drop("_part", "_nth", "_before")


def every(log: DataFrame, *filters: Column) -> DataFrame:
    """Rows that pass all filters; all rows without filters. A filter that is null doesn't pass."""
    return log.where(reduce(lambda a, b: a & b, filters, F.lit(True)))


def find(log: DataFrame, id_: str) -> DataFrame:
    """The row with this id, or none."""
    return log.where(F.col("id") == id_).limit(1)


def has_label(label: str) -> Column:
    return F.array_contains("labels", label)


def property_of(name: str, kind: str) -> Column:
    """A property of an event's JSON, as this type; null where it is missing or of another type."""
    return F.get_json_object("properties", f"$.{name}").try_cast(kind)


def create_events(rows: DataFrame, start: int = 0, order_by: list[str] | None = None) -> DataFrame:
    """Event rows (id, seq, ts, properties, labels) from ts, properties and labels; missing labels are an empty list."""
    numbered = with_sequence(rows, order_by or ["ts", "properties"], start)
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return numbered.select(F.concat(F.lit("ev-"), F.col("seq")).alias("id"), "seq", "ts", "properties", labels.alias("labels"))


def trigger_alerts(issues: DataFrame, start: int = 0, order_by: list[str] | None = None) -> DataFrame:
    """Alert rows from message, ts, object and, where there is one, event_id."""
    source = issues if "event_id" in issues.columns else issues.withColumn("event_id", F.lit(None).cast("string"))
    numbered = with_sequence(source, order_by or ["ts", "object", "message"], start)
    return numbered.select(
        F.concat(F.lit("alert-"), F.col("seq")).alias("id"), "seq", "message", "ts", "object", "event_id", F.lit(False).alias("acknowledged"), F.lit("created").alias("change")
    )


def acknowledge(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows to append to the alert log for the ids to acknowledge. Asking again gives a row again."""
    return latest_version(alerts).join(ids.select("id"), "id").withColumns({"acknowledged": F.lit(True), "change": F.lit("acknowledged")}).select(*alerts.columns)


def latest_version(log: DataFrame) -> DataFrame:
    """One row for each id of an alert log: acknowledged once any of its rows is, in the place (seq) of its first row."""
    names = [c for c in log.columns if c not in ("id", "seq")]
    newest = F.max_by(F.struct(*names), F.struct("acknowledged", "seq"))
    return log.groupBy("id").agg(F.min("seq").alias("seq"), newest.alias("_v")).select("id", "seq", *[F.col(f"_v.{c}").alias(c) for c in names])


def alerts_of_machines(alerts: DataFrame, machines: DataFrame) -> DataFrame:
    """Alerts whose object is the name of a machine, with the machine."""
    return alerts.join(machines.select("machine", F.col("name").alias("object")), "object")


def with_source_event(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the event that they came from, where there is one."""
    return alerts.join(events.select(F.col("id").alias("event_id"), F.struct("ts", "properties", "labels").alias("event")), "event_id", "left")

