"""Plant tables derived from the star-schema test tables (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_type").alias("topic"), "ts", "value", F.col("event_id").alias("seq"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor for each topic, and one whose topic has no rows."""
    rows = [("view", "m/s"), ("click", "A"), ("error", "n"), ("purchase", "kW"), ("signup", "V"), ("silent", "K")]
    return spark.createDataFrame(rows, "topic string, unit string")


#: Sensors of each machine and their units.
MACHINE_SENSORS = (("voltage", "V"), ("cosphi", ""))


def machine_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltage and cosphi of each machine, one topic for each."""
    units = F.array(*[F.struct(F.lit(sensor).alias("sensor"), F.lit(unit).alias("unit")) for sensor, unit in MACHINE_SENSORS])
    return machines(spark, sf_dir).select("machine", F.inline(units)).withColumn("topic", F.concat_ws("/", "machine", "sensor"))


def machine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as metrics of the machines' sensors."""
    return machine_metrics_of(read(spark, sf_dir, "events"))


def machine_metrics_of(events: DataFrame) -> DataFrame:
    """The same of a table or stream of events."""
    long = snapshots_of(events).select("machine", "ts", "seq", F.expr("stack(2, 'voltage', voltage, 'cosphi', cosphi) AS (sensor, value)"))
    return long.select(F.concat_ws("/", "machine", "sensor").alias("topic"), "ts", "value", "seq")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_of(read(spark, sf_dir, "events"))


def snapshots_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").alias("machine"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), (330 + F.col("value") % 100).alias("voltage"), (k / 100).alias("cosphi")
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type").isin("purchase", "view"), "load").otherwise("dispense")
    return _events(spark, sf_dir).select(F.col("user_id").alias("machine"), F.col("event_id").alias("seq"), "ts", kind.alias("op"), F.col("value").alias("amount"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup stops the machine's session and starts the next; a click asks for one more start, which is ignored while
    a session is active."""
    e = _events(spark, sf_dir)
    none = F.lit(None)
    base = [F.col("user_id").alias("machine"), "ts"]
    rest = [none.cast("bigint").alias("session"), F.col("ts").alias("start"), none.cast("timestamp_ntz").alias("end")]
    signup = e.where("event_type = 'signup'")
    stop = signup.select(*base, (3 * F.col("event_id")).alias("seq"), F.lit("stop").alias("command"), none.cast("bigint").alias("session"), none.cast("timestamp_ntz").alias("start"), F.col("ts").alias("end"))
    start = signup.select(*base, (3 * F.col("event_id") + 1).alias("seq"), F.lit("add").alias("command"), *rest)
    again = e.where("event_type = 'click'").select(*base, (3 * F.col("event_id") + 2).alias("seq"), F.lit("add").alias("command"), *rest)
    return stop.unionByName(start).unionByName(again)


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("machine"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("shop"), F.lit(0.0).alias("initial"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shop"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("plant"))


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("plant"), F.col("r_name").alias("name"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.col("event_id")).alias("id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.to_json(F.struct(F.col("user_id").alias("machine"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("properties"),
        F.array("event_type").alias("labels"),
    )
