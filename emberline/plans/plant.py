"""The plant: dimensions, logs and sensors under one handle. It holds DataFrames, so every call sees the tables as they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators import ledger, logs, metrics, sessions
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.monitor import PERIOD_MS, LatestValues, Monitor


@dataclass
class Plant:
    plants: DataFrame
    shops: DataFrame
    machines: DataFrame
    sensors: DataFrame
    metrics: DataFrame
    operations: DataFrame
    commands: DataFrame
    events: DataFrame
    #: The alert log, or what makes it when it is first asked for.
    alerts: DataFrame | Callable[[], DataFrame]
    monitors: list[Monitor] = field(default_factory=list)

    def check_machines(self) -> DataFrame:
        """Machine ids or names that aren't unique; empty for a sound dimension."""
        by_id = self.machines.groupBy(F.col("machine").cast("string").alias("key")).count().where("count > 1")
        return by_id.unionByName(self.machines.groupBy(F.col("name").alias("key")).count().where("count > 1"))

    def monitor(self, alerts: ChangeFeed, period_ms: int = PERIOD_MS, latest: LatestValues | None = None) -> Monitor:
        """A monitor of all machines, which init() starts: each period the newest voltage and cosphi go through the
        threshold rules and into the alert log. A sensor without readings reads 0.

        latest: newest values that follow a stream of metrics; without them each period scans the metrics.
        """

        def snapshot() -> DataFrame:
            now = F.current_timestamp().cast("timestamp_ntz")
            known = self.readings(now, latest.rows() if latest is not None else None).groupBy("machine").pivot("sensor", ["voltage", "cosphi"]).agg(F.first("value"))
            return self.machines.select("machine", "name").join(known, "machine", "left")

        made = Monitor(self.machines.sparkSession, snapshot, alerts, period_ms)
        self.monitors.append(made)
        return made

    def init(self) -> list[object]:
        """Start all monitors, each once."""
        return [m.init() for m in self.monitors]

    def in_shop(self, shop: int) -> DataFrame:
        return self.machines.where(F.col("shop") == shop)

    def history(self) -> DataFrame:
        return ledger.weight_history(self.operations, self.machines)

    def readings(self, now: Column, rows: DataFrame | None = None) -> DataFrame:
        """machine, sensor, timestamp, value, unit for each sensor, over all metrics or other rows of that kind."""
        return metrics.latest_or_default(self.metrics if rows is None else rows, self.sensors, now).select("machine", "sensor", "timestamp", "value", "unit")

    def snapshot(self, now: Column, sensor_names: list[str]) -> DataFrame:
        return ledger.current_snapshot(self.history(), self.machines, self.readings(now), sensor_names)

    def chronology(self, query: str, probes: DataFrame | None = None, **options: object) -> DataFrame:
        """"current" takes readings and sensor_names, "point" and "range" take probes."""
        return ledger.chronology(self.history(), self.machines, query, probes, **options)

    def meltings(self, **options: object) -> DataFrame:
        changes = sessions.fold_commands(self.commands)
        return sessions.query(sessions.latest_sessions(changes), changes, **options)

    def melting_states(self, now: Column, at: Column | None = None) -> DataFrame:
        return sessions.session_states(sessions.latest_sessions(sessions.fold_commands(self.commands)), self.history(), self.machines, now, at)

    def machine_alerts(self, *filters: Column) -> DataFrame:
        log = self.alerts() if callable(self.alerts) else self.alerts
        return logs.alerts_of_machines(logs.every(logs.latest_version(log), *filters), self.machines)

    def rollup(self) -> DataFrame:
        """For each plant and shop: machines, operations, and what was loaded and dispensed."""
        o = self.operations
        amount = F.col("amount").cast(ledger.EXACT)
        zero = F.lit(0).cast(ledger.EXACT)
        by_machine = o.groupBy("machine").agg(
            F.count("*").alias("operations"), F.sum(F.when(F.col("op") == "load", amount).otherwise(zero)).alias("loaded"), F.sum(F.when(F.col("op") == "dispense", amount).otherwise(zero)).alias("dispensed")
        )
        known = self.machines.join(by_machine, "machine", "left").join(self.shops.select("shop", "plant"), "shop")
        total = lambda c: F.coalesce(F.sum(c), zero).cast("double").alias(c)
        return known.groupBy("plant", "shop").agg(F.count("*").alias("machines"), F.coalesce(F.sum("operations"), F.lit(0)).alias("operations"), total("loaded"), total("dispensed"))


def plant_from(read: Callable[[str], DataFrame]) -> Plant:
    """A plant whose tables are read by name."""
    return Plant(*[read(n) for n in ("plants", "shops", "machines", "sensors", "metrics", "operations", "commands", "events", "alerts")])
