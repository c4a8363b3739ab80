"""Rules: the threshold engine over snapshots, and named predicates with messages over any rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numbers import above, below, to_fixed

# Limits and messages of the threshold engine. The first limit that holds in a chain gives the issue.
VOLTAGE = ((below, 350.0, "Critical low voltage: "), (below, 360.0, "Low voltage: "), (above, 410.0, "Critical high voltage: "), (above, 400.0, "High voltage: "))
COSPHI = ((below, 0.7, "Critical low power factor: "), (below, 0.8, "Low power factor: "))
QUALITY_VOLTAGE, QUALITY_COSPHI, QUALITY = 370.0, 0.8, "Power quality issue detected"


class Rule(NamedTuple):
    """Where `when` is true, an alert with this message on this object."""

    name: str
    when: Column
    message: Column
    object: Column


def _chain(value: Column, limits: Sequence[tuple], text: Column) -> Column:
    out = F.lit(None).cast("string")
    for holds, limit, message in reversed(limits):
        out = F.when(holds(value, limit), F.concat(F.lit(message), text)).otherwise(out)
    return out


def threshold_issues(snapshots: DataFrame, voltage: str = "voltage", cosphi: str = "cosphi", suppress: Column | None = None) -> DataFrame:
    """snapshots with place and message of each issue: 0 to 3 rows for each, in the order voltage, cosphi, both.

    A null or NaN reading skips its checks. `suppress` marks rows without issues, such as those of sensors that have
    no data and so read 0.
    """
    v, c = F.col(voltage), F.col(cosphi)
    messages = F.array(
        _chain(v, VOLTAGE, F.concat(to_fixed(v, 1), F.lit("V"))),
        _chain(c, COSPHI, to_fixed(c, 2)),
        F.when(below(v, QUALITY_VOLTAGE) & below(c, QUALITY_COSPHI), F.lit(QUALITY)),
    )
    rows = snapshots if suppress is None else snapshots.where(~F.coalesce(suppress, F.lit(False)))
    return rows.select("*", F.posexplode(messages).alias("place", "message")).where("message is not null")


def evaluate(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with place, rule, message and object for each rule that fires, in list order; no rule ends the list."""
    if not rules:
        raise ValueError("no rules")
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.when, F.lit(False)).alias("fired"), r.message.cast("string").alias("message"), r.object.cast("string").alias("object")) for r in rules])
    fired = rows.select("*", F.posexplode(each).alias("place", "_r")).where("_r.fired")
    return fired.select(*rows.columns, "place", "_r.rule", "_r.message", "_r.object")


def alerts_from_events(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """message, ts, object and event_id of each rule that an event fires: input of trigger_alerts."""
    return evaluate(events, rules).select("message", "ts", "object", F.col("id").alias("event_id"), "place")
