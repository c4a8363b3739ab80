"""Tables the engine reads and writes. Logs are append-only; a later row of an id replaces the earlier ones."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(columns: str) -> T.StructType:
    """A schema from "name kind, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


METRICS = _schema("topic string, ts timestamp_ntz, value double, seq bigint")
SENSOR = _schema("machine bigint, sensor string, topic string, unit string")
MEASUREMENT = _schema("timestamp timestamp_ntz, value double, unit string")
MACHINE = _schema("machine bigint, name string, shop int, initial double")
SHOP = _schema("shop int, name string, plant int")
OPERATION = _schema("machine bigint, seq bigint, ts timestamp_ntz, op string, amount double")
WEIGHT_HISTORY = _schema("machine bigint, seq bigint, ts timestamp_ntz, weight double")
COMMAND = _schema("machine bigint, seq bigint, ts timestamp_ntz, command string, session bigint, start timestamp_ntz, end timestamp_ntz")
SESSION_CHANGE = _schema("session bigint, seq bigint, machine bigint, start timestamp_ntz, end timestamp_ntz, change string")
EVENT = _schema("id string, seq bigint, ts timestamp_ntz, properties string, labels array<string>")
ALERT = _schema("id string, seq bigint, message string, ts timestamp_ntz, object string, event_id string, acknowledged boolean, change string")

#: Logs whose rows are numbered as they are appended, by their columns: what ids begin with, where rows have any.
ID_PREFIXES = {tuple(EVENT.names): "ev-", tuple(ALERT.names): "alert-", tuple(OPERATION.names): "", tuple(COMMAND.names): ""}
