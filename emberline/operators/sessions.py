"""Melting sessions as change rows: the command fold, latest versions, queries and states.

A machine has at most one active session: while it has one, further starts are ignored. A session is named by the
number (seq) of the command that made it. Commands that name a session which isn't there are ignored, as are stops of
completed sessions.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ledger import states

STARTED, UPDATED, COMPLETED = "started", "updated", "completed"
CHANGE_SHAPE = "session bigint, seq bigint, machine bigint, start timestamp_ntz, end timestamp_ntz, change string"


class MachineSessions:
    """Sessions of one machine: applies commands in order. Batch and streaming fold share it.

    sessions holds start and end by session: a dict, or what looks them up in a state store one by one. active: the session
    that has no end, if there is one.
    """

    def __init__(self, sessions: MutableMapping[int, tuple[datetime | None, datetime | None]] | None = None, active: int | None = None) -> None:
        self.sessions = {} if sessions is None else sessions
        self.active = active

    def apply(self, command: str, seq: int, ts: datetime, session: int | None = None, start: datetime | None = None, end: datetime | None = None) -> tuple[int, datetime | None, datetime | None, str] | None:
        """The change (session, start, end, kind) that a command makes, if any."""
        if command == "add":
            if end is None and self.active is not None:
                return None
            key, row, change = seq, (start if start is not None or end is not None else ts, end), STARTED if end is None else COMPLETED
        elif command in ("stop", "update"):
            key = self.active if session is None else session
            if key not in self.sessions:
                return None
            old_start, old_end = self.sessions[key]
            if command == "stop":
                if old_end is not None:
                    return None
                row, change = (old_start, end if end is not None else ts), COMPLETED
            else:
                row = (start if start is not None else old_start, end if end is not None else old_end)
                change = UPDATED if old_end is not None or row[1] is None else COMPLETED
        else:
            raise ValueError(f"unknown command {command!r}")
        self.sessions[key] = row
        if row[1] is None:
            self.active = key
        elif self.active == key:
            self.active = None
        return key, *row, change


def fold_commands(commands: DataFrame) -> DataFrame:
    """Change rows of all commands (machine, seq, ts, command, session, start, end).

    Machines are dealt out once and sorted by command; a task streams through its rows and holds one machine's
    sessions at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, state = None, MachineSessions()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["machine"] != machine:
                    machine, state = r["machine"], MachineSessions()
                change = state.apply(r["command"], r["seq"], r["ts"], r["session"], r["start"], r["end"])
                if change:
                    out.append((change[0], r["seq"], machine, *change[1:]))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["session", "seq", "machine", "start", "end", "change"])

    rows = commands.select("machine", "seq", "ts", "command", "session", "start", "end")
    return rows.repartition("machine").sortWithinPartitions("machine", "seq").mapInArrow(fold, CHANGE_SHAPE)


def fold_starts_and_stops(commands: DataFrame) -> DataFrame:
    """Sessions of plain starts and stops, without updates, by windows alone: a start counts if the machine's last
    command was a stop or none; it ends at the stop that comes next."""
    in_order = Window.partitionBy("machine").orderBy("seq")
    turns = commands.where(F.col("command").isin("add", "stop")).withColumn("_last", F.lag("command").over(in_order))
    turns = turns.where((F.col("command") == "add") & (F.coalesce("_last", F.lit("stop")) == "stop") | (F.col("command") == "stop") & (F.col("_last") == "add"))
    ended = turns.withColumn("_end", F.lead(F.coalesce("end", "ts")).over(in_order)).where("command = 'add'")
    return ended.select(F.col("seq").alias("session"), "machine", F.coalesce("start", "ts").alias("start"), F.col("_end").alias("end"))


def latest_sessions(changes: DataFrame) -> DataFrame:
    """The newest version of each session: session, machine, start, end."""
    newest = F.max_by(F.struct("machine", "start", "end"), "seq")
    return changes.groupBy("session").agg(newest.alias("_v")).select("session", "_v.machine", "_v.start", "_v.end")


def query(sessions: DataFrame, changes: DataFrame | None = None, stream: bool = False, session: int | None = None, machine: int | None = None) -> DataFrame:
    """Options don't combine: the change rows if stream, else one session, else one machine's, else the completed ones."""
    if stream:
        if changes is None:
            raise ValueError("stream needs the change rows")
        return changes
    if session is not None:
        return sessions.where(F.col("session") == session)
    if machine is not None:
        return sessions.where(F.col("machine") == machine)
    return sessions.where(F.col("end").isNotNull())


def session_states(sessions: DataFrame, history: DataFrame, machines: DataFrame, now: Column, at: Column | None = None) -> DataFrame:
    """sessions with initial (weight at start), weight, loaded and dispensed at `at`, else the end, else `now`.

    A given `at` isn't held within the session. Weight includes entries at that time, the sums don't.
    """
    asked = sessions.withColumn("_at", F.coalesce(*([at] if at is not None else []), "end", now))
    probes = asked.select(F.col("session").alias("probe"), "machine", F.col("start").alias("from"), F.col("_at").alias("to"))
    known = states(history, probes, machines).select(F.col("probe").alias("session"), "initial", "weight", "loaded", "dispensed")
    return asked.join(known, "session").drop("_at")
