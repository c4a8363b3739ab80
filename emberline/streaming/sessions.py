"""The session fold over a stream of commands: the same state machine as in batch, kept by machine in the state store.

The store has an entry for each completed session, so that a batch reads and writes the sessions that its commands touch,
whatever the machine's history. Machines are dealt out to a fixed number of buckets, whose rows of a batch are taken in one
call: each call and each access to the store takes longer than a command does. So a call writes a session once, however
many commands touch it, and a bucket's active sessions and held back commands are kept as packed tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators.sessions import CHANGE_SHAPE, MachineSessions
from emberline.streaming.run import settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of machines that share a call. The number belongs to a query's checkpoint.
BUCKETS = 1024
#: Stands for null among whole numbers; as a time, it is NaT.
NONE = -(1 << 63)


def bucket_of(machine: str) -> Column:
    return F.pmod(F.xxhash64(machine), F.lit(BUCKETS))


def _tuples(rows: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    return zip(*[rows[c].tolist() for c in columns])


def _value(number: int) -> int | None:
    return None if number == NONE else number


def _number(value: int | None) -> int:
    return NONE if value is None else value


class PackedRows:
    """Rows of a key, as tables in a list of the state: a row costs little where an access to the state costs much."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getListState(name, "rows binary")

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            self.state.appendValue((sink.getvalue().to_pybytes(),))

    def get(self) -> pd.DataFrame | None:
        """All rows in the order in which they came."""
        parts = [pa.ipc.open_stream(bytes(held)).read_pandas() for (held,) in self.state.get()]
        return pd.concat(parts, ignore_index=True) if parts else None

    def replace(self, rows: pd.DataFrame) -> None:
        self.state.clear()
        self.add(rows)


class FirstTimer:
    """One timer for each key, at the first of the times that it is asked for."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.due = handle, handle.getValueState("due", "ms bigint")

    def at_latest(self, ms: int) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def expired(self) -> None:
        self.due.clear()


class StoredSessions:
    """Sessions of a machine, by their numbers: looked up in the state store once, changes kept until they are written."""

    def __init__(self, state: object, machine: int, stored: bool, active: tuple | None) -> None:
        self.state, self.machine, self.stored = state, machine, stored
        self.known: dict[int, tuple[int | None, int | None] | None] = {} if active is None else {active[0]: active[1:]}
        self.changed = set(self.known)

    def _find(self, key: int) -> tuple[int | None, int | None] | None:
        if key not in self.known:
            found = self.state.getValue((self.machine, key)) if self.stored else None
            self.known[key] = None if found is None else tuple(found)
        return self.known[key]

    def __contains__(self, key: int | None) -> bool:
        return key is not None and self._find(key) is not None

    def __getitem__(self, key: int) -> tuple[int | None, int | None]:
        return self._find(key)

    def __setitem__(self, key: int, row: tuple[int | None, int | None]) -> None:
        self.known[key] = row
        self.changed.add(key)

    def write(self, active: int | None) -> None:
        for key in self.changed - {active}:
            self.state.updateValue((self.machine, key), self.known[key])


class SessionProcessor(StatefulProcessor):
    """Applies the commands of each batch, by seq. Times are microseconds here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "machine bigint, session bigint", "start bigint, end bigint")
        self.active = PackedRows(handle, "active")

    def changes(self, commands: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What commands (machine, seq, command, ts, session, start, end) change."""
        if not len(commands):
            return
        commands = commands.sort_values("seq", kind="stable")
        held = self.active.get()
        active = {} if held is None else {r[0]: (r[1], _value(r[2]), None) for r in _tuples(held, ["machine", "session", "start"])}
        before, stored, folds, out = dict(active), self.sessions.exists(), {}, []
        for machine, seq, command, *rest in _tuples(commands, ["machine", "seq", "command", "ts", "session", "start", "end"]):
            fold = folds.get(machine)
            if fold is None:
                was = active.get(machine)
                fold = folds[machine] = MachineSessions(StoredSessions(self.sessions, machine, stored, was), was[0] if was else None)
            change = fold.apply(command, seq, *map(_value, rest))
            if change:
                key, start, end, kind = change
                out.append((key, seq, machine, _number(start), _number(end), kind))
        for machine, fold in folds.items():
            fold.sessions.write(fold.active)
            active.pop(machine, None)
            if fold.active is not None:
                active[machine] = (fold.active, *fold.sessions[fold.active])
        if active != before:
            self.active.replace(pd.DataFrame([(m, key, _number(start)) for m, (key, start, _) in active.items()], columns=["machine", "session", "start"], dtype="int64"))
        if out:
            session, seq, machine, start, end, kind = zip(*out)
            times = {n: np.array(x, "int64").view("datetime64[us]") for n, x in (("start", start), ("end", end))}
            yield pd.DataFrame({"session": np.array(session, "int64"), "seq": np.array(seq, "int64"), "machine": np.array(machine, "int64"), **times, "change": kind})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.changes(pd.concat(list(rows)))

    def close(self) -> None:
        pass


class LateSessionProcessor(SessionProcessor):
    """Holds commands back until the watermark has passed their time, and applies by seq those that it has passed.

    What is held back is read and written whole: it is as much as comes within the lateness, whatever the history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting, self.timer = PackedRows(handle, "waiting"), FirstTimer(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        commands = pd.concat(list(rows)).drop(columns="bucket", errors="ignore")
        self.waiting.add(commands)
        self.timer.at_latest(int(commands["ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # of a command that came again, the later one
        waiting = self.waiting.get().drop_duplicates(["machine", "seq"], keep="last")
        due = waiting["ms"] <= timerValues.getCurrentWatermarkInMs()
        rest = waiting[~due]
        self.waiting.replace(rest)
        self.timer.expired()
        if len(rest):
            self.timer.at_latest(int(rest["ms"].min()))
        yield from self.changes(waiting[due])


def fold_stream(commands: DataFrame, lateness: str | None = None) -> DataFrame:
    """Change rows of a stream of commands. Start the query under `stateful` settings.

    Commands are applied as they come, those of a batch by seq. With a lateness ("2 hours") they may come in any order
    within it: a command is held back until nothing before its time is waited for; one that is later still is dropped.
    """
    timed = commands.withColumn("_at", F.col("ts").cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark("_at", lateness)
    number = lambda x, name: F.coalesce(x, F.lit(NONE)).alias(name)
    micros = lambda c: number(F.unix_micros(F.col(c).cast("timestamp")), c)
    dealt = timed.select(bucket_of("machine").alias("bucket"), "_at", "machine", "seq", "command", micros("ts"), number("session", "session"), micros("start"), micros("end"), number(F.unix_millis("_at"), "ms"))
    if lateness is None:
        return dealt.drop("_at").groupBy("bucket").transformWithStateInPandas(SessionProcessor(), CHANGE_SHAPE, "Append", "none")
    return dealt.groupBy("bucket").transformWithStateInPandas(LateSessionProcessor(), CHANGE_SHAPE, "Append", "eventTime")


def stateful(spark: SparkSession) -> AbstractContextManager:
    """Settings under which a query with fold_stream starts: its state needs the RocksDB store, whose changes alone are
    written with each batch."""
    return settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true")
