import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import sessions as S
from emberline.sources.scratch import scratch_folder
from emberline.streaming import run
from emberline.streaming import sessions as stream_sessions

T0 = datetime(2024, 1, 1)
COMMAND = "machine bigint, seq bigint, ts timestamp_ntz, command string, session bigint, start timestamp_ntz, end timestamp_ntz"


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def commands(spark, rows):
    """rows: (machine, seq, command, session, start, end) with seconds."""
    return spark.createDataFrame([(m, k, at(k), c, i, at(a), at(b)) for m, k, c, i, a, b in rows], COMMAND)


def folded(spark, rows):
    return {(r.session, r.seq): ((r.start - T0).total_seconds() if r.start else None, (r.end - T0).total_seconds() if r.end else None, r.change) for r in S.fold_commands(commands(spark, rows)).collect()}


def test_one_active_session_and_transitions(spark):
    rows = [
        (1, 1, "add", None, None, None), (1, 2, "add", None, 0, None), (1, 3, "stop", None, None, None), (1, 4, "stop", 1, None, None), (1, 5, "add", None, 4, None),
        (1, 6, "update", 5, 2, None), (1, 7, "update", 5, None, 7), (1, 8, "update", 5, 3, None), (1, 9, "add", None, 1, 2), (1, 10, "update", 99, 1, 1), (2, 11, "add", None, 0, 9), (2, 12, "add", None, None, 3),
    ]
    assert folded(spark, rows) == {
        (1, 1): (1, None, "started"), (1, 3): (1, 3, "completed"), (5, 5): (4, None, "started"), (5, 6): (2, None, "updated"), (5, 7): (2, 7, "completed"), (5, 8): (3, 7, "updated"),
        (9, 9): (1, 2, "completed"), (11, 11): (0, 9, "completed"), (12, 12): (None, 3, "completed"),
    }
    with pytest.raises(ValueError):
        S.MachineSessions().apply("melt", 1, T0)


def random_commands(seed, n=150):
    rng = random.Random(seed)
    return [(rng.randrange(4), k, rng.choice(["add", "stop", "update", "add"]), rng.choice([None, None, rng.randrange(n)]), rng.choice([None, k]), rng.choice([None, None, k + 5])) for k in range(n)]


def test_stream_equals_batch(spark):
    c = commands(spark, random_commands(3))
    folder = scratch_folder(spark)
    for part in (c.where("seq < 70"), c.where("seq >= 70")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with stream_sessions.stateful(spark):
        got = run.drain_appends(stream_sessions.fold_stream(stream))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, S.fold_commands(c).collect()), key=str)


def test_windows_equal_the_fold_for_starts_and_stops(spark):
    rows = [(m, k, c, None, None, None) for m, k, c, *_ in random_commands(5) if c != "update"]
    c = commands(spark, rows)
    by_fold = {tuple(r) for r in S.latest_sessions(S.fold_commands(c)).select("session", "machine", "start", "end").collect()}
    assert {tuple(r) for r in S.fold_starts_and_stops(c).select("session", "machine", "start", "end").collect()} == by_fold


def test_query_precedence(spark):
    rows = [(1, 1, "add", None, None, None), (1, 2, "stop", None, None, None), (1, 3, "add", None, None, None), (2, 4, "add", None, None, None)]
    changes = S.fold_commands(commands(spark, rows)).cache()
    now = S.latest_sessions(changes)
    ids = lambda df: sorted(r.session for r in df.collect())
    assert ids(S.query(now)) == [1] and ids(S.query(now, machine=1)) == [1, 3] and ids(S.query(now, session=4, machine=1)) == [4] and ids(S.query(now, session=9)) == []
    assert S.query(now, changes, stream=True, session=4).count() == 4
    with pytest.raises(ValueError):
        S.query(now, stream=True)


def test_states_at_end_now_and_any_time(spark):
    history = spark.createDataFrame([(1, k, at(k), w) for k, w in enumerate([10.0, 30.0, 25.0, 40.0])], "machine bigint, seq bigint, ts timestamp_ntz, weight double")
    machines = spark.createDataFrame([(1, 5.0)], "machine bigint, initial double")
    s = spark.createDataFrame([(7, 1, at(0), at(2)), (8, 1, at(-5), None)], "session bigint, machine bigint, start timestamp_ntz, end timestamp_ntz")
    now = F.lit(at(10)).cast("timestamp_ntz")
    get = lambda df: {r.session: (r.initial, r.weight, r.loaded, r.dispensed) for r in df.collect()}
    assert get(S.session_states(s, history, machines, now)) == {7: (10.0, 25.0, 20.0, 0.0), 8: (5.0, 40.0, 40.0, 5.0)}
    assert get(S.session_states(s, history, machines, now, F.lit(at(3)).cast("timestamp_ntz"))) == {7: (10.0, 40.0, 20.0, 5.0), 8: (5.0, 40.0, 25.0, 5.0)}


def test_late_commands_are_folded_in_their_own_order(spark):
    c = commands(spark, random_commands(4))
    folder, rng = scratch_folder(spark), random.Random(2)
    rows = c.collect()
    parts = [[r for r in rows if (r.seq + late[r.seq]) // 40 == k] for late in [{r.seq: rng.randrange(20) for r in rows}] for k in range(5)]
    for part in [*parts, [(-1, 10**6, T0 + timedelta(days=99), "add", None, None, None)]]:
        spark.createDataFrame(part, COMMAND).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with stream_sessions.stateful(spark):
        got = run.drain_appends(stream_sessions.fold_stream(stream, "60 seconds"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, S.fold_commands(c).collect()), key=str)


def test_a_batch_writes_the_sessions_that_it_changes(spark):
    """After 300 sessions of one machine, a batch with one command updates a few entries of the state."""
    folder = scratch_folder(spark)
    many = [(1, k, "add", None, k, k + 1) for k in range(300)]
    for part in (many, [(1, 300, "add", None, 300, None)], [(1, 301, "update", 7, 3, None)]):
        commands(spark, part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(folder)
    with stream_sessions.stateful(spark):
        query = stream_sessions.fold_stream(stream).writeStream.format("noop").option("checkpointLocation", scratch_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert len(updated) == 3 and updated[0] >= 300 and max(updated[1:]) <= 3


def test_a_logbook_is_written_by_calls_and_read_as_ledger_and_sessions(spark):
    from emberline.streaming.logbook import Logbook

    book = Logbook(spark, scratch_folder(spark))
    machines = spark.createDataFrame([(1, 100.0)], "machine bigint, initial double")
    book.load(1, 50.5, at(0))
    book.dispense(1, 10.0, at(1))
    book.reset(1, ts=at(2))
    session = book.start(1, ts=at(0)).first().seq
    book.start(1, ts=at(1))
    book.stop(1, end=at(5))
    book.update(1, session, start=at(-1))
    assert [(r.seq, r.weight) for r in book.history(machines).orderBy("seq").collect()] == [(0, 150.5), (1, 140.5), (2, 0.0)]
    assert [tuple(r) for r in book.sessions().collect()] == [(session, 1, at(-1), at(5))]
    with stream_sessions.stateful(spark):
        query = book.session_changes().writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", scratch_folder(spark)).start()
    query.processAllAvailable()
    book.start(1, ts=at(9))
    query.processAllAvailable()
    query.stop()
    assert [r.change for r in spark.table("changes").orderBy("seq").collect()] == ["started", "completed", "updated", "started"]


class CountedState:
    """Handle and state of a key in memory; counts accesses."""

    def __init__(self):
        self.calls, self.map, self.lists, self.values, self.timers = 0, {}, {}, {}, set()

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda state, *_: CountedVariable(self, state)
        raise AttributeError(name)

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


class CountedVariable:
    def __init__(self, owner, name):
        self.owner, self.rows = owner, {}

    def exists(self):
        self.owner.calls += 1
        return bool(self.rows)

    def getValue(self, key):  # noqa: N802
        self.owner.calls += 1
        return self.rows.get(key)

    containsKey = lambda self, key: self.getValue(key) is not None  # noqa: E731, N815

    def updateValue(self, key, value):  # noqa: N802
        self.owner.calls += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.owner.calls += 1
        self.rows.pop(key, None)

    def appendValue(self, value):  # noqa: N802
        self.updateValue(len(self.rows), value)

    def update(self, value):
        self.updateValue(0, value)

    def get(self):
        self.owner.calls += 1
        return iter(list(self.rows.values())) if 0 not in self.rows or isinstance(self.rows[0][0], bytes) else self.rows[0]

    def clear(self):
        self.owner.calls += 1
        self.rows.clear()


def command_frame(rows):
    """rows: (machine, seq, command, second)."""
    none = -(1 << 63)
    return pd.DataFrame([(m, k, c, s * 10**6, none, none, none, s * 1000) for m, k, c, s in rows], columns=["machine", "seq", "command", "ts", "session", "start", "end", "ms"])


def test_a_session_is_written_once_a_batch_and_machines_share_accesses():
    state, processor = CountedState(), stream_sessions.SessionProcessor()
    processor.init(state)
    first = [r for m in range(200) for r in ((m, 5 * m, "add", 1), (m, 5 * m + 1, "stop", 2), (m, 5 * m + 2, "add", 3))]
    made = pd.concat(list(processor.handleInputRows((0,), iter([command_frame(first)]), None)))
    assert len(made) == 600 and state.calls <= 200 + 10
    state.calls = 0
    made = pd.concat(list(processor.handleInputRows((0,), iter([command_frame([(m, 5 * m + 3, "stop", 9) for m in range(200)])]), None)))
    assert made["session"].tolist() == [5 * m + 2 for m in range(200)] and state.calls <= 200 + 10


def test_held_back_commands_are_read_and_written_at_once():
    state, processor = CountedState(), stream_sessions.LateSessionProcessor()
    processor.init(state)
    rows = [r for m in range(200) for r in ((m, 5 * m + 1, "stop", 8), (m, 5 * m, "add", 1), (m, 5 * m + 2, "add", 70))]
    for part in (rows[::2], rows[1::2]):
        assert list(processor.handleInputRows((0,), iter([command_frame(part)]), None)) == []
    assert state.timers == {1000}
    state.watermark = 9000
    made = pd.concat(list(processor.handleExpiredTimer((0,), state, None)))
    assert sorted(made["change"]) == ["completed"] * 200 + ["started"] * 200 and 70_000 in state.timers
    assert state.calls <= 200 + 40
