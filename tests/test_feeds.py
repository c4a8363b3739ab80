import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import logs, metrics, rules
from emberline.sources.commits import CommitLog, put_if_absent
from emberline.sources.scratch import scratch_folder
from emberline.streaming.events import EventLog
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.monitor import FOLD, LatestValues, Monitor

T0 = datetime(2024, 1, 1)
RAW = "ts timestamp_ntz, properties string, labels array<string>"


def made(spark, *values):
    return spark.createDataFrame([(T0 + timedelta(seconds=v), '{"t": %d}' % v, ["x"]) for v in values], RAW)


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    return condition()


def test_a_commit_is_taken_by_one_writer(spark, tmp_path):
    logs_ = [CommitLog(spark, f"file://{tmp_path}/commits") for _ in range(4)]
    done = []

    def write(own):
        for k in range(5):
            done.append(own.add(lambda before: {"seen": len(before)}, f"{id(own)}:{k}"))

    threads = [threading.Thread(target=write, args=(x,)) for x in logs_]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(c["version"] for c, _ in done) == list(range(20)) and all(c["seen"] == c["version"] and new for c, new in done)
    again = CommitLog(spark, f"file://{tmp_path}/commits")
    assert again.add(lambda before: {}, done[3][0]["batch"]) == (done[3][0], False)
    assert not put_if_absent(spark, f"file://{tmp_path}/commits/{7:012d}.json", "no") and len(again.commits()) == 20


def test_two_programs_create_at_once_without_repeat_or_gap(spark):
    folder = scratch_folder(spark)
    log = lambda: EventLog(ChangeFeed(spark, f"{folder}/e", schemas.EVENT), ChangeFeed(spark, f"{folder}/a", schemas.ALERT))
    errors = []

    def create(n):
        try:
            log().create(made(spark, *range(n, n + 3)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=create, args=(10 * k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = ChangeFeed(spark, f"{folder}/e", schemas.EVENT).rows().orderBy("seq").collect()
    assert not errors and [r.id for r in rows] == [f"ev-{k}" for k in range(9)]
    for k in range(0, 9, 3):  # each append has its numbers in one piece, in its own order
        times = [(r.ts - T0).seconds for r in rows[k : k + 3]]
        assert times == list(range(times[0], times[0] + 3)) and times[0] % 10 == 0


def test_an_append_that_is_killed_leaves_no_trace(spark, monkeypatch):
    feed = ChangeFeed(spark, scratch_folder(spark), schemas.EVENT)
    feed.append(made(spark, 1))
    seen = []
    handle = feed.subscribe(lambda r: seen.append(r.id), only_new=False)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(CommitLog, "add", killed)
        feed.append(made(spark, 2, 3))
    assert [r.id for r in feed.rows().collect()] == ["ev-0"]
    feed.append(made(spark, 4))
    assert [r.id for r in feed.rows().orderBy("seq").collect()] == ["ev-0", "ev-1"] and wait_for(lambda: len(seen) == 2)
    time.sleep(0.5)
    handle.cancel()
    assert seen == ["ev-0", "ev-1"]


def test_a_batch_that_comes_again_changes_nothing(spark):
    feed = ChangeFeed(spark, scratch_folder(spark), schemas.EVENT)
    first = [r.id for r in feed.append(made(spark, 1, 2), "b:0").collect()]
    assert [r.id for r in feed.append(made(spark, 1, 2), "b:0").collect()] == first == ["ev-0", "ev-1"]
    given = spark.createDataFrame([("ev-0", 0, T0, "{}", [])], schemas.EVENT)
    feed.append(given)
    feed.append(made(spark, 3))
    assert sorted(r.id for r in feed.rows().collect()) == ["ev-0", "ev-0", "ev-1", "ev-2"]


def test_compaction_keeps_rows_numbers_and_subscribers(spark):
    feed, seen = ChangeFeed(spark, scratch_folder(spark), schemas.EVENT), []
    handle = feed.subscribe(lambda r: seen.append(r.id), name="s")
    for k in range(4):
        feed.append(made(spark, k))
    assert wait_for(lambda: len(seen) == 4)
    feed.compact(keep=1)
    feed.append(made(spark, 9))
    other = ChangeFeed(spark, feed.path, schemas.EVENT)
    assert sorted(r.id for r in other.rows().collect()) == [f"ev-{k}" for k in range(5)]
    assert len(other.log.commits()) == 3 and wait_for(lambda: len(seen) == 5)
    handle.cancel()
    assert seen == [f"ev-{k}" for k in range(5)]


def test_rules_in_a_stream_alert_once_though_a_batch_runs_again(spark, monkeypatch):
    """The stream is cut off after its alerts are committed and before its progress is; the batch runs again."""
    folder = scratch_folder(spark)
    rule = rules.Rule("hot", logs.property_of("t", "double") > 2, F.lit("Hot"), F.lit("m1"))
    log = EventLog(ChangeFeed(spark, f"{folder}/e", schemas.EVENT), ChangeFeed(spark, f"{folder}/a", schemas.ALERT), [rule])
    log.events.append(made(spark, 1, 3, 4))
    alert = EventLog._alert
    calls = []

    def cut(self, batch, name):
        alert(self, batch, name)
        calls.append(name)
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(EventLog, "_alert", cut)
        handle = log.watch("w")
        assert wait_for(lambda: not handle.active) and calls == ["w:0"]
    handle = log.watch("w")
    log.events.append(made(spark, 5))
    assert wait_for(lambda: log.alerts.rows().count() == 3)
    time.sleep(0.5)
    handle.cancel()
    assert sorted((r.id, r.event_id) for r in log.alerts.rows().collect()) == [("alert-0", "ev-1"), ("alert-1", "ev-2"), ("alert-2", "ev-3")]


def test_newest_values_follow_a_stream(spark, tmp_path):
    values = LatestValues(spark, scratch_folder(spark))
    rows = [(f"t{k % 3}", T0 + timedelta(seconds=k * 7 % 50), float(k), k) for k in range(120)]
    for n in range(3):
        spark.createDataFrame(rows[n::3], schemas.METRICS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schemas.METRICS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        values.follow(stream, drain=True)
        want = {tuple(r) for r in metrics.latest(spark.read.parquet(f"{tmp_path}/in")).collect()}
        assert {tuple(r) for r in metrics.latest(values.rows()).collect()} == want
    values.keep(spark.createDataFrame(rows[:3], schemas.METRICS), 2)  # a batch that was there


def test_a_tick_reads_as_much_after_a_long_history(spark):
    """Rows that are read for the newest values stay few while batches come in."""
    values, sizes = LatestValues(spark, scratch_folder(spark)), []
    for number in range(2 * FOLD + 2):
        rows = spark.range(2).select(F.concat(F.lit("t"), F.col("id")).alias("topic"), F.lit(T0 + timedelta(seconds=number)).cast("timestamp_ntz").alias("ts"), F.lit(float(number)).alias("value"), (F.col("id") + 2 * number).alias("seq"))
        values.keep(rows, number)
        sizes.append(values.rows().count())
    assert max(sizes) <= 2 * (FOLD + 1) and sizes[FOLD] <= 6
    assert {r.value for r in metrics.latest(values.rows()).collect()} == {float(2 * FOLD + 1)}


def test_machines_without_readings_alert_each_tick(spark):
    from emberline.plans.plant import Plant

    machines = spark.createDataFrame([(1, "m1", 0, 0.0), (2, "m2", 0, 0.0)], schemas.MACHINE)
    sensors = spark.createDataFrame([(m, s, f"{m}/{s}", "") for m in (1, 2) for s in ("voltage", "cosphi")], schemas.SENSOR)
    values = LatestValues(spark, scratch_folder(spark))
    values.keep(spark.createDataFrame([("1/voltage", T0, 380.0, 1), ("1/cosphi", T0, 0.9, 2)], schemas.METRICS), 0)
    plant = Plant(None, None, machines, sensors, None, None, None, None, None)
    feed = ChangeFeed(spark, scratch_folder(spark), schemas.ALERT)
    monitor = plant.monitor(feed, latest=values)
    assert isinstance(monitor, Monitor) and monitor.tick(F.lit(T0).cast("timestamp_ntz")) == 3
    values.keep(spark.createDataFrame([("2/voltage", T0, 380.0, 3), ("2/cosphi", T0, 0.75, 4)], schemas.METRICS), 1)
    assert monitor.tick(F.lit(T0).cast("timestamp_ntz")) == 1
    assert [(r.object, r.message) for r in feed.rows().orderBy("seq").collect()] == [("m2", "Critical low power factor: 0.00"), ("m2", "Critical low voltage: 0.0V"), ("m2", "Power quality issue detected"), ("m2", "Low power factor: 0.75")]
