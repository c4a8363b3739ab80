import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import metrics as M
from emberline.sources.scratch import scratch_folder
from emberline.streaming import run, tail
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.monitor import Monitor, RunOnce

T0 = datetime(2024, 1, 1)


def wait_for(condition, seconds=40):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    return condition()


def metrics(spark, n=250):
    return spark.createDataFrame([("a", T0 + timedelta(seconds=k // 90), float(k), k) for k in range(n)], schemas.METRICS)


def test_polled_tail_pages_everything_once(spark):
    df = metrics(spark).cache()
    t = tail.PolledTail(lambda: df, T0 - timedelta(seconds=1))
    pages = [t.poll() for _ in range(4)]
    assert [len(p) for p in pages] == [100, 100, 50, 0] and [r.seq for p in pages for r in p] == list(range(250))


def test_polling_runs_until_cancelled(spark):
    df, seen = metrics(spark, 30).cache(), []
    handle = tail.PolledTail(lambda: df, T0 - timedelta(seconds=1), limit=20).start(spark, 100, lambda r: seen.append(r.seq))
    assert wait_for(lambda: len(seen) == 30) and seen == list(range(30))
    handle.cancel()
    handle.cancel()
    assert not handle.active


def test_streamed_downsample_equals_batch(spark):
    df, folder = metrics(spark), scratch_folder(spark)
    df.repartition(3).write.parquet(folder)
    stream = tail.tail_files(spark, folder, df.schema, files_per_batch=1)
    got = run.drain_updates(tail.downsample_stream(stream, 2000), ["topic", "timestamp"]).orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in M.downsample(df, T0, T0 + timedelta(seconds=9), 2000).orderBy("timestamp").collect()]
    late = run.drain_appends(tail.after(tail.tail_files(spark, folder, df.schema), T0 + timedelta(seconds=1)))
    assert late.count() == 70


def test_feed_has_no_replay_and_isolates_failures(spark):
    feed = ChangeFeed(spark, scratch_folder(spark), schemas.SESSION_CHANGE)
    row = lambda k: spark.createDataFrame([(k, k, 1, T0, None, "started")], schemas.SESSION_CHANGE)
    feed.append(row(1))
    new, every, failing = [], [], []

    def fail(r):
        failing.append(r.session)
        raise RuntimeError("no")

    handles = [feed.subscribe(lambda r: new.append(r.session)), feed.subscribe(lambda r: every.append(r.session), only_new=False), feed.subscribe(fail)]
    feed.append(row(2))
    feed.append(row(3))
    assert wait_for(lambda: sorted(new) == [2, 3] and sorted(every) == [1, 2, 3] and sorted(failing) == [2, 3])
    for h in handles:
        h.cancel()
    feed.append(row(4))
    time.sleep(0.5)
    assert 4 not in new and feed.rows().count() == 4


def test_monitor_appends_alerts_each_tick_and_starts_once(spark):
    snapshot = spark.createDataFrame([("m1", 340.0, 0.9), ("m2", 380.0, 0.9)], "name string, voltage double, cosphi double")
    feed = ChangeFeed(spark, scratch_folder(spark), schemas.ALERT)
    monitor = Monitor(spark, lambda: snapshot, feed, period_ms=300)
    now = F.lit(T0).cast("timestamp_ntz")
    assert monitor.tick(now) == 1 and monitor.tick(now) == 1
    assert sorted((r.id, r.object, r.message) for r in feed.rows().collect()) == [("alert-0", "m1", "Critical low voltage: 340.0V"), ("alert-1", "m1", "Critical low voltage: 340.0V")]
    handle = monitor.init()
    assert monitor.init() is handle and wait_for(lambda: feed.rows().count() >= 3)
    handle.cancel()


def test_run_once():
    calls = []
    once = RunOnce(lambda: calls.append(1) or "started")
    assert once.init() == once.init() == "started" and calls == [1]


def test_ids_go_on_after_a_restart(spark):
    snapshot, folder = spark.createDataFrame([("m1", 340.0, 0.9)], "name string, voltage double, cosphi double"), scratch_folder(spark)
    for _ in range(2):
        Monitor(spark, lambda: snapshot, ChangeFeed(spark, folder, schemas.ALERT)).tick(F.lit(T0).cast("timestamp_ntz"))
    assert sorted(r.id for r in ChangeFeed(spark, folder, schemas.ALERT).rows().collect()) == ["alert-0", "alert-1"]


def test_named_subscriber_goes_on_after_a_restart(spark):
    folder = scratch_folder(spark)
    row = lambda k: spark.createDataFrame([(k, k, 1, T0, None, "started")], schemas.SESSION_CHANGE)
    ChangeFeed(spark, folder, schemas.SESSION_CHANGE).append(row(1))
    seen = []
    handle = ChangeFeed(spark, folder, schemas.SESSION_CHANGE).subscribe(lambda r: seen.append(r.session), name="a")
    feed = ChangeFeed(spark, folder, schemas.SESSION_CHANGE)
    feed.append(row(2))
    assert wait_for(lambda: seen == [2])
    time.sleep(2)  # for the batch to be marked as done; else it would be sent again
    handle.cancel()
    feed.append(row(3))  # while it is away
    handle = ChangeFeed(spark, folder, schemas.SESSION_CHANGE).subscribe(lambda r: seen.append(r.session), name="a")
    feed.append(row(4))
    assert wait_for(lambda: set(seen) == {2, 3, 4}) and 1 not in seen
    handle.cancel()


def test_created_events_are_sent_and_alert(spark):
    from emberline.operators import logs, rules
    from emberline.streaming.events import EventLog

    folder, seen = scratch_folder(spark), []
    feeds = lambda: (ChangeFeed(spark, f"{folder}/e", schemas.EVENT), ChangeFeed(spark, f"{folder}/a", schemas.ALERT))
    rule = rules.Rule("hot", logs.property_of("t", "double") > 9, F.lit("Hot"), F.lit("m1"))
    events, alerts = feeds()
    handle = alerts.subscribe(lambda r: seen.append((r.id, r.event_id)))
    made = lambda k: spark.createDataFrame([(T0 + timedelta(seconds=k), '{"t": %d}' % k, None)], "ts timestamp_ntz, properties string, labels array<string>")
    assert EventLog(events, alerts, [rule]).create(made(8)).count() == 0 and EventLog(events, alerts).create(made(20)).count() == 0
    assert [(r.id, r.event_id, r.message) for r in EventLog(*feeds(), [rule]).create(made(10)).collect()] == [("alert-0", "ev-2", "Hot")]
    assert wait_for(lambda: seen == [("alert-0", "ev-2")]) and events.rows().count() == 3
    handle.cancel()
