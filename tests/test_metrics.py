from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import metrics as M
from emberline.sources.metrics import keep_last, metrics_from, read_jdbc, read_parquet, write_metrics

T0 = datetime(2024, 1, 1)
SHAPE = "topic string, ts timestamp_ntz, value double, seq bigint"


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [("a", T0 + timedelta(seconds=s), float(s), k) for k, s in enumerate([0, 1, 59, 60, 61, 125, 180, 185])] + [("b", T0 + timedelta(seconds=30), 7.0, 90)]
    return spark.createDataFrame(rows, SHAPE).cache()


def buckets(df, topic="a"):
    return [((r.timestamp - T0).total_seconds(), r.value) for r in df.where(F.col("topic") == topic).orderBy("timestamp").collect()]


def test_downsample_averages_skips_empty_buckets_and_keeps_the_last_whole(metrics):
    end = T0 + timedelta(seconds=181)
    assert buckets(M.downsample(metrics, T0 + timedelta(seconds=30), end, 60_000)) == [(0, 20.0), (60, 60.5), (120, 125.0), (180, 182.5)]
    assert buckets(M.downsample(metrics, T0 + timedelta(seconds=30), end, 60_000, clip_end=True))[-1] == (180, 180.0)
    assert buckets(M.downsample(metrics, T0, end, 60_000), "b") == [(0, 7.0)]


@pytest.mark.parametrize(("step", "seconds"), [(1, 1), (999, 1), (1999, 1), (2000, 2), (604_800_000, 604_800)])
def test_steps_are_whole_seconds(step, seconds):
    assert M.step_seconds(step) == seconds


@pytest.mark.parametrize("step", [None, "60", float("nan"), True])
def test_bad_steps_are_refused(step):
    with pytest.raises(ValueError):
        M.step_seconds(step)


@pytest.mark.parametrize("width", [1, 7, 60, 604_800])
def test_buckets_count_from_1970(spark, width):
    at = datetime(2024, 3, 5, 13, 7, 11)
    df = spark.createDataFrame([("a", at, 1.0, 0)], SHAPE)
    assert M.downsample(df, at, at, width * 1000).first().timestamp == M.bucket_start(at, width)
    assert M.bucket_start(datetime(1969, 12, 31, 23, 59, 59), 60) == datetime(1969, 12, 31, 23, 59)


def test_filters_reach_the_scan(spark, metrics, tmp_path):
    metrics.write.parquet(str(tmp_path / "m"))
    df = M.of_topic(M.measurements(read_parquet(spark, str(tmp_path / "m")), T0, T0 + timedelta(seconds=59)), "a").select("value")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "IsNotNull(topic)" in plan and "ReadSchema: struct<topic:string,ts:timestamp_ntz,value:double>" in plan
    assert sorted(r.value for r in df.collect()) == [0.0, 1.0, 59.0]


def test_latest_and_defaults(spark, metrics):
    tie = metrics.unionByName(spark.createDataFrame([("a", T0 + timedelta(seconds=185), 1.5, 91)], SHAPE))
    assert {r.topic: r.value for r in M.latest(tie).collect()} == {"a": 1.5, "b": 7.0}
    sensors = spark.createDataFrame([("a", "V"), ("z", "K")], "topic string, unit string")
    got = {r.topic: (r.timestamp, r.value, r.unit) for r in M.latest_or_default(metrics, sensors, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got == {"a": (T0 + timedelta(seconds=185), 185.0, "V"), "z": (T0, 0.0, "K")}
    assert {r.unit for r in M.with_unit(metrics, sensors).collect()} == {"V", None} and {r.unit for r in M.with_unit(metrics, unit="A").collect()} == {"A"}


def test_cursor_pages_lose_nothing_at_equal_times(spark):
    rows = [("a", T0 + timedelta(seconds=k // 90), float(k), k) for k in range(250)]
    df = spark.createDataFrame(rows, SHAPE)
    seen, at, seq = [], T0 - timedelta(seconds=1), None
    while page := M.cursor_page(df, at, seq).collect():
        seen += [r.seq for r in page]
        at, seq = page[-1].ts, page[-1].seq
    assert seen == list(range(250))
    assert M.cursor_page(df, T0).first().seq == 90  # a bare cursor is strict


def test_table_layout_and_overwriting_store(spark, metrics, tmp_path):
    write_metrics(metrics, str(tmp_path / "t"))
    assert metrics_from(spark.read.parquet(str(tmp_path / "t"))).count() == 9
    doubled = metrics.unionByName(metrics.withColumns({"seq": F.col("seq") + 100, "value": F.col("value") + 1}))
    assert keep_last(doubled).count() == 9 and keep_last(doubled).agg(F.min("seq")).first()[0] == 100


def test_a_database_is_read_in_ranges(spark, metrics):
    url, options = "jdbc:derby:memory:metrics;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    timed = metrics.withColumn("ts", F.col("ts").cast("timestamp"))
    timed.write.format("jdbc").options(url=url, dbtable="metrics", createTableColumnTypes="topic varchar(64)", **options).mode("overwrite").save()
    key = lambda df: sorted((r.topic, r.ts, r.value) for r in df.collect())
    whole = read_jdbc(spark, url, "metrics", seq="seq", **options)
    assert key(whole) == key(metrics) and sorted(r.seq for r in whole.collect()) == sorted(r.seq for r in metrics.collect())
    split = read_jdbc(spark, url, "metrics", 4, (str(T0), str(T0 + timedelta(seconds=200))), **options)
    assert split.rdd.getNumPartitions() == 4 and key(split) == key(metrics) and split.select("seq").distinct().count() == 9
    plan = M.of_topic(whole, "a")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(topic), *EqualTo(topic,a)]" in plan
    assert [r.seq for r in M.cursor_page(whole, T0 + timedelta(seconds=60), limit=3).collect()] == [4, 5, 6]


def test_results_come_in_order_when_asked_for(spark, metrics):
    end = T0 + timedelta(seconds=300)
    rows = M.downsample(metrics.repartition(5), T0, end, 60_000, ordered=True).collect()
    assert [(r.topic, r.timestamp) for r in rows] == sorted((r.topic, r.timestamp) for r in rows) and len(rows) == 5
    for ascending in (True, False):
        times = [r.timestamp for r in M.measurements(metrics.repartition(5), T0, end, ascending=ascending).collect()]
        assert times == sorted(times, reverse=not ascending) and len(times) == 9
    tie = spark.createDataFrame([("a", T0, float(k), k) for k in (3, 1, 2)], SHAPE)
    assert [r.seq for r in M.measurements(tie, T0, end, ascending=False).collect()] == [1, 2, 3]
