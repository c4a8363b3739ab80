from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from emberline.functions.numbers import to_fixed
from emberline.operators import logs as G
from emberline.operators import rules as R

T0 = datetime(2024, 1, 1)


def test_fixed_point_rounds_the_exact_value(spark):
    values = [340.25, 349.95, 0.125, 0.375, 1.005, 0.7, 400.05, 2.5, -340.25, -0.06, 0.0, 123.456] + [k / 8 for k in range(1, 60)] + [300 + k / 20 for k in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", to_fixed(F.col("v"), 1).alias("one"), to_fixed(F.col("v"), 2).alias("two"))
    for r in df.collect():
        assert Decimal(r.one) == Decimal(r.v).quantize(Decimal("0.1"), ROUND_HALF_UP) and Decimal(r.two) == Decimal(r.v).quantize(Decimal("0.01"), ROUND_HALF_UP)
    with pytest.raises(ValueError):
        to_fixed(F.col("v"), 3)


CASES = [
    ((349.99, 0.9), ["Critical low voltage: 350.0V"]), ((350.0, 0.9), ["Low voltage: 350.0V"]), ((360.0, 0.9), []), ((400.0, 0.9), []), ((400.5, 0.9), ["High voltage: 400.5V"]),
    ((410.0, 0.9), ["High voltage: 410.0V"]), ((410.1, 0.9), ["Critical high voltage: 410.1V"]), ((380.0, 0.69), ["Critical low power factor: 0.69"]), ((380.0, 0.7), ["Low power factor: 0.70"]),
    ((380.0, 0.8), []), ((365.0, 0.75), ["Low power factor: 0.75", "Power quality issue detected"]), ((370.0, 0.75), ["Low power factor: 0.75"]), ((None, 0.6), ["Critical low power factor: 0.60"]),
    ((340.0, None), ["Critical low voltage: 340.0V"]), ((None, None), []), ((float("nan"), float("nan")), []), ((0.0, 0.0), ["Critical low voltage: 0.0V", "Critical low power factor: 0.00", "Power quality issue detected"]),
]


def test_threshold_table(spark):
    df = spark.createDataFrame([(k, *v) for k, (v, _) in enumerate(CASES)], "k int, voltage double, cosphi double")
    got = {}
    for r in R.threshold_issues(df).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.message)
    assert [got.get(k, []) for k in range(len(CASES))] == [m for _, m in CASES]
    assert R.threshold_issues(df, suppress=F.col("voltage") == 0).where("k = 16").count() == 0


def events(spark):
    rows = [(T0, '{"machine": "m1", "value": 2}', ["keep", "x"]), (T0, '{"machine": "m2", "value": "no"}', None), (T0, None, [])]
    return G.create_events(spark.createDataFrame(rows, "ts timestamp_ntz, properties string, labels array<string>"), start=5, order_by=["properties"])


def test_event_log_filters(spark):
    log = events(spark)
    assert sorted((r.id, r.labels) for r in log.collect()) == [("ev-5", []), ("ev-6", ["keep", "x"]), ("ev-7", [])]
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(G.every(log)) == ["ev-5", "ev-6", "ev-7"] and ids(G.every(log, G.has_label("keep"), G.property_of("value", "int") > 1)) == ["ev-6"]
    assert ids(G.every(log, G.has_label("keep"), G.property_of("value", "int") > 2)) == [] and ids(G.find(log, "ev-7")) == ["ev-7"] and ids(G.find(log, "ev-9")) == []


def test_rules_fire_in_order_and_lead_to_alerts(spark):
    log = events(spark)
    rules = [R.Rule("all", F.lit(True), F.lit("seen"), F.lit("o")), R.Rule("null", G.property_of("value", "int") > 1, F.concat(F.lit("v on "), F.get_json_object("properties", "$.machine")), F.get_json_object("properties", "$.machine"))]
    fired = R.evaluate(log, rules).orderBy("seq", "place").collect()
    assert [(r.id, r.rule, r.place) for r in fired] == [("ev-5", "all", 0), ("ev-6", "all", 0), ("ev-6", "null", 1), ("ev-7", "all", 0)]
    alerts = G.trigger_alerts(R.alerts_from_events(log, rules), order_by=["event_id", "place"])
    assert [(r.id, r.message, r.event_id) for r in alerts.orderBy("seq").collect()][2] == ("alert-2", "v on m1", "ev-6")
    done = G.acknowledge(alerts, spark.createDataFrame([("alert-2",), ("none",)], "id string"))
    twice = G.acknowledge(alerts.unionByName(done), spark.createDataFrame([("alert-2",)], "id string"))
    latest = G.latest_version(alerts.unionByName(done).unionByName(twice)).orderBy("seq").collect()
    assert [(r.id, r.acknowledged, r.event_id) for r in latest] == [("alert-0", False, "ev-5"), ("alert-1", False, "ev-6"), ("alert-2", True, "ev-6"), ("alert-3", False, "ev-7")]
    assert done.count() == twice.count() == 1
    machines = spark.createDataFrame([(1, "m1"), (2, "m2")], "machine bigint, name string")
    assert [r.machine for r in G.alerts_of_machines(alerts, machines).collect()] == [1]
    assert G.with_source_event(G.trigger_alerts(spark.createDataFrame([("m", T0, "o")], "message string, ts timestamp_ntz, object string")), log).first().event is None
    with pytest.raises(ValueError):
        R.evaluate(log, [])


def test_sequence_numbers_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert sorted((r.x, r.seq) for r in G.with_sequence(df, ["x"], start=3).collect()) == [(k, k + 3) for k in range(1000)]
