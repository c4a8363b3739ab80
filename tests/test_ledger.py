import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import ledger as L

T0 = datetime(2024, 1, 1)
HISTORY = "machine bigint, seq bigint, ts timestamp_ntz, weight double"
MACHINES = "machine bigint, initial double"
RANGES = "probe bigint, machine bigint, `from` timestamp_ntz, `to` timestamp_ntz"


def at(s):
    return None if s is None else T0 + timedelta(days=s)


def point(entries, initial, t):
    """Last inserted entry with ts <= t."""
    if t is None:
        return initial
    return next((w for s, w in reversed(entries) if s <= t), initial)


def ranged(entries, initial, a, b):
    if a is None or b is None:
        return 0.0, 0.0
    level, into, out = point(entries, initial, a), 0.0, 0.0
    for s, w in entries:
        if a <= s < b:
            into, out, level = into + max(w - level, 0), out + max(level - w, 0), w
    return into, out


def tables(spark, entries, initial):
    rows = [(m, k, at(s), w) for m, es in entries.items() for k, (s, w) in enumerate(es)]
    return spark.createDataFrame(rows, HISTORY), spark.createDataFrame(list(initial.items()), MACHINES)


@pytest.mark.parametrize("stretch", [1000, 3])
def test_random_ledgers_match_a_walk(spark, stretch):
    rng = random.Random(7)
    entries = {m: [(rng.randrange(12), float(rng.randrange(0, 500, 10))) for _ in range(rng.randrange(12))] for m in range(6)}
    initial = {m: float(m * 50) for m in range(6)}
    history, machines = tables(spark, entries, initial)
    probes = [(k, rng.randrange(6), rng.choice([None, *range(-2, 14)]), rng.choice([None, *range(-2, 14)])) for k in range(200)]
    p = spark.createDataFrame([(k, m, at(a), at(b)) for k, m, a, b in probes], RANGES)
    got = {r.probe: r.weight for r in L.weight_at(history, p, machines, "from", block_days=stretch).collect()}
    assert got == {k: point(entries[m], initial[m], a) for k, m, a, _ in probes}
    got = {r.probe: (r.loaded, r.dispensed) for r in L.range_summary(history, p, machines).collect()}
    assert got == {k: ranged(entries[m], initial[m], a, b) for k, m, a, b in probes}


@pytest.mark.parametrize(("block", "ties"), [(1, False), (3, True), (L.BLOCK_ENTRIES, True)])
def test_states_of_ledgers_in_order_match_a_walk(spark, block, ties):
    rng = random.Random(block)
    entries = {m: [(s // 3 if ties else s, float(rng.randrange(0, 500, 10))) for s in sorted(rng.sample(range(30), rng.randrange(14)))] for m in range(8)}
    entries[8] = [(5, 10.0), (3, 70.0), (4, 20.0)]  # out of order, beside the others
    initial = {m: float(m * 50) for m in range(9)}
    history, machines = tables(spark, entries, initial)
    probes = [(k % 300, k // 300, *(rng.choice([None, *range(-2, 31), 2.5, 7.5]) for _ in range(2))) for k in range(2700)]
    p = spark.createDataFrame([(k, m, at(a), at(b)) for k, m, a, b in probes], RANGES)
    got = {(r.probe, r.machine): (r.initial, r.weight, r.loaded, r.dispensed) for r in L.states(history, p, machines, block=block, block_days=4).collect()}
    assert got == {(k, m): (point(entries[m], initial[m], a), point(entries[m], initial[m], b), *ranged(entries[m], initial[m], a, b)) for k, m, a, b in probes}


@pytest.mark.parametrize("fan_out", [2, 5, 64])
def test_late_entries_match_a_walk(spark, monkeypatch, fan_out):
    """Ledgers with one late entry, with some, and in no order at all, under trees of several levels."""
    monkeypatch.setattr(L, "FAN_OUT", fan_out)
    rng = random.Random(fan_out)
    entries = {m: [(float(s), float(rng.randrange(0, 500, 10))) for s in range(60)] for m in range(4)}
    entries[0][40] = (3.5, 70.0)
    for k in rng.sample(range(60), 12):
        entries[1][k] = (entries[1][k][0] - rng.randrange(9), entries[1][k][1])
    rng.shuffle(entries[2])
    initial = {m: float(m * 50) for m in range(4)}
    history, machines = tables(spark, entries, initial)
    probes = [(k, k % 4, *(rng.choice([None, -1, *range(61), 2.5, 3.5]) for _ in range(2))) for k in range(400)]
    p = spark.createDataFrame([(k, m, at(a), at(b)) for k, m, a, b in probes], RANGES)
    got = {r.probe: (r.initial, r.weight, r.loaded, r.dispensed) for r in L.states(history, p, machines, block=16).collect()}
    assert got == {k: (point(entries[m], initial[m], a), point(entries[m], initial[m], b), *ranged(entries[m], initial[m], a, b)) for k, m, a, b in probes}


def test_one_late_entry_walks_little(spark, monkeypatch):
    """Of 20,000 entries one is late: a range sends on only the nodes at its ends and those that the late entry stretches."""
    rows = spark.range(20_000).select(F.lit(1).cast("bigint").alias("machine"), F.col("id").alias("seq"), F.timestamp_add("SECOND", F.when(F.col("id") == 15_000, 10).otherwise(F.col("id")).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("ts"), (F.col("id") % 7).cast("double").alias("weight"))
    sums = L.written(L._running_sums(rows, L.BLOCK_ENTRIES))
    sizes, keep = [], L.written
    monkeypatch.setattr(L, "written", lambda df: sizes.append(df.count()) or keep(df))
    ranges = spark.createDataFrame([(k, 1, T0 + timedelta(seconds=5_000 + k), T0 + timedelta(seconds=16_000 + k)) for k in range(10)], RANGES)
    got = L._walked(sums, ranges, 19_999).collect()
    assert len(got) == 10 and sum(sizes) < 10 * 10 * L.FAN_OUT


@pytest.mark.parametrize(
    ("entries", "initial", "a", "b", "expected"),
    [
        ([(-4, 0.0), (-3, 500.0), (-2, 20.0)], 0.0, -4, -1, (500.0, 480.0)),
        ([(-3, 0.0), (-2, 100.0), (-1, 200.0)], 0.0, -3, -1, (100.0, 0.0)),
        ([(-4, 500.0), (-3, 400.0), (-2, 250.0), (-1, 50.0)], 500.0, -4, 0, (0.0, 450.0)),
        ([(5, 10.0)], 3.0, 0, 4, (0.0, 0.0)),
        ([(0, 0.0), (0, 500.0)], 0.0, 0, 1, (500.0, 500.0)),
        ([(0, 5.0)], 0.0, 3, 1, (0.0, 0.0)),
    ],
)
def test_known_ranges(spark, entries, initial, a, b, expected):
    history, machines = tables(spark, {1: entries}, {1: initial})
    probe = spark.createDataFrame([(0, 1, at(a), at(b))], RANGES)
    r = L.range_summary(history, probe, machines).first()
    assert (r.loaded, r.dispensed) == expected
    if expected == (500.0, 500.0):
        r = L.range_summary(history, probe, machines, collapse_ties=True).first()
        assert (r.loaded, r.dispensed) == (0.0, 0.0)


@pytest.mark.parametrize("block", [1, 2, 3, L.BLOCK_ENTRIES])
def test_levels_after_operations(spark, block):
    ops = [(1, 0, "load", 500.5), (1, 1, "dispense", 0.1), (1, 2, "reset", 20.0), (1, 3, "load", 0.2), (1, 4, "reset", 0.0), (2, 0, "dispense", 5.0)]
    df = spark.createDataFrame([(m, k, at(k), op, v) for m, k, op, v in ops], "machine bigint, seq bigint, ts timestamp_ntz, op string, amount double")
    machines = spark.createDataFrame([(1, 100.0), (2, 50.0)], MACHINES)
    got = {(r.machine, r.seq): r.weight for r in L.weight_history(df, machines, block).collect()}
    assert got == {(1, 0): 600.5, (1, 1): 600.4, (1, 2): 20.0, (1, 3): 20.2, (1, 4): 0.0, (2, 0): 45.0}


def test_snapshot_and_dispatch(spark):
    history, machines = tables(spark, {1: [(5, 1.0), (3, 2.0)]}, {1: 9.0, 2: 4.0})
    readings = spark.createDataFrame([(1, "voltage", at(1), 380.0, "V")], "machine bigint, sensor string, timestamp timestamp_ntz, value double, unit string")
    got = {r.machine: r for r in L.chronology(history, machines, "current", readings=readings, sensor_names=["voltage", "cosphi"]).collect()}
    assert got[1].weight == 2.0 and got[1].voltage.value == 380.0 and got[1].cosphi is None and got[2].weight == 4.0
    probes = spark.createDataFrame([(1, at(3))], "machine bigint, at timestamp_ntz")
    assert L.chronology(history, machines, "point", probes).first().weight == 2.0
    assert L.chronology(history, machines, "range", spark.createDataFrame([(0, 1, at(0), at(9))], RANGES)).first().dispensed == 8.0
    with pytest.raises(ValueError):
        L.chronology(history, machines, "other")
    with pytest.raises(ValueError):
        L.current_snapshot(history, machines, readings, ["weight"])
