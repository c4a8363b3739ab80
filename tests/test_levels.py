import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import ledger
from emberline.sources.metrics import keep_last
from emberline.sources.scratch import scratch_folder
from emberline.streaming import levels, run
from emberline.streaming.sessions import stateful
from test_sessions import CountedState

T0 = datetime(2024, 1, 1)
PROBES = "probe bigint, machine bigint, at timestamp_ntz"


def at(s):
    return T0 + timedelta(seconds=s)


def streamed(spark, rows, schema, parts):
    """rows as a stream whose batches are dealt out by parts(row)."""
    folder = scratch_folder(spark)
    for k in sorted({parts(r) for r in rows}):
        spark.createDataFrame([r for r in rows if parts(r) == k], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_weights_equal_the_batch(spark):
    """Operations come by seq, with times up to 15 seconds out of order; probes come up to 20 seconds late."""
    rng = random.Random(3)
    ops = [(rng.randrange(3), k, at(k + rng.randrange(-15, 1)), rng.choice(["load", "load", "dispense", "reset"]), rng.randrange(1, 900) / 7) for k in range(120)]
    asked = [(k, rng.randrange(3), at(rng.randrange(-20, 130))) for k in range(60)]
    machines = spark.createDataFrame([(m, 10.5 * m) for m in range(3)], "machine bigint, initial double")
    history = ledger.weight_history(spark.createDataFrame(ops, schemas.OPERATION), machines)
    want = {tuple(r) for r in ledger.weight_at(history, spark.createDataFrame(asked, PROBES), machines).select("probe", "machine", "at", "weight").collect()}
    far = at(10**6)
    op_stream = streamed(spark, ops + [(0, 10**6, far, "load", 1.0)], schemas.OPERATION.simpleString()[7:-1].replace(":", " ").replace(",", ", "), lambda r: r[1] // 30)
    probe_stream = streamed(spark, asked + [(-1, 0, far)], PROBES, lambda r: (r[2] - T0).total_seconds() // 40)
    with stateful(spark):
        got = run.drain_appends(levels.weight_at_stream(op_stream, probe_stream, machines, "120 seconds")).where("probe >= 0")
    assert {tuple(r) for r in got.select("probe", "machine", "at", "weight").collect()} == want


def test_streamed_overwrites_equal_the_batch(spark):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(2)}", at(rng.randrange(30)), float(k), k) for k in range(200)]
    stream = streamed(spark, rows, "topic string, ts timestamp_ntz, value double, seq bigint", lambda r: r[3] % 3)
    got = run.drain_updates(levels.keep_last_stream(stream, "60 seconds"), ["topic", "ts"])
    want = keep_last(spark.createDataFrame(rows, schemas.METRICS))
    assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()} and got.agg(F.count("*")).first()[0] == want.count()


def test_machines_share_accesses_to_the_state():
    """300 machines with two operations and a probe each: a few accesses to the state for all of them."""
    state, processor, none = CountedState(), levels.LevelProcessor(), 0
    processor.init(state)
    ops = [(m, s * 10**6, 1000 * m + s, op, 10 * s, 5, none, False) for m in range(300) for s, op in ((1, "load"), (7, "load"), (9, "reset"))]
    asked = [(m, 8 * 10**6, none, "", none, 5, m, True) for m in range(300)] + [(0, 0, none, "", none, 5, 300, True), (0, 10**9, none, "", none, 5, 301, True)]
    frame = pd.DataFrame(ops + asked, columns=["machine", "us", "seq", "op", "units", "initial", "probe", "asks"])
    assert list(processor.handleInputRows((0,), iter([frame]), None)) == []
    state.watermark = 8500
    made = pd.concat(list(processor.handleExpiredTimer((0,), state, None)))
    assert dict(zip(made["probe"], made["weight"] * levels.UNIT)) == {**{m: 85.0 for m in range(300)}, 300: 5.0}
    state.watermark = 2 * 10**6
    made = pd.concat(list(processor.handleExpiredTimer((0,), state, None)))
    assert made["probe"].tolist() == [301] and made["weight"].tolist() == [90 / levels.UNIT]
    assert state.calls <= 60
