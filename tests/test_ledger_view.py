import os
import random
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pytest

from emberline import schemas
from emberline.operators import ledger
from emberline.sources.scratch import scratch_folder
from emberline.streaming.ledger_view import LedgerView

T0 = datetime(2024, 1, 1)
MACHINES = "machine bigint, initial double"


def operations(n, machines=5, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(machines), k, T0 + timedelta(seconds=k), rng.choice(["load", "load", "load", "dispense", "reset"]), rng.randrange(1, 9000) / 16) for k in range(n)]


def levels(df):
    return sorted(tuple(r) for r in df.select("machine", "seq", "ts", "weight").collect())


def test_a_view_extended_in_parts_equals_the_whole_history(spark):
    rows, view = operations(300), LedgerView(spark, scratch_folder(spark))
    machines = spark.createDataFrame([(m, 10.0 * m) for m in range(4)], MACHINES)  # the fifth isn't known
    part = lambda a, b: spark.createDataFrame(rows[a:b], schemas.OPERATION)
    view.extend(part(0, 120), machines, "a")
    view.extend(part(120, 121), machines, "b", fold=True)
    view.extend(part(100, 250), machines, "c")  # some of them are there
    view.extend(part(100, 250), machines, "c")
    view.extend(part(100, 250), machines, "d")
    view.extend(part(250, 300), machines, "e")
    assert levels(view.history()) == levels(ledger.weight_history(part(0, 300), machines))


def test_an_extension_that_was_cut_off_is_set_right_by_the_same_call(spark, monkeypatch):
    rows, view = operations(40), LedgerView(spark, scratch_folder(spark))
    machines = spark.createDataFrame([(m, 0.0) for m in range(5)], MACHINES)
    part = lambda a, b: spark.createDataFrame(rows[a:b], schemas.OPERATION)

    def cut(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(type(view.last), "append", cut)
        view.extend(part(0, 20), machines, "a")
    view.extend(part(0, 20), machines, "a")
    view.extend(part(20, 40), machines, "b")
    assert levels(view.history()) == levels(ledger.weight_history(part(0, 40), machines))


def test_one_percent_more_reads_under_a_tenth_of_the_ledger(spark):
    rows, view = operations(40_400, 20), LedgerView(spark, scratch_folder(spark))
    machines = spark.createDataFrame([(m, 0.0) for m in range(20)], MACHINES)
    view.extend(spark.createDataFrame(rows[:40_000], schemas.OPERATION), machines, fold=True)
    size = lambda df: sum(os.path.getsize(urlparse(f).path) for f in df.inputFiles())
    read = size(view.new_entries(spark.createDataFrame(rows[40_000:], schemas.OPERATION), machines))
    assert 0 < read < size(view.history()) / 10
