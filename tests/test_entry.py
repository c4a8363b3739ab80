import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberline import schemas
from emberline.plans.queries import NOW, REGISTRY, plant
from emberline.sources.scratch import scratch_folder
from emberline.streaming.feed import ChangeFeed

ROOT = Path(__file__).parent.parent
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted(tuple("null" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_its_sql(spark, db, name):
    query, sql = REGISTRY[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    expected = db.execute(sql)
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert comparable(df.select(*[f"`{c}`" for c in names]).collect()) == comparable([[r[k] for k in order] for r in expected.fetchall()])


def test_entry_and_plant(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    p = plant(spark, SF)
    assert p.check_machines().count() == 0 and p.init() == []
    assert sorted(r.machine for r in p.in_shop(3).collect()) == sorted(r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").where("c_nationkey = 3").collect())
    changes = p.meltings(stream=True).collect()
    assert sorted(r.session for r in p.meltings(machine=7).collect()) == sorted({r.session for r in changes if r.machine == 7}) != []
    now = F.lit(NOW).cast("timestamp_ntz")
    snap = {r.machine: r for r in p.snapshot(now, ["voltage", "cosphi"]).collect()}
    assert {k: (r.weight, r.voltage.value, r.cosphi.value) for k, r in snap.items()} == {r.machine: (r.weight, r.voltage, r.cosphi) for r in REGISTRY["current_snapshot"][0](spark, SF).collect()}
    again = p.chronology("current", readings=p.readings(now), sensor_names=["voltage", "cosphi"])
    assert {r.machine: r for r in again.collect()} == snap
    first = p.history().where("machine = 7").orderBy("seq").first()
    probe = spark.createDataFrame([(0, 7, first.ts, NOW)], "probe bigint, machine bigint, `from` timestamp_ntz, `to` timestamp_ntz")
    assert p.chronology("point", probe.withColumnRenamed("from", "at")).first().weight == first.weight and p.chronology("range", probe).count() == 1
    states = p.melting_states(now).collect()
    assert len(states) == len({r.session for r in changes}) and {r.machine for r in p.machine_alerts(F.col("message") == "Edge").collect()} <= set(snap)


def test_a_plant_starts_its_monitors_once(spark):
    p, feed = plant(spark, SF), ChangeFeed(spark, scratch_folder(spark), schemas.ALERT)
    monitor = p.monitor(feed)
    assert monitor.tick(F.lit(NOW).cast("timestamp_ntz")) == feed.rows().count() > 0
    (handle,) = p.init()
    assert p.init() == [handle] and handle.active
    handle.cancel()


def test_rest_works_without_the_training_data_package():
    code = "import importlib.util as u, sys; f = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('emberline.llm') else f(n, *a)\nimport __spark_entry__ as e\nassert len(e.queries()) == len(e.oracle_sql()) > 30 and not [m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
