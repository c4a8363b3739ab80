import glob
import json
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from emberline.schemas import METRICS
from emberline.streaming import pages

T0 = datetime(2024, 1, 1)


def metrics(spark, rows):
    return spark.createDataFrame([(f"t{k % 3}", T0 + timedelta(seconds=s), float(k), k) for k, s in rows], METRICS)


@pytest.fixture
def stored(spark, tmp_path):
    """1,000 rows, ten of each second, in files of several row groups that overlap in time."""
    rows = [(k, k // 10) for k in range(1000)]
    for n in range(4):
        part = metrics(spark, rows[n::4]).toPandas()
        part.to_parquet(f"{tmp_path}/in-{n}.parquet", row_group_size=40, coerce_timestamps="us", index=False)
    (tmp_path / "table").mkdir()
    for f in glob.glob(f"{tmp_path}/in-*.parquet"):
        (tmp_path / "table" / f.rpartition("/")[2]).write_bytes(open(f, "rb").read())
    return str(tmp_path / "table")


def written_batches(out):
    """Rows of each batch, as the sink's log names its files."""
    batches = {}
    for log in glob.glob(f"{out}/_spark_metadata/*"):
        if log.rpartition("/")[2].isdigit():
            files = [json.loads(line)["path"] for line in open(log).read().splitlines()[1:]]
            batches[int(log.rpartition("/")[2])] = sorted((r["ts"], r["seq"]) for f in files for r in pq.read_table(f.removeprefix("file://")).to_pylist())
    return [batches[k] for k in sorted(batches)]


def test_pages_are_in_order_and_of_the_limit(spark, tmp_path, stored):
    since = T0 + timedelta(seconds=20)
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")
    pages.drain_pages(pages.page_stream(spark, stored, progress, since), progress, out)
    got = [b for b in written_batches(out) if b]
    want = [(T0 + timedelta(seconds=k // 10), k) for k in range(1000) if k // 10 > 20]
    assert got == [want[k : k + 100] for k in range(0, len(want), 100)]


def test_a_query_killed_between_pages_goes_on_with_each_row_once(spark, tmp_path, stored):
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")
    seen = []

    class Killed(Exception):
        pass

    def run(stop_after):
        """Batches into files of their own; an error in the middle of a batch is what a killed driver leaves behind."""
        done = []

        def write(batch, number):
            if len(done) == stop_after:
                raise Killed
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            done.append(number)

        stream = pages.page_stream(spark, stored, progress, limit=70)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{progress}/checkpoint").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        except Exception as e:  # noqa: BLE001
            assert "Killed" in str(e)
        finally:
            query.stop()
        seen.append(done)

    for stop_after in (3, 0, 4, None):
        run(stop_after)
    rows = spark.read.parquet(out).groupBy("batch").count().collect()
    assert sum(r["count"] for r in rows) == 1000 and max(r["count"] for r in rows) == 70
    assert spark.read.parquet(out).select("seq").distinct().count() == 1000
    assert len(seen[0]) == 3 and seen[1] == [] and len(seen[2]) == 4


def test_rows_that_come_later_and_many_of_one_cursor(spark, tmp_path):
    table, progress, out = str(tmp_path / "table"), str(tmp_path / "progress"), str(tmp_path / "out")
    spark.createDataFrame([("t", T0, 1.0, 5)] * 30 + [("t", T0, 2.0, 6)], METRICS).coalesce(1).write.parquet(table)
    drain = lambda: pages.drain_pages(pages.page_stream(spark, table, progress, limit=8), progress, out)
    drain()
    assert [len(b) for b in written_batches(out) if b] == [30, 1]
    drain()
    metrics(spark, [(100 + k, 1 + k) for k in range(10)]).write.mode("append").parquet(table)
    drain()
    assert [len(b) for b in written_batches(out) if b] == [30, 1, 8, 2]


def test_only_row_groups_of_a_page_are_read(stored, monkeypatch):
    table = pages.PagedTable(stored, pages.Columns())
    assert len(table.groups()) == 28
    read = []
    rows = pages.PagedTable.rows
    monkeypatch.setattr(pages.PagedTable, "rows", lambda self, g, a, b: read.append(g) or rows(self, g, a, b))
    assert table.page_end((pages.micros(T0 + timedelta(seconds=50)), pages.LAST), 20) == (pages.micros(T0 + timedelta(seconds=52)), 529)
    assert len(read) <= 8


def test_row_groups_whole_within_a_batch_are_counted_unread(spark, monkeypatch):
    """1,000 rows in no order of time; of the copy in order a batch of many pages reads the row groups at its ends."""
    monkeypatch.setattr(pages, "ORDERED_ROWS", 50)
    path = pages.in_order(metrics(spark, [(k, (k * 7919) % 1000 // 2) for k in range(1000)]))
    table = pages.PagedTable(path, pages.Columns())
    read = []
    rows = pages.PagedTable.rows
    monkeypatch.setattr(pages.PagedTable, "rows", lambda self, g, a, b: read.append(g) or rows(self, g, a, b))
    in_order = sorted(((k * 7919) % 1000 // 2, k) for k in range(1000))
    after = (-pages.LAST, pages.LAST)
    for n in (370, 740, 1000):
        read.clear()
        after = table.page_end(after, 370)
        assert after == (pages.micros(T0 + timedelta(seconds=in_order[n - 1][0])), in_order[n - 1][1])
        assert len(read) <= 6
    assert table.page_end(after, 370) == after


def test_a_batch_takes_several_pages(spark, tmp_path, stored):
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")
    pages.drain_pages(pages.page_stream(spark, stored, progress, limit=40, batch_pages=7), progress, out)
    assert [len(b) for b in written_batches(out) if b] == [280, 280, 280, 160]
    got = pages.all_pages(spark, stored, limit=40)
    assert sorted(r.seq for r in got.collect()) == list(range(1000))
