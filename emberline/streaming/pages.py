"""Pages of a metrics table as a streaming source: each batch is the next rows in order of (ts, seq), at most a page, or
the next few pages at once.

The offset of a stream is its cursor, the (ts, seq) of the last row of a page, so it stands in the query's checkpoint: a
query that was stopped or killed goes on with the row after its last page, and a batch that runs again reads the rows
between the same two cursors. As with any cursor, rows that are stored later than others but lie before them in order are
passed by. A page is found by row group statistics: only row groups that may hold its rows are read, and row groups that
lie whole within a batch and apart from others are counted unread. A table whose row groups all overlap in time would be
read anew for each batch; `in_order` makes a copy of it where they don't.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from emberline.schemas import METRICS
from emberline.sources.scratch import scratch_folder

#: Rows of a page.
PAGE = 100
#: Pages that a batch takes at once where a whole table is read through: a batch of one small page is all overhead.
BATCH_PAGES = 500
EPOCH = datetime(1970, 1, 1)
LAST = (1 << 63) - 1
#: Row groups, and rows if it is more than one group, that one task reads of a batch.
GROUPS_PER_TASK, ROWS_PER_TASK = 64, 100_000
#: Rows of a row group of a copy in order.
ORDERED_ROWS = 50_000

Cursor = tuple[int, int]


def micros(at: datetime) -> int:
    return (at - EPOCH) // timedelta(microseconds=1)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path with or without scheme."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Group:
    """A row group: its file, number, rows, and the least and greatest ts, in microseconds."""

    file: str
    number: int
    rows: int
    first: int
    last: int


@dataclass(frozen=True)
class Columns:
    """Names in the stored table of what a metrics row has."""

    topic: str = "topic"
    ts: str = "ts"
    value: str = "value"
    seq: str = "seq"


class PagedTable:
    """Row groups of a folder or file of Parquet, and the rows of them that lie between two cursors."""

    def __init__(self, path: str, columns: Columns) -> None:
        self.columns, (self.files, self.path) = columns, store(path)
        self._known: dict[str, list[Group]] = {}

    def groups(self) -> list[Group]:
        """All row groups that are there now. Statistics of a file are read once."""
        found = []
        for fragment in ds.dataset(self.path, filesystem=self.files, format="parquet").get_fragments():
            if fragment.path not in self._known:
                self._known[fragment.path] = [Group(fragment.path, g.id, g.num_rows, *self._span(g.statistics)) for g in fragment.row_groups]
            found += self._known[fragment.path]
        return found

    def _span(self, statistics: dict | None) -> tuple[int, int]:
        span = (statistics or {}).get(self.columns.ts)
        if not span or not isinstance(span["min"], datetime):
            return -LAST, LAST
        return tuple(micros(x.replace(tzinfo=None)) for x in (span["min"], span["max"]))

    def rows(self, group: Group, after: Cursor, upto: Cursor) -> pa.Table:
        """topic, ts (microseconds), value and seq of a row group's rows behind `after`, up to and with `upto`."""
        c = self.columns
        fragment = ds.ParquetFileFormat().make_fragment(group.file, filesystem=self.files, row_groups=[group.number])
        held = fragment.to_table(columns=[c.topic, c.ts, c.value, c.seq])
        ts, seq = held.column(c.ts).cast(pa.timestamp("us")).cast(pa.int64()), held.column(c.seq).cast(pa.int64())
        behind = pc.or_(pc.greater(ts, after[0]), pc.and_(pc.equal(ts, after[0]), pc.greater(seq, after[1])))
        within = pc.or_(pc.less(ts, upto[0]), pc.and_(pc.equal(ts, upto[0]), pc.less_equal(seq, upto[1])))
        made = pa.table([held.column(c.topic).cast(pa.string()), ts, held.column(c.value).cast(pa.float64()), seq], ["topic", "ts", "value", "seq"])
        return made.filter(pc.and_(behind, within))

    def page_end(self, after: Cursor, limit: int) -> Cursor:
        """The cursor of the last of the next `limit` rows behind `after`; `after` itself if there is none."""
        groups = sorted((g for g in self.groups() if g.last >= after[0]), key=lambda g: g.first)
        end, counted, k = after, [], 0
        while k < len(groups) and limit > 0:
            near, last = [groups[k]], groups[k].last  # row groups that overlap in time
            while k + len(near) < len(groups) and groups[k + len(near)].first <= last:
                near.append(groups[k + len(near)])
                last = max(last, near[-1].last)
            k += len(near)
            if near[0].first > after[0] and sum(g.rows for g in near) <= limit:
                limit, counted = limit - sum(g.rows for g in near), near
                continue
            found = self._first(near, after, limit)
            if len(found):
                limit, counted, end = limit - len(found), [], _cursor(found, len(found) - 1)
        if counted:
            last = max(g.last for g in counted)
            found = [_cursor(f, len(f) - 1) for f in (self._first([g], after, g.rows) for g in counted if g.last == last) if len(f)]
            end = max([end, *found])
        return end

    def _first(self, groups: list[Group], after: Cursor, limit: int) -> pa.Table:
        """ts and seq, in order, of the first `limit` rows behind `after`, and of those that share the last one's cursor, as
        nothing tells them apart. Row groups come by their first time, and are read until none that is left can hold one."""
        least = pa.table([pa.array([], pa.int64())] * 2, ["ts", "seq"])
        for group in groups:
            upto = _cursor(least, limit - 1) if len(least) >= limit else (LAST, LAST)
            if group.first > upto[0]:
                break
            least = pa.concat_tables([least, self.rows(group, after, upto).select(["ts", "seq"])]).sort_by([("ts", "ascending"), ("seq", "ascending")])
            if len(least) > limit:
                ts, seq = _cursor(least, limit - 1)
                least = least.filter(pc.or_(pc.less(least["ts"], ts), pc.and_(pc.equal(least["ts"], ts), pc.less_equal(least["seq"], seq))))
        return least


def _cursor(rows: pa.Table, k: int) -> Cursor:
    return rows["ts"][k].as_py(), rows["seq"][k].as_py()


@dataclass
class PageTask(InputPartition):
    """What one task reads of a batch: some row groups, between two cursors."""

    groups: list[Group]
    after: Cursor
    upto: Cursor


class PageReader(DataSourceStreamReader):
    """Cursor offsets over a PagedTable.

    Spark asks for a batch's end without saying where it begins; so the reader keeps the end that it was last asked to
    read up to, in a small file as well: a reader that takes over after a restart goes on from there. Where that file lags
    behind the checkpoint, Spark first runs the checkpoint's last batch again, which sets it right.
    """

    def __init__(self, options: dict[str, str]) -> None:
        names = {n: options[f"{n}_column"] for n in ("topic", "ts", "value", "seq") if options.get(f"{n}_column")}
        self.path, self.columns, self.limit, self.since = options["path"], Columns(**names), int(options.get("limit", PAGE)) * int(options.get("pages", 1)), int(options.get("since_micros", -LAST))
        self.cursor_file, self._table, self._cursor = options["cursor"], None, None

    @property
    def table(self) -> PagedTable:
        if self._table is None:
            self._table = PagedTable(self.path, self.columns)
        return self._table

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ts": self.since, "seq": LAST}

    def latestOffset(self) -> dict:  # noqa: N802
        ts, seq = self.table.page_end(self._now(), self.limit)
        return {"ts": ts, "seq": seq}

    def partitions(self, start: dict, end: dict) -> list[PageTask]:
        after, upto = (start["ts"], start["seq"]), (end["ts"], end["seq"])
        self._set(max(upto, after))
        if upto <= after:
            return []
        groups = sorted((g for g in self.table.groups() if g.last >= after[0] and g.first <= upto[0]), key=lambda g: (g.file, g.number))
        tasks: list[PageTask] = []
        for group in groups:
            if not tasks or len(tasks[-1].groups) == GROUPS_PER_TASK or sum(g.rows for g in tasks[-1].groups) + group.rows > ROWS_PER_TASK:
                tasks.append(PageTask([], after, upto))
            tasks[-1].groups.append(group)
        return tasks

    def read(self, partition: PageTask) -> Iterator[pa.RecordBatch]:
        table = PagedTable(self.path, self.columns)
        for group in partition.groups:
            found = table.rows(group, partition.after, partition.upto)
            yield from found.set_column(1, "ts", found.column("ts").cast(pa.timestamp("us"))).to_batches()

    def _now(self) -> Cursor:
        if self._cursor is None:
            files, path = store(self.cursor_file)
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_stream(path) as f:
                    self._cursor = tuple(json.loads(f.read()))
            else:
                self._cursor = (self.since, LAST)
        return self._cursor

    def _set(self, cursor: Cursor) -> None:
        self._cursor = cursor
        files, path = store(self.cursor_file)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(json.dumps(cursor).encode())
        files.move(part, path)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}


class MetricsPages(DataSource):
    """Format "metrics_pages". Options: path, cursor (a file beside the checkpoint), limit, pages, since_micros, and the stored
    names of columns (topic_column, ts_column, value_column, seq_column)."""

    @classmethod
    def name(cls) -> str:
        return "metrics_pages"

    def schema(self) -> StructType:
        return METRICS

    def streamReader(self, schema: StructType) -> PageReader:  # noqa: N802
        return PageReader(dict(self.options))


def page_stream(spark: SparkSession, path: str, progress: str, since: datetime | None = None, limit: int = PAGE, batch_pages: int = 1, **columns: str) -> DataFrame:
    """Metrics rows behind `since` as a stream of pages, batch_pages a batch. progress: the folder that holds the query's checkpoint too."""
    spark.dataSource.register(MetricsPages)
    reader = spark.readStream.format("metrics_pages").option("path", path).option("cursor", f"{progress.rstrip('/')}/cursor.json").option("limit", limit).option("pages", batch_pages)
    if since is not None:
        reader = reader.option("since_micros", micros(since))
    for name, stored in columns.items():
        reader = reader.option(f"{name}_column", stored)
    return reader.load()


def drain_pages(stream: DataFrame, progress: str, out: str) -> None:
    """Write pages to Parquet files in `out` until none is left; goes on where an earlier run with this progress stopped."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{progress.rstrip('/')}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def in_order(metrics: DataFrame) -> str:
    """The folder of a copy of metrics in order of (ts, seq), in row groups that meet in time at most at their ends."""
    folder = scratch_folder(metrics.sparkSession)
    ranged = metrics.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")
    ranged.write.option("maxRecordsPerFile", ORDERED_ROWS).parquet(folder)
    return folder


def all_pages(spark: SparkSession, path: str, since: datetime | None = None, limit: int = PAGE, batch_pages: int = BATCH_PAGES, **columns: str) -> DataFrame:
    """All rows behind `since`, page by page, of a copy in order: a page reads its own rows, whatever the table's size."""
    stored = spark.read.parquet(path).select(*[F.col(columns.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in METRICS])
    folder = scratch_folder(spark)
    drain_pages(page_stream(spark, in_order(stored), f"{folder}/progress", since, limit, batch_pages), f"{folder}/progress", f"{folder}/out")
    return spark.read.schema(METRICS).parquet(f"{folder}/out")
