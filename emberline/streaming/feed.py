"""Change feeds: append-only tables that several writers share and whose new rows are sent to subscribers.

An append writes its rows to a part of its own, numbered from 0, and then takes the next place in a log of commits. The
commit says at which number the part begins; so writers never meet in a number, none is left out, and a writer that is
killed before its commit leaves nothing that a reader sees. A writer that repeats a batch it has committed changes nothing.

A subscriber is a streaming query whose offset is a place in the log; it gets whole appends, in their order.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from emberline import schemas
from emberline.operators.logs import with_sequence
from emberline.sources.commits import CommitLog, put_if_absent, read_text
from emberline.sources.scratch import delete_folder, scratch_folder
from emberline.streaming.pages import store
from emberline.streaming.run import Subscription

log = logging.getLogger(__name__)

#: Newest commits that a compaction leaves as they are, for subscribers.
KEEP = 1000


class ChangeFeed:
    """A table of change rows in a shared folder. With a prefix (that of the schema's ids, by default) rows whose seq is
    null get the next numbers as they are committed, and ids, if the schema has any, made of prefix and number."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, prefix: str | None = None) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.prefix = prefix if prefix is not None else schemas.ID_PREFIXES.get(tuple(schema.names))
        self.log = CommitLog(spark, f"{self.path}/commits")

    # ------------------------------------------------------------- writing

    def append(self, rows: DataFrame, batch: str | None = None, order_by: Sequence[str] = ("ts",)) -> DataFrame:
        """Append all rows or none; the rows as they stand in the feed. batch names what is appended: a batch that is
        there already isn't appended again. order_by: columns of rows in whose order new numbers are given."""
        known = next((c for c in self.log.commits() if batch is not None and c.get("batch") == batch), None)
        if known is None:
            part, none = uuid.uuid4().hex, F.lit(None).cast("bigint")
            given = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in rows.columns})
            if self.prefix is not None:
                old = given.where("seq is not null").withColumn("_nth", none)
                unnumbered = given.where("seq is null")
                if "seq" in rows.columns and unnumbered.isEmpty():
                    given = old
                else:
                    given = old.unionByName(with_sequence(unnumbered, list(order_by), out="_number").withColumnRenamed("_number", "_nth"))
            else:
                given = given.withColumn("_nth", none)
            given.select(*self.schema.names, "_nth").write.parquet(self._part(part))
            n = self._read(part).agg(F.coalesce(F.max("_nth") + 1, F.lit(0))).first()[0]
            known, new_ = self.log.add(lambda before: {"part": part, "first": self._next(before), "next": self._next(before) + n}, batch)
            if not new_:  # another writer has committed this batch meanwhile
                delete_folder(self.spark, self._part(part))
        return self._placed([known])

    @staticmethod
    def _next(before: list[dict]) -> int:
        return before[-1]["next"] if before else 0

    def _part(self, part: str) -> str:
        return f"{self.path}/rows/part={part}"

    def _read(self, *parts: str) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_nth", T.LongType()), T.StructField("part", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/rows").parquet(*map(self._part, parts))

    # ------------------------------------------------------------- reading

    def _placed(self, commits: list[dict]) -> DataFrame:
        """Rows of commits, with the numbers that these give them."""
        rows = self._read(*[c["part"] for c in commits])
        if self.prefix is not None:
            # at most one row an append since the last compaction
            first = self.spark.createDataFrame([(c["part"], c["first"]) for c in commits], "_p string, _first bigint")
            number = F.col("_first") + F.col("_nth")
            rows = rows.join(F.broadcast(first), F.col("part") == F.col("_p"))
            rows = rows.withColumn("seq", F.coalesce("seq", number))
            if "id" in self.schema.names:
                rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit(self.prefix), number)))
        return rows.select(*self.schema.names)

    def rows(self) -> DataFrame:
        """All rows that have been committed."""
        commits = self.log.commits()
        whole = max((c["version"] for c in commits if c.get("holds")), default=None)
        if whole is None:
            return self._placed(commits)
        upto = next(c["upto"] for c in commits if c["version"] == whole)
        return self._placed([c for c in commits if c["version"] == whole or c["version"] > upto and not c.get("holds")])

    def folded(self, rows: DataFrame) -> DataFrame:
        """What a compaction keeps of all rows: here each of them."""
        return rows

    def compact(self, keep: int = KEEP) -> None:
        """Write all rows into one part, and forget the commits and parts before it but the `keep` newest. Subscribers
        pass the commit of this part by. One program at a time should do this."""
        commits = self.log.commits()
        if not commits:
            return
        part, upto = uuid.uuid4().hex, commits[-1]["version"]
        self.folded(self.rows()).withColumn("_nth", F.lit(None).cast("bigint")).write.parquet(self._part(part))
        self.log.add(lambda before: {"part": part, "first": 0, "next": self._next(before), "holds": True, "upto": upto})
        old = commits[: max(0, len(commits) - keep)]
        self.log.drop([c["version"] for c in old])
        for c in old:
            delete_folder(self.spark, self._part(c["part"]))

    # --------------------------------------------------------- subscribing

    def _begin(self, name: str | None) -> int:
        """The newest place in the log; for a name, when it came first."""
        versions = self.log.versions()
        newest = versions[-1] if versions else -1
        if name is None:
            return newest
        put_if_absent(self.spark, f"{self.path}/begun/{name}.json", json.dumps({"version": newest}))
        return json.loads(read_text(self.spark, f"{self.path}/begun/{name}.json"))["version"]

    def stream(self, only_new: bool = True, name: str | None = None) -> DataFrame:
        """Rows committed from now on (with a name: from its first time on), or all that are there as well."""
        self.spark.dataSource.register(FeedSource)
        reader = self.spark.readStream.format("change_feed").schema(self.schema).option("path", self.path)
        return reader.option("begin", self._begin(name) if only_new else -1).option("numbered", str(self.prefix is not None)).option("prefix", self.prefix or "").load()

    def subscribe(self, callback: Callable[[Row], None], only_new: bool = True, period_ms: int = 200, name: str | None = None) -> Subscription:
        """Call back for each new row, at least once: rows of a batch that was cut short come again to a named subscriber,
        which goes on where it was, after a restart too. An error in a callback is logged and doesn't keep others from theirs."""

        def send(batch: DataFrame, _: int) -> None:
            for row in batch.toLocalIterator():
                try:
                    callback(row)
                except Exception:  # noqa: BLE001  one subscriber's fault is its own
                    log.exception("a subscriber failed")

        return self.each_batch(send, only_new, period_ms, name)

    def each_batch(self, action: Callable[[DataFrame, int], None], only_new: bool = True, period_ms: int = 200, name: str | None = None) -> Subscription:
        """Call action with each batch of new rows and its number."""
        progress = f"{self.path}/progress/{name}" if name else f"{scratch_folder(self.spark)}/progress"
        query = self.stream(only_new, name).writeStream.foreachBatch(action).option("checkpointLocation", progress)
        return Subscription(query.trigger(processingTime=f"{period_ms} milliseconds").start())


@dataclass
class FeedTask(InputPartition):
    file: str
    first: int


class FeedReader(DataSourceStreamReader):
    """Offsets are places in the log of commits; a task reads a file of a part."""

    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.begin, self.prefix, self.schema = options["path"], int(options["begin"]), options.get("prefix", ""), schema
        self.numbered = options["numbered"] == "True"

    def _commits(self, after: int = -1) -> dict[int, str]:
        files, path = store(self.path)
        found = files.get_file_info(fs.FileSelector(f"{path}/commits", allow_not_found=True))
        versions = {int(f.base_name[:-5]): f.path for f in found if f.base_name.endswith(".json")}
        return {v: p for v, p in versions.items() if v > after}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.begin}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(self._commits(), default=self.begin)}

    def partitions(self, start: dict, end: dict) -> list[FeedTask]:
        files, path = store(self.path)
        tasks = []
        for version, name in sorted(self._commits(start["version"]).items()):
            if version > end["version"]:
                break
            with files.open_input_stream(name) as f:
                commit = json.loads(f.read())
            if not commit.get("holds"):
                found = files.get_file_info(fs.FileSelector(f"{path}/rows/part={commit['part']}"))
                tasks += [FeedTask(f.path, commit["first"]) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet") and f.size]
        return tasks

    def read(self, partition: FeedTask) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        kind = to_arrow_schema(self.schema)
        with files.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                columns = {n: batch.column(n) for n in batch.schema.names}
                if self.numbered:
                    number = pc.add(columns["_nth"], partition.first)
                    columns["seq"] = pc.coalesce(columns["seq"], number)
                if self.numbered and "id" in columns:
                    columns["id"] = pc.coalesce(columns["id"], pc.binary_join_element_wise(self.prefix, number.cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays([columns[n].cast(kind.field(n).type) for n in self.schema.names], schema=pa.schema([pa.field(n, kind.field(n).type) for n in self.schema.names]))


class FeedSource(DataSource):
    """Format "change_feed": path, begin (the place in the log to start behind) and prefix of ids."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def streamReader(self, schema: T.StructType) -> FeedReader:  # noqa: N802
        return FeedReader(dict(self.options), schema)
