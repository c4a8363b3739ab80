"""Running streaming queries to the end of what is there, and handles on running ones."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.sources.scratch import scratch_folder


@contextmanager
def settings(spark: SparkSession, **values: str):  # noqa: ANN201
    """Session settings while a query starts; a streaming query keeps those it started with."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain_appends(stream: DataFrame) -> DataFrame:
    """What an append-mode stream gives for all input there is, written to files and read back."""
    spark, folder = stream.sparkSession, scratch_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_updates(stream: DataFrame, key: list[str]) -> DataFrame:
    """The last version of each row, by its key, of an update-mode stream over all input there is. Batches write only the
    rows that changed, and the watermark lets go of what can't change any more."""
    spark, folder = stream.sparkSession, scratch_folder(stream.sparkSession)
    rest = [c for c in stream.columns if c not in key]

    def keep(batch: DataFrame, number: int) -> None:  # a batch that runs again takes its own place
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/out")
    return kept.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*[F.col(f"_v.{c}").alias(c) if c in rest else c for c in stream.columns])


class Subscription:
    """A handle on a running query. Cancelling again does nothing."""

    def __init__(self, query: StreamingQuery) -> None:
        self.query = query

    @property
    def active(self) -> bool:
        return self.query.isActive

    def cancel(self) -> None:
        if self.query.isActive:
            self.query.stop()


def every(spark: SparkSession, period_ms: int, action: Callable[[int], None]) -> Subscription:
    """Run action(number) each period until cancelled; a slow action delays the next one, they never overlap."""
    if period_ms <= 0:
        raise ValueError("the period must be above 0")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()

    def run(_: DataFrame, number: int) -> None:
        if number:  # the first fire is after one period
            action(number)

    progress = f"{scratch_folder(spark)}/progress"
    query = ticks.writeStream.foreachBatch(run).option("checkpointLocation", progress).trigger(processingTime=f"{period_ms} milliseconds").start()
    return Subscription(query)
