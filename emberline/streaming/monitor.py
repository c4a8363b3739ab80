"""Monitoring: a snapshot of all machines each period, through the threshold rules, into the alert log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.rules import threshold_issues
from emberline.schemas import METRICS
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.run import Subscription, every

#: Fixed value.
PERIOD_MS = 1000
#: Batches of metrics between two folds of the newest values.
FOLD = 16


class RunOnce:
    """Starts something once; later calls return the first result."""

    def __init__(self, start: Callable[[], object]) -> None:
        self._start, self._started = start, []

    def init(self) -> object:
        if not self._started:
            self._started.append(self._start())
        return self._started[0]


def issues_at(snapshot: DataFrame, now: F.Column, suppress: F.Column | None = None) -> DataFrame:
    """message, ts and object (machine name) for each issue of a snapshot with machine name, voltage and cosphi."""
    return threshold_issues(snapshot, suppress=suppress).select("message", now.alias("ts"), F.col("name").alias("object"))


class LatestValues(ChangeFeed):
    """The newest value of each topic, kept up from a stream of metrics.

    A batch of the stream appends the newest rows of its own topics, once, and every FOLD batches all are folded into one
    row a topic. So what a look at the values reads follows the topics and the last few batches, not the history.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, METRICS)

    def folded(self, rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("ts", "value", "seq"), F.struct("ts", "seq"))
        return rows.groupBy("topic").agg(newest.alias("_m")).select("topic", "_m.*")

    def keep(self, batch: DataFrame, number: int, name: str = "latest") -> None:
        """Take a batch of metrics in; again makes no difference."""
        self.append(self.folded(batch.select(*METRICS.names)), f"{name}:{number}")
        if number % FOLD == FOLD - 1:
            self.compact(keep=4 * FOLD)

    def follow(self, metrics: DataFrame, period_ms: int = PERIOD_MS, drain: bool = False) -> Subscription:
        """Keep up with a stream of metrics, from where it was left; with drain, up to what is there now."""
        query = metrics.writeStream.foreachBatch(self.keep).option("checkpointLocation", f"{self.path}/progress/metrics")
        query = (query.trigger(availableNow=True) if drain else query.trigger(processingTime=f"{period_ms} milliseconds")).start()
        if drain:
            query.awaitTermination()
        return Subscription(query)


class Monitor:
    """Each period: one snapshot of all machines, one evaluation, one append. Conditions that persist alert each time."""

    def __init__(self, spark: SparkSession, snapshot: Callable[[], DataFrame], alerts: ChangeFeed, period_ms: int = PERIOD_MS) -> None:
        self.spark, self.snapshot, self.alerts, self.period_ms = spark, snapshot, alerts, period_ms
        self._once = RunOnce(lambda: every(spark, period_ms, lambda _: self.tick(F.current_timestamp().cast("timestamp_ntz"))))

    def tick(self, now: F.Column) -> int:
        """Evaluate once; the number of alerts appended."""
        found = issues_at(self.snapshot(), now).withColumns({"acknowledged": F.lit(False), "change": F.lit("created")})
        return self.alerts.append(found, order_by=("ts", "object", "message")).count()

    def init(self) -> Subscription:
        """Start, or give the handle of what runs already."""
        return self._once.init()
