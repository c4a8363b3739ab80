"""The weight history of machines as a kept-up table: new operations are levelled from where each machine stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import ledger
from emberline.sources.scratch import written
from emberline.streaming.feed import ChangeFeed


class LastEntries(ChangeFeed):
    """The entry of each machine that was inserted last. Folded into one row a machine every so often."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, schemas.WEIGHT_HISTORY)

    def folded(self, rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("seq", "ts", "weight"), "seq")
        return rows.groupBy("machine").agg(newest.alias("_e")).select("machine", "_e.*")


class LedgerView:
    """weight_history, extended by the operations that come: what is read for them is one entry a machine, not the history.

    A machine's operations come in order of seq, as a logbook numbers them; those up to its last entry are there already
    and are passed by, so that a part that comes again makes no difference.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.entries = ChangeFeed(spark, f"{path}/entries", schemas.WEIGHT_HISTORY)
        self.last = LastEntries(spark, f"{path}/last")

    def new_entries(self, operations: DataFrame, machines: DataFrame) -> DataFrame:
        """The entries that operations add."""
        stand = self.last.folded(self.last.rows()).select("machine", F.col("seq").alias("_seq"), F.col("weight").alias("_weight"))
        new = operations.join(stand.select("machine", "_seq"), "machine", "left").where("_seq is null or seq > _seq").select(*schemas.OPERATION.names)
        begins = machines.join(stand, "machine", "full").select("machine", F.coalesce("_weight", "initial").alias("initial"))
        return ledger.weight_history(new, begins)

    def extend(self, operations: DataFrame, machines: DataFrame, batch: str | None = None, fold: bool = False) -> DataFrame:
        """Add the entries of operations; those that were added. After a failure between entries and last ones, the same
        call with the same batch name sets both right."""
        added = written(self.entries.append(written(self.new_entries(operations, machines)), batch))
        self.last.append(self.last.folded(added), batch)
        if fold:
            self.last.compact(keep=0)
        return added

    def history(self) -> DataFrame:
        return self.entries.rows()
