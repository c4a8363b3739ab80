"""The logbook of machines: operations and session commands as appends, which ledgers and sessions are read from."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import ledger, sessions
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.sessions import fold_stream


class Logbook:
    """Feeds of operations and commands in a folder, which several programs may write to at once. Rows are numbered as
    they are committed, and the numbers are the order in which they count."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.operations = ChangeFeed(spark, f"{path}/operations", schemas.OPERATION)
        self.commands = ChangeFeed(spark, f"{path}/commands", schemas.COMMAND)

    def operate(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Append operations (machine, ts, op, amount) of any number of machines."""
        return self.operations.append(rows, batch, ("ts", "machine"))

    def command(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Append commands (machine, ts, command, session, start, end)."""
        return self.commands.append(rows, batch, ("ts", "machine"))

    def _operation(self, machine: int, op: str, amount: float, ts: datetime | None) -> DataFrame:
        row = self.spark.createDataFrame([(machine, ts, op, float(amount))], "machine bigint, ts timestamp_ntz, op string, amount double")
        return self.operate(row.withColumn("ts", F.coalesce("ts", F.current_timestamp().cast("timestamp_ntz"))))

    def load(self, machine: int, amount: float, ts: datetime | None = None) -> DataFrame:
        return self._operation(machine, "load", amount, ts)

    def dispense(self, machine: int, amount: float, ts: datetime | None = None) -> DataFrame:
        return self._operation(machine, "dispense", amount, ts)

    def reset(self, machine: int, weight: float = 0.0, ts: datetime | None = None) -> DataFrame:
        return self._operation(machine, "reset", weight, ts)

    def _session(self, machine: int | None, command: str, session: int | None, start: datetime | None, end: datetime | None, ts: datetime | None) -> DataFrame:
        row = self.spark.createDataFrame([(machine, ts, command, session, start, end)], "machine bigint, ts timestamp_ntz, command string, session bigint, start timestamp_ntz, end timestamp_ntz")
        return self.command(row.withColumn("ts", F.coalesce("ts", F.current_timestamp().cast("timestamp_ntz"))))

    def start(self, machine: int, start: datetime | None = None, end: datetime | None = None, ts: datetime | None = None) -> DataFrame:
        """Begin a session, or enter one that is over. The row's seq names the session."""
        return self._session(machine, "add", None, start, end, ts)

    def stop(self, machine: int, session: int | None = None, end: datetime | None = None, ts: datetime | None = None) -> DataFrame:
        return self._session(machine, "stop", session, None, end, ts)

    def update(self, machine: int, session: int | None = None, start: datetime | None = None, end: datetime | None = None, ts: datetime | None = None) -> DataFrame:
        return self._session(machine, "update", session, start, end, ts)

    def history(self, machines: DataFrame) -> DataFrame:
        """Levels after each operation, as ledger.weight_history has them."""
        return ledger.weight_history(self.operations.rows(), machines)

    def sessions(self) -> DataFrame:
        return sessions.latest_sessions(sessions.fold_commands(self.commands.rows()))

    def session_changes(self, only_new: bool = False, lateness: str | None = None) -> DataFrame:
        """A stream of the changes that commands make. Start its query under `streaming.sessions.stateful` settings."""
        return fold_stream(self.commands.stream(only_new), lateness)
