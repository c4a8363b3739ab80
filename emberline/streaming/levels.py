"""Weights at points of time over a stream of operations and probes, and the last value of each time over a stream of metrics."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators.ledger import EXACT
from emberline.streaming.sessions import FirstTimer, PackedRows, bucket_of

#: Millionths, in which weights are whole numbers in the state, as they are exact in the batch's decimals.
UNIT = 1_000_000
OUT = "probe bigint, machine bigint, at timestamp_ntz, weight double"


class LevelProcessor(StatefulProcessor):
    """Levels of a bucket's machines, their entries that a probe may still ask for, and probes that wait for their time.

    Operations are applied by seq as they come. A probe waits until the watermark has passed its time. Then entries up to
    the watermark have no more use but for the one inserted last among them, which stands for all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = PackedRows(handle, "levels")  # machine, units
        self.past = PackedRows(handle, "past")  # machine, seq, units
        self.recent = PackedRows(handle, "recent")  # machine, seq, us, units
        self.waiting = PackedRows(handle, "waiting")  # machine, probe, us, initial
        self.timer = FirstTimer(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows))
        entered, asked = came[~came["asks"]].sort_values("seq", kind="stable"), came[came["asks"]]
        if len(entered):
            held, after = self.levels.get(), []
            levels = {} if held is None else dict(zip(held["machine"].tolist(), held["units"].tolist()))
            for machine, op, units, initial in zip(*[entered[c].tolist() for c in ("machine", "op", "units", "initial")]):
                level = levels.get(machine, initial)
                levels[machine] = units if op == "reset" else level + (-units if op == "dispense" else units)
                after.append(levels[machine])
            self.recent.add(entered[["machine", "seq", "us"]].assign(units=np.array(after, "int64")))
            self.levels.replace(pd.DataFrame({"machine": list(levels), "units": list(levels.values())}, dtype="int64"))
        self.waiting.add(asked[["machine", "probe", "us", "initial"]])
        self.timer.at_latest(int(came["us"].min()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.expired()
        recent, waiting, past = self._held(self.recent, ["machine", "seq"]), self._held(self.waiting, ["machine", "probe"]), self.past.get()
        later = []
        if waiting is not None:
            due = waiting["us"] < upto
            later += waiting["us"][~due].tolist()
            if due.any():
                self.waiting.replace(waiting[~due])
                yield self._answers(waiting[due], recent, past)
        if recent is not None:
            done = recent["us"] < upto
            later += recent["us"][~done].tolist()
            if done.any():
                known = [recent.loc[done, ["machine", "seq", "units"]], *([] if past is None else [past])]
                self.past.replace(pd.concat(known).sort_values("seq").drop_duplicates("machine", keep="last"))
                self.recent.replace(recent[~done])
        if later:
            self.timer.at_latest(min(later) // 1000 + 1)

    @staticmethod
    def _held(rows: PackedRows, key: list[str]) -> pd.DataFrame | None:
        held = rows.get()
        return None if held is None else held.drop_duplicates(key, keep="last")

    @staticmethod
    def _answers(asked: pd.DataFrame, recent: pd.DataFrame | None, past: pd.DataFrame | None) -> pd.DataFrame:
        """Of each probe, the units of the entry with the largest seq among its machine's up to its time and the past one."""
        before = {} if past is None else {m: (seq, units) for m, seq, units in past[["machine", "seq", "units"]].itertuples(index=False, name=None)}
        times: dict[int, list[int]] = {}
        newest: dict[int, list[tuple[int, int]]] = {}
        if recent is not None:
            of_asked = recent[recent["machine"].isin(asked["machine"])].sort_values("us")
            for machine, seq, us, units in of_asked[["machine", "seq", "us", "units"]].itertuples(index=False, name=None):
                entries = newest.setdefault(machine, [])
                best = entries[-1] if entries else before.get(machine, (-1, 0))
                entries.append(max(best, (seq, units)))
                times.setdefault(machine, []).append(us)
        units = []
        for machine, us, initial in asked[["machine", "us", "initial"]].itertuples(index=False, name=None):
            k = bisect_right(times.get(machine, []), us)
            units.append(newest[machine][k - 1][1] if k else before.get(machine, (-1, initial))[1])
        return pd.DataFrame({"probe": asked["probe"].to_numpy(), "machine": asked["machine"].to_numpy(), "at": asked["us"].to_numpy().view("datetime64[us]"), "weight": np.array(units, "int64").astype("float64") / UNIT})

    def close(self) -> None:
        pass


def weight_at_stream(operations: DataFrame, probes: DataFrame, machines: DataFrame, lateness: str) -> DataFrame:
    """probe, machine, at and weight of a stream of probes (probe, machine, at) over a stream of operations (machine, seq,
    ts, op, amount), as ledger.weight_at gives them, each once the watermark of both has passed it.

    Rows may come late within `lateness`, operations of a machine by seq; what is later still is dropped. Start the query under
    `sessions.stateful` settings.
    """
    units = lambda c: (F.col(c).cast(EXACT) * UNIT).cast("bigint")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    no = F.lit(0).cast("bigint")
    entered = operations.select("machine", F.col("ts").cast("timestamp").alias("_at"), us("ts").alias("us"), "seq", "op", units("amount").alias("units"), no.alias("probe"), F.lit(False).alias("asks"))
    asked = probes.select("machine", F.col("at").cast("timestamp").alias("_at"), us("at").alias("us"), no.alias("seq"), F.lit("").alias("op"), no.alias("units"), "probe", F.lit(True).alias("asks"))
    both = entered.unionByName(asked).join(machines.select("machine", units("initial").alias("initial")), "machine")
    dealt = both.withWatermark("_at", lateness).withColumn("bucket", bucket_of("machine"))
    return dealt.groupBy("bucket").transformWithStateInPandas(LevelProcessor(), OUT, "Append", "eventTime")


def keep_last_stream(metrics: DataFrame, lateness: str) -> DataFrame:
    """One row for each topic and time of a stream of metrics, that with the largest seq: an update for each row that is
    replaced, as long as the watermark hasn't passed its time. The newest update of a key counts."""
    timed = metrics.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", lateness)
    newest = timed.groupBy("topic", "_at").agg(F.max_by(F.struct("value", "seq"), "seq").alias("_v"))
    return newest.select("topic", F.col("_at").cast("timestamp_ntz").alias("ts"), "_v.value", "_v.seq")
