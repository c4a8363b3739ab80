"""Machine weight ledgers: levels from operations, as-of lookups and range summaries.

`seq` is the order of insertion. Lookups go by it, not by time: the entry inserted last among those with ts <= at wins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.numbers import both_zeroed
from emberline.sources.scratch import written

#: Sums of weights are exact in this type, whatever order Spark adds in.
EXACT = "decimal(28,6)"
#: Sequence numbers of a machine that one block of the ledger spans, and days of one stretch of as-of lookups.
BLOCK_ENTRIES, BLOCK_DAYS = 1 << 20, 7
#: Children of a node of the tree over the sequence numbers of ledgers that are out of order.
FAN_OUT = 64
CURRENT, POINT, RANGE = "current", "point", "range"


def weight_history(operations: DataFrame, machines: DataFrame, block: int = BLOCK_ENTRIES) -> DataFrame:
    """machine, seq, ts, weight: the level after each load, dispense or reset.

    A reset starts a new segment, in which the level is a running sum; the first segment starts from the machine's
    initial weight. A machine's entries are dealt out in blocks of `block` sequence numbers, so that one busy machine
    is not one task: levels are summed within blocks, and a table with one row for each block carries levels across.
    """
    by_block = Window.partitionBy("machine", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    by_segment = Window.partitionBy("machine", "_block", "_segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    amount = F.col("amount").cast(EXACT)
    entries = operations.select("machine", "seq", "ts", F.expr(f"seq div {block}").alias("_block"), (F.col("op") == "reset").cast("int").alias("_reset"), F.when(F.col("op") == "dispense", -amount).otherwise(amount).alias("_change"))
    within = entries.withColumn("_segment", F.sum("_reset").over(by_block)).withColumn("_level", F.sum("_change").over(by_segment))
    ends = within.groupBy("machine", "_block").agg(F.max("_segment").alias("_resets"), F.max_by("_level", "seq").alias("_end"))
    # a block with a reset sets the level like a reset, any other adds to it
    before = Window.partitionBy("machine").orderBy("_block")
    ends = ends.join(machines.select("machine", F.col("initial").cast(EXACT).alias("_initial")), "machine", "left")
    ends = ends.withColumn("_run", F.sum(F.when(F.col("_resets") > 0, 1).otherwise(0)).over(before))
    reached = F.sum("_end").over(Window.partitionBy("machine", "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce("_initial", F.lit(0).cast(EXACT))
    ends = ends.withColumn("_after", reached + F.when(F.col("_run") == 0, start).otherwise(F.lit(0).cast(EXACT)))
    carried = ends.select("machine", "_block", F.coalesce(F.lag("_after").over(before), start).alias("_carried"))
    level = F.col("_level") + F.when(F.col("_segment") == 0, F.col("_carried")).otherwise(F.lit(0).cast(EXACT))
    return within.join(carried, ["machine", "_block"]).select("machine", "seq", "ts", level.cast("double").alias("weight"))


def _last_entries(entries: DataFrame, asked: DataFrame, block_days: int) -> DataFrame:
    """_probe of asked (machine, _ts, _probe) with _found and _earlier: the greatest _entry of entries (machine, _ts,
    _entry; first field seq) with _ts at most the probe's, and with _ts before it.

    Ledger and probes go through one window by machine and stretch of time; there is no inequality join. A table with
    one row for each machine and stretch carries the last entry of earlier stretches.
    """
    kinds = {c: d.schema[c].dataType for c, d in (("_entry", entries), ("_probe", asked))}
    both = entries.withColumn("_probe", F.lit(None).cast(kinds["_probe"])).unionByName(asked.withColumn("_entry", F.lit(None).cast(kinds["_entry"])))
    both = both.withColumn("_block", F.floor(F.datediff("_ts", F.lit("1970-01-01")) / block_days))
    own = lambda upto: F.expr(f"max(_entry) over (partition by machine, _block order by _ts range between unbounded preceding and {upto})")
    found = both.withColumns({"_own": own("current row"), "_own_before": own("interval '0.000001' second preceding")}).where("_probe is not null")
    ends = both.groupBy("machine", "_block").agg(F.max("_entry").alias("_end"))
    earlier = Window.partitionBy("machine").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.where("_block is not null").select("machine", "_block", F.max("_end").over(earlier).alias("_carried"))
    met = found.join(carried, ["machine", "_block"], "left")
    timed = lambda own: F.when(F.col("_ts").isNotNull(), F.greatest(own, "_carried"))
    return met.select("_probe", timed("_own").alias("_found"), timed("_own_before").alias("_earlier"))


def weight_at(history: DataFrame, probes: DataFrame, machines: DataFrame, at: str = "at", out: str = "weight", block_days: int = BLOCK_DAYS) -> DataFrame:
    """probes (machine, the column `at`, any others) with the weight at that time, else the machine's initial weight."""
    entries = history.select("machine", F.col("ts").alias("_ts"), F.struct("seq", "weight").alias("_entry"))
    asked = probes.select("machine", F.col(at).alias("_ts"), F.struct(*probes.columns).alias("_probe"))
    initial = machines.select(F.col("machine").alias("_m"), F.col("initial").alias("_initial"))
    known = _last_entries(entries, asked, block_days).select("_probe.*", F.col("_found.weight").alias("_weight")).join(initial, F.col("machine") == F.col("_m"), "left")
    return known.select(*probes.columns, F.coalesce("_weight", "_initial").alias(out))


def _running_sums(history: DataFrame, block: int) -> DataFrame:
    """history with up and down (what was gained and lost from the machine's first entry to this one, by seq), next (the
    weight after this one), first (the machine's first weight) and late (whether any entry of the machine has a time
    before that of the entry inserted before it). Blocks of a machine are summed apart, as its levels are."""
    rows = Window.partitionBy("machine", "_block").orderBy("seq")
    until = rows.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(EXACT)
    step = lambda now, before: F.col(now).cast(EXACT) - F.col(before).cast(EXACT)
    gain, loss = (lambda d: F.coalesce(F.greatest(d, zero), zero)), (lambda d: F.coalesce(F.greatest(-d, zero), zero))
    h = history.select("machine", "seq", "ts", "weight", F.expr(f"seq div {block}").alias("_block"))
    h = h.withColumns({"_before": F.lag("weight").over(rows), "next": F.lead("weight").over(rows), "_late": F.lag("ts").over(rows) > F.col("ts")})
    h = h.withColumns({"up": F.sum(gain(step("weight", "_before"))).over(until), "down": F.sum(loss(step("weight", "_before"))).over(until)})
    ends = h.groupBy("machine", "_block").agg(
        F.min_by(F.struct("weight", "ts"), "seq").alias("_f"), F.max_by(F.struct("weight", "ts"), "seq").alias("_l"), F.max("up").alias("_up"), F.max("down").alias("_down"), F.max("_late").alias("_late")
    )
    blocks = Window.partitionBy("machine").orderBy("_block")
    all_of_it = Window.partitionBy("machine")
    ends = ends.withColumns({"_last": F.lag("_l.weight").over(blocks), "_first": F.col("_f.weight"), "_next": F.lead("_f.weight").over(blocks), "first": F.min_by("_f.weight", "_block").over(all_of_it)})
    ends = ends.withColumn("_late", F.coalesce("_late", F.lit(False)) | F.coalesce(F.lag("_l.ts").over(blocks) > F.col("_f.ts"), F.lit(False)))
    ends = ends.withColumns({"_in": gain(step("_first", "_last")), "_out": loss(step("_first", "_last")), "late": F.max("_late").over(all_of_it)})
    run = blocks.rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda own, cross: F.sum(F.col(own) + F.col(cross)).over(run) - F.col(own)
    ends = ends.select("machine", "_block", "first", "late", "_next", carry("_up", "_in").alias("_up0"), carry("_down", "_out").alias("_down0"))
    met = h.drop("_late").join(ends, ["machine", "_block"])
    return met.select("machine", "seq", "ts", "weight", F.coalesce("next", "_next").alias("next"), "first", "late", (F.col("up") + F.col("_up0")).cast(EXACT).alias("up"), (F.col("down") + F.col("_down0")).cast(EXACT).alias("down"))


def _gain(now: Column, before: Column) -> Column:
    return F.coalesce(F.greatest(now.cast(EXACT) - before.cast(EXACT), F.lit(0).cast(EXACT)), F.lit(0).cast(EXACT))


def _combined(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces (by, at, first and last weight, up and down within) put together in the order of `at`, those of each group."""
    last = F.lag("last").over(Window.partitionBy(*by).orderBy("at"))
    joined = pieces.withColumns({"up": F.col("up") + _gain(F.col("first"), last), "down": F.col("down") + _gain(last, F.col("first"))})
    return joined.groupBy(*by).agg(F.min("at").alias("at"), F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last"), F.sum("up").cast(EXACT).alias("up"), F.sum("down").cast(EXACT).alias("down"))


def _walked(sums: DataFrame, ranges: DataFrame, most: int) -> DataFrame:
    """first (weight), up and down of ranges (probe, machine, from, to) over the entries of from <= ts < to, by seq,
    whatever order their times have; sums are those of _running_sums, most is their greatest seq.

    A tree over a machine's sequence numbers has FAN_OUT children a node, and of each the first and last time. A range
    goes down from the root: a node whose times are all in the range is taken as a whole, by its running sums; one that
    has none is left; only a node with some sends the range on to its children. So what a range walks are the ends of
    the range and the nodes that late entries stretch over an end, not its entries.
    """
    key = ["probe", "machine", "from", "to"]
    level = 1
    while FAN_OUT**level <= most:
        level += 1
    ranges = ranges.withColumn("_parent", F.lit(0).cast("bigint"))
    pieces = None
    for k in range(level - 1, -1, -1):
        number = F.expr(f"seq div {FAN_OUT**k}")
        nodes = sums.groupBy("machine", number.alias("_node")).agg(
            F.min("ts").alias("_since"), F.max("ts").alias("_until"), (F.count("*") > F.count("ts")).alias("_untimed"), F.min("seq").alias("at"), F.min_by("weight", "seq").alias("first"), F.max_by("weight", "seq").alias("last"),
            (F.max("up") - F.min("up")).cast(EXACT).alias("up"), (F.max("down") - F.min("down")).cast(EXACT).alias("down"),
        )
        nodes = nodes.withColumn("_parent", F.expr(f"_node div {FAN_OUT}"))
        met = ranges.join(nodes, ["machine", "_parent"]).where((F.col("_until") >= F.col("from")) & (F.col("_since") < F.col("to")))
        whole = (F.col("_since") >= F.col("from")) & (F.col("_until") < F.col("to")) & ~F.col("_untimed")
        met = written(met.withColumn("_whole", whole).select(*key, "_node", "_whole", "at", "first", "last", "up", "down"))
        taken = met.where("_whole").drop("_whole", "_node")
        pieces = taken if pieces is None else pieces.unionByName(taken)
        ranges = met.where("not _whole").select(*key, F.col("_node").alias("_parent"))
    # a range over very many pieces is put together in stretches first
    stretches = _combined(pieces.withColumn("_stretch", F.expr(f"at div {FAN_OUT**3}")), [*key, "_stretch"]).drop("_stretch")
    return _combined(stretches, key)


def states(history: DataFrame, probes: DataFrame, machines: DataFrame, collapse_ties: bool = False, block: int = BLOCK_ENTRIES, block_days: int = BLOCK_DAYS) -> DataFrame:
    """probes (probe, machine, from, to; no two alike) with initial (weight at `from`), weight (at `to`), and loaded and
    dispensed over from <= ts < to. Starts jobs: the running sums are written first.

    Entries are walked by seq from the weight at `from`, which already holds entries at `from`; so several of them
    count as dispensed and loaded again. collapse_ties keeps only the last entry of each time instead.

    All four come from one pass over the ledger: with sums of gains and losses kept by entry, a range is the difference
    of two entries, put right for its first one. Ranges of machines whose entries were inserted out of order of time go
    through a tree of those sums instead.
    """
    if collapse_ties:
        history = history.groupBy("machine", "ts").agg(F.max("seq").alias("seq"), F.max_by("weight", "seq").alias("weight"))
    sums = written(_running_sums(history, block))
    key = ["probe", "machine", "from", "to"]
    two = F.array(*[F.struct(F.lit(name).alias("which"), F.col(name).alias("at")) for name in ("from", "to")])
    asked = probes.select("machine", F.struct(*key).alias("_p"), F.explode(two).alias("_s")).select("machine", F.col("_s.at").alias("_ts"), F.struct("_p", F.col("_s.which").alias("which")).alias("_probe"))
    entries = sums.select("machine", F.col("ts").alias("_ts"), F.struct("seq", "weight", "up", "down", "next", "first", "late").alias("_entry"))
    found = _last_entries(entries, asked, block_days)
    pick = lambda which, column, name: F.max(F.when(F.col("_probe.which") == which, F.col(column))).alias(name)
    wide = found.groupBy("_probe._p").agg(pick("from", "_earlier", "_before"), pick("from", "_found", "_base"), pick("to", "_earlier", "_last"), pick("to", "_found", "_end"))
    known = machines.select(F.col("machine").alias("_m"), F.col("initial").alias("_initial"))
    met = wide.select("_p.*", "_before", "_base", "_last", "_end").join(known, F.col("machine") == F.col("_m"), "left").drop("_m")
    met = met.withColumns({"_weight": F.coalesce("_base.weight", "_initial"), "_late": F.coalesce("_last.late", F.lit(False))})
    zero = F.lit(0).cast(EXACT)
    some = F.col("from").isNotNull() & F.coalesce(F.col("_last.seq") > F.col("_before.seq"), F.col("_last").isNotNull() & F.col("_before").isNull())
    first = F.when(F.col("_before").isNull(), F.col("_last.first")).otherwise(F.col("_before.next"))

    def total(name: str, rise: Callable[[Column], Column]) -> Column:
        whole = F.col(f"_last.{name}") - F.coalesce(f"_before.{name}", zero)
        return F.when(some, whole - F.when(F.col("_before").isNull(), zero).otherwise(rise(F.col("_before.weight"))) + rise(F.col("_weight"))).otherwise(zero).cast("double")

    told = met.select(*key, F.col("_weight").alias("initial"), F.coalesce("_end.weight", "_initial").alias("weight"), total("up", lambda w: _gain(first, w)).alias("_in"), total("down", lambda w: _gain(w, first)).alias("_out"), "_late")
    out = told.select(*key, "initial", "weight", "_late", "_in", "_out")
    most = sums.where("late").agg(F.max("seq")).first()[0]
    if most is not None:
        machines_late = sums.where("late").select("machine").distinct()
        walked = _walked(sums.where("late"), probes.select(*key).join(machines_late, "machine", "left_semi"), most)
        walked = walked.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("first").alias("_first"), F.col("up").alias("_up"), F.col("down").alias("_down"))
        out = out.join(walked, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]), "left")
        base = F.col("initial")
        slow_in, slow_out = (F.coalesce(F.col(c) + g, zero).cast("double") for c, g in (("_up", _gain(F.col("_first"), base)), ("_down", _gain(base, F.col("_first")))))
        out = out.withColumns({"_in": F.when(F.col("_late"), slow_in).otherwise(F.col("_in")), "_out": F.when(F.col("_late"), slow_out).otherwise(F.col("_out"))})
    return out.select(*key, "initial", "weight", *both_zeroed(F.col("_in"), F.col("_out")))


def range_summary(history: DataFrame, probes: DataFrame, machines: DataFrame, collapse_ties: bool = False) -> DataFrame:
    """probes (probe, machine, from, to) with loaded and dispensed over from <= ts < to, as `states` tells."""
    return states(history, probes, machines, collapse_ties).select(*probes.columns, "loaded", "dispensed")


def current_weights(history: DataFrame, machines: DataFrame) -> DataFrame:
    """machine and weight: that of the entry inserted last, else the machine's initial one."""
    last = history.groupBy("machine").agg(F.max_by("weight", "seq").alias("_w"))
    return machines.select("machine", "initial").join(last, "machine", "left").select("machine", F.coalesce("_w", "initial").alias("weight"))


def snapshot_map(history: DataFrame, machines: DataFrame, readings: DataFrame) -> DataFrame:
    """machine, weight and readings: a map from each sensor that the machine has to its timestamp, value and unit, for
    machines whose sensors aren't known beforehand. F.map_keys and F.map_values list them."""
    of = readings.groupBy("machine").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sensor", F.struct("timestamp", "value", "unit"))))).alias("readings"))
    return current_weights(history, machines).join(of, "machine", "left")


def current_snapshot(history: DataFrame, machines: DataFrame, readings: DataFrame, sensor_names: list[str]) -> DataFrame:
    """machine, weight (inserted last, else initial), and a struct of timestamp, value and unit for each sensor.

    readings: machine, sensor, timestamp, value, unit, one row for each sensor of a machine.
    """
    if "weight" in sensor_names:
        raise ValueError("a sensor can't be named weight")
    weights = current_weights(history, machines)
    wide = readings.groupBy("machine").pivot("sensor", sensor_names).agg(F.first(F.struct("timestamp", "value", "unit")))
    return weights.join(wide, "machine", "left")


def chronology(history: DataFrame, machines: DataFrame, query: str, probes: DataFrame | None = None, **options: object) -> DataFrame:
    """Dispatch by kind of query: "current", "point" or "range"."""
    if query == CURRENT:
        return current_snapshot(history, machines, **options)
    if query == POINT:
        return weight_at(history, probes, machines, **options)
    if query == RANGE:
        return range_summary(history, probes, machines, **options)
    raise ValueError(f"unknown query {query!r}")
