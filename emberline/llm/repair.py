"""Repair of conversations' structure by shortest paths over a bucket queue.

A conversation's rows and the states of the role order `(s?(ua)+)?` (nothing yet, after system, user or assistant) are
the nodes of a graph; edits are its arcs, with small integer costs: keep a row, rerole it, delete it, or insert an empty
turn. Dial's algorithm gives each node its distance to the end, with a list of nodes for each distance in place of a
heap. From the beginning on, the path then takes, of the arcs that keep the distance tight, the one of the least initial;
so of all cheapest repairs it is the one with the least audit.

No task has to hold a whole conversation. Rows are sorted over ranges of conversation and turn, and a range holds a
segment of a conversation that goes on in the next one. Rows of a segment come as codes, without texts. Of a conversation with
several segments, each gives the costs from its first states to its last ones; these small tables, put together from the
end, give each segment the distances that it leads to, and its walks from each state are put together from the beginning.
Last, rows and audits are streamed through in order, row by row, to write or hash what is repaired.

Faults of a row: `blank` has nothing but ASCII white space, `duplicate` has role and text of an earlier row, `truncated`
doesn't end (white space aside) with one of `.!?`. The first of them counts. Blank and duplicate rows must go; a truncated
one that doesn't go adds to the cost.

Defined results: a null role or text is one space; null turns come first; a null id is a conversation of its own; rows of
one turn go by a hash of role and text; only a role's first letter counts, and one without
any can't be kept; a conversation without rows (all were lost) has zeros, an empty audit and the hash of nothing; very
long texts are streamed, one row at a time; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberline.llm.shared import join_splitting_hot, place, plain, stage, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States: nothing yet, after system, after user, after assistant; the state after a role of an initial, from each.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NONE, SYSTEM, USER, ASSISTANT)
AFTER = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that an inserted or reroled turn has in each state, and the state after it.
NEXT_ROLE = {NONE: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}


# ------------------------------------------------------------------- graph


def arcs_from(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows passed, state) of each edit in front of a row, by initial.

    code: the initial of the row's role, `-` for one that no state takes; in upper case, or `=`, if the row is truncated;
    `x` if it must go.
    """
    made = [(INSERT, COSTS[INSERT], 0, NEXT_ROLE[state][1]), (DELETE, COSTS[DELETE], 1, state)]
    if code != "x":
        extra = TRUNCATED if code in "SUA=" else 0
        made.append((REROLE, COSTS[REROLE] + extra, 1, NEXT_ROLE[state][1]))
        kept = AFTER.get(code.lower(), {}).get(state)
        if kept is not None:
            made.append((KEEP, COSTS[KEEP] + extra, 1, kept))
    return sorted(made)


ARCS = {(c, q): arcs_from(c, q) for c in "suaSUA-=x" for q in STATES}
#: The same by where they lead: (cost, state before) of arcs that pass a row of a code, and of those that pass none.
PASSING = {c: [[(cost, q) for q in STATES for _, cost, passed, to in ARCS[c, q] if passed and to == end] for end in STATES] for c in "suaSUA-=x"}
STANDING = [[(COSTS[INSERT], q) for q in STATES if NEXT_ROLE[q][1] == end] for end in STATES]


def distances(codes: str, ends: Sequence[int]) -> list[int]:
    """Cost of the cheapest path from each node (4 * row + state) on; -1 where there is none. ends: what each state behind
    the last row still costs, -1 where it is no end. Dial: nodes wait in a bucket for each distance, emptied in turn."""
    n = len(codes)
    far = [-1] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(max(ends) + 1)]
    for state, cost in enumerate(ends):
        if cost >= 0:
            buckets[cost].append(4 * n + state)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:
            if far[node] >= 0:
                continue
            far[node] = d
            row, state = node >> 2, node & 3
            leading = [(d + cost, 4 * row + q) for cost, q in STANDING[state]] if row < n else []
            if row:
                leading += [(d + cost, 4 * row - 4 + q) for cost, q in PASSING[codes[row - 1]][state]]
            for at, before in leading:
                if far[before] < 0:
                    while len(buckets) <= at:
                        buckets.append([])
                    buckets[at].append(before)
        buckets[d] = []
        d += 1
    return far


def walk(codes: str, far: list[int], state: int) -> tuple[str, int]:
    """Edits from a state in front of the first row on, by tight arcs of the least initial, and the state behind the last."""
    row, audit = 0, []
    while row < len(codes):
        here = far[4 * row + state]
        edit, passed, state = next((edit, passed, to) for edit, cost, passed, to in ARCS[codes[row], state] if far[4 * (row + passed) + to] >= 0 and far[4 * (row + passed) + to] + cost == here)
        audit.append(edit)
        row += passed
    return "".join(audit), state


#: What the turns cost that are inserted behind the last row, by state: after system two, after user one.
TAIL = [0, 2 * COSTS[INSERT], COSTS[INSERT], 0]


# ---------------------------------------------------------------- segments


def costs_across(codes: str) -> list[int]:
    """Cost from each state in front of a segment to each behind it, one behind the other; -1 where there is no way."""
    to = [distances(codes, [0 if q == end else -1 for q in STATES]) for end in STATES]
    return [to[end][q] for q in STATES for end in STATES]


def ends_of_segments(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the segments of one conversation: what each state behind them still costs."""
    rows = rows.sort_values("part", kind="stable")
    behind, out = TAIL, []
    for across in reversed(rows["across"].tolist()):
        out.append(behind)
        behind = [min(across[4 * q + e] + behind[e] for e in STATES if across[4 * q + e] >= 0) for q in STATES]
    return rows[["conv", "part"]].assign(ends=out[::-1], last=[False] * (len(out) - 1) + [True])


def begins_of_segments(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the segments of one conversation: the state that each begins in, where the walk over the one before has ended."""
    rows, state, begins = rows.sort_values("part", kind="stable"), NONE, []
    for behind in rows["behind"]:
        begins.append(state)
        state = int(behind[state])
    return rows[["conv", "part"]].assign(begin=begins)


def ordered_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, h1, h2 (of role and text), part and pos: pos rises in the order of conversations and their
    rows, and part names the range that holds a row. Written once, as ranges are cut by a sample."""
    own = plain(conversations)
    at = {name: place(conversations, c) for name, c in (("conv", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))}
    filled = lambda c: F.coalesce(F.col(at[c]).cast("string"), F.lit(" ")).alias(c)
    rows = own.select(F.col(at["conv"]).alias("conv"), F.col(at["turn"]).alias("turn"), filled("role"), filled("text"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1)), "_at": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "h1", "_at")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ranged.drop("_at").withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, part, pos, role's initial, fault (blank, duplicate, truncated or null) and code of each ordered row."""
    thin = rows.select("conv", "turn", "part", "pos", "h1", "h2", F.substring("role", 1, 1).alias("initial"), F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).alias("end"))
    seen = stage(thin.groupBy("conv", "h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = join_splitting_hot(thin, seen, ["conv", "h1", "h2"], "n", thin.count(), "left")
    fault = F.when(F.col("end") == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    known = met.withColumn("fault", fault)
    cut = F.coalesce(F.col("fault") == "truncated", F.lit(False))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.when(cut, F.upper("initial")).otherwise(F.col("initial"))).otherwise(F.when(cut, "=").otherwise("-"))
    return known.select("conv", "turn", "part", "pos", "initial", "fault", F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(role).alias("code"))


def audited(coded: DataFrame, conv: str) -> DataFrame:
    """conv, part, begin (state), audit and cost of each segment. conv: the type of conversations' ids."""
    in_order = F.sort_array(F.collect_list(F.struct("pos", "code")))
    segments = stage(coded.groupBy("conv", "part").agg(F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes")))
    # a conversation with several segments goes on over the border of a range, and each border has one at most
    several = segments.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("_conv"))
    long = segments.join(F.broadcast(several), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["conv", "part"]].assign(across=[costs_across(c) for c in pdf["codes"]])

    tables = long.mapInPandas(across, f"conv {conv}, part int, across array<int>")
    ends = tables.groupBy("conv").applyInPandas(ends_of_segments, f"conv {conv}, part int, ends array<int>, last boolean")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    met = segments.join(F.broadcast(stage(ends).withColumnsRenamed({"conv": "_conv", "part": "_part"})), same, "left").select("conv", "part", "codes", "ends", F.coalesce("last", F.lit(True)).alias("last"))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            audits, behind, costs = [], [], []
            for codes, ends_, last in zip(pdf["codes"], pdf["ends"], pdf["last"]):
                alone = ends_ is None
                own = TAIL if alone else [int(x) for x in ends_]
                far = distances(codes, own)
                ways = [walk(codes, far, q) for q in ([NONE] if alone else STATES)]
                audits.append([edits + INSERT * (TAIL[end] // COSTS[INSERT] if last else 0) for edits, end in ways])
                behind.append([end for _, end in ways])
                costs.append([far[q] - (0 if last else own[end]) for q, (_, end) in enumerate(ways)])
            yield pdf[["conv", "part"]].assign(audits=audits, behind=behind, costs=costs)

    ways = stage(met.mapInPandas(walked, f"conv {conv}, part int, audits array<string>, behind array<int>, costs array<long>"))
    begins = ways.where(F.size("behind") > 1).select("conv", "part", "behind").groupBy("conv").applyInPandas(begins_of_segments, f"conv {conv}, part int, begin int")
    picked = ways.join(F.broadcast(stage(begins).withColumnsRenamed({"conv": "_conv", "part": "_part"})), same, "left").withColumn("begin", F.coalesce("begin", F.lit(NONE)))
    return stage(picked.select("conv", "part", "begin", F.get("audits", "begin").alias("audit"), F.get("costs", "begin").alias("cost")))


# ------------------------------------------------------------------ result


def turns_of(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that the edits of a segment make of its rows."""
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit != KEEP:
            role, state = NEXT_ROLE[state]
        else:
            state = AFTER[role[:1]][state]
        yield role, text


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "pos", "role", "text", "begin")))


def _streams(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of each conversation in order, and in front of each segment's a row with its audit in place of the text."""
    none = F.lit(None)
    heads = audits.select("conv", "part", F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("role"), F.col("audit").alias("text"), "begin")
    both = heads.unionByName(rows.select("conv", "part", "pos", "role", "text", none.cast("int").alias("begin")))
    return both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "pos")


class _Streamed:
    """Turns of a task's conversations, one by one. Nothing but a row and a segment's audit is held."""

    def __init__(self, rows: Iterator[tuple]) -> None:
        self.rows, self.head, self.pairs = rows, next(rows, None), 0

    def conversations(self) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
        while self.head is not None:
            conv, self.illegal, self.last = self.head[0], 0, None
            yield conv, self._turns(conv)

    def _turns(self, conv: object) -> Iterator[tuple[str, str]]:
        while self.head is not None and self.head[0] == conv:
            audit, begin = self.head[4], self.head[5]
            self.head = next(self.rows, None)
            yield from turns_of(audit, begin, self._segment(conv))

    def _segment(self, conv: object) -> Iterator[tuple[str, str]]:
        while self.head is not None and self.head[0] == conv and self.head[2] >= 0:
            _, _, _, role, text, _ = self.head
            initial = role[:1]
            self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            self.head = next(self.rows, None)
            yield role, text


def _parts(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = ordered_rows(conversations, conv_col, turn_col, role_col, text_col)
    coded = stage(faults(rows))
    return rows, coded, audited(coded, kind), kind


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn (from 0), role and text of all conversations as they are repaired."""
    rows, _, audits, kind = _parts(conversations, conv_col, turn_col, role_col, text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, turns in _Streamed(_in_order(batches)).conversations():
            for n, (role, text) in enumerate(turns):
                out.append((conv, n, role, text))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pydict(dict(zip(("conv", "turn", "role", "text"), zip(*out))))
                    out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("conv", "turn", "role", "text"), zip(*out))))

    return _streams(rows, audits).mapInArrow(of, f"conv {kind}, turn long, role string, text string")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv, gaps (in its turns), blank, duplicate, truncated and illegal (rows and adjacent pairs
    as they came), cost and audit of the repair, and the hash of what is repaired."""
    rows, coded, audits, kind = _parts(conversations, conv_col, turn_col, role_col, text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stream = _Streamed(_in_order(batches))
        for conv, turns in stream.conversations():
            digest, mark = hashlib.sha256(), b""
            for role, text in turns:
                digest.update(mark + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                mark = b"\n"
            out.append((conv, stream.illegal, digest.hexdigest()))
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], made_of), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["conv", "illegal", "repaired_sha256"])

    made_of = to_arrow_type(conversations.schema[conv_col].dataType)
    hashed = _streams(rows, audits).mapInArrow(of, f"conv {kind}, illegal long, repaired_sha256 string")
    is_ = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counted = coded.groupBy("conv").agg(gaps, is_("blank"), is_("duplicate"), is_("truncated"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit")
    told = audits.groupBy("conv").agg(F.sum("cost").alias("cost"), joined)
    for more in (told, hashed):
        more = more.withColumnRenamed("conv", "_conv")
        counted = counted.join(more, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return counted.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations, some lost, emptied, stripped of ends of sentences, repeated or given to the user, by a
    checksum of conversation and turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).alias("_by"))
    text = F.when(F.col("_by") == 1, "").when(F.col("_by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_by") == 4, "user").otherwise(F.col("role"))
    made = rows.where("_by != 0").withColumns({"text": text, "role": role})
    return made.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def op12_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    all_ids = conversations.select("conv_id").distinct()
    found = repair(damaged(conversations))
    met = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
