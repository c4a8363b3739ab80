"""Resharding by minimum-cost flow.

A shard set is a folder of shards, each made of blocks: files of bounded bytes and rows, listed in a manifest. To reshard,
a flow carries the old shards' bytes to the new shards' capacities: what stays in its shard is free, a byte that moves
costs one, so that the cheapest flow moves the fewest bytes. Its amounts are met by whole blocks as far as they go. A
block that falls on a border is cut: its rows are dealt out, largest first, to whoever still takes them. Where rows are
too large to meet an amount, another round evens out what is left; a shard whose largest row is over its capacity keeps
that row, and the others share the rest. Only sizes are moved while this is planned. Then the blocks that move or are cut are rewritten, once, as a
new generation of files, and a new manifest takes over; all other files stay as they are.

The flow is solved on the driver, from one number a shard. Blocks are at most MOST_BLOCKS and those that rounding adds,
so their table is bounded and may be broadcast. No task holds more rows than those of some blocks, whatever their shard.

Defined results: a null text has no bytes; rows that repeat are rows like any others; a row larger than a shard's capacity
makes a shard larger than that; an empty table gives empty shards; equal texts begin in one shard and are parted where
capacities ask for it; all columns are kept, whatever they are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.shared import place, plain, stage, table
from emberline.sources.scratch import scratch_folder

OLD_SHARDS, NEW_SHARDS = 32, 40
#: A block holds so many bytes and rows, or more where there would be over MOST_BLOCKS of them.
BLOCK_BYTES, BLOCK_ROWS, MOST_BLOCKS = 8 << 20, 2048, 1 << 18
#: Rounds of planning, and the part of a shard by which sizes may be off before another one.
ROUNDS, EVEN = 3, 0.002
OVERHEAD = 16


# --------------------------------------------------------------------- flow


def cheapest_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost: shortest augmenting paths by costs
    that potentials keep from being negative."""
    ends, left, price = [], [], []
    out: list[list[int]] = [[] for _ in range(nodes)]
    for a, b, capacity, cost in arcs:
        for x, y, room, each in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(ends))
            ends.append(y)
            left.append(room)
            price.append(each)
    potential = [0] * nodes
    while True:
        far, via = [None] * nodes, [-1] * nodes
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                y, new = ends[e], d + price[e] + potential[x] - potential[ends[e]]
                if left[e] and (far[y] is None or new < far[y]):
                    far[y], via[y] = new, e
                    heapq.heappush(queue, (new, y))
        if far[sink] is None:
            return [left[2 * k + 1] for k in range(len(arcs))]
        potential = [p + (far[sink] if d is None else min(d, far[sink])) for p, d in zip(potential, far)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = ends[via[x] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount


def transfers(old: Sequence[int], new: Sequence[int]) -> list[tuple[int, int, int]]:
    """(from, to, bytes) that bring shards of the sizes old to the sizes new, which have the same sum, with the fewest
    bytes moved; with from = to for what stays. There are fewer of the others than there are shards.

    What moves passes one node in the middle, so that the network has two arcs a shard instead of one a pair.
    """
    n = max(len(old), len(new))
    source, middle, sink = 2 * n, 2 * n + 1, 2 * n + 2
    total = sum(old)
    arcs = [(source, i, size, 0) for i, size in enumerate(old)] + [(n + j, sink, size, 0) for j, size in enumerate(new)]
    first = len(arcs)
    arcs += [(i, n + i, total, 0) for i in range(n)] + [(i, middle, total, 1) for i in range(n)] + [(middle, n + i, total, 0) for i in range(n)]
    flow = cheapest_flow(arcs, 2 * n + 3, source, sink)[first:]
    moves = [(i, i, flow[i]) for i in range(n) if flow[i]]
    gives, takes = [[i, flow[n + i]] for i in range(n) if flow[n + i]], [[i, flow[2 * n + i]] for i in range(n) if flow[2 * n + i]]
    while gives and takes:
        amount = min(gives[-1][1], takes[-1][1])
        moves.append((gives[-1][0], takes[-1][0], amount))
        for side in (gives, takes):
            side[-1][1] -= amount
            if not side[-1][1]:
                side.pop()
    return moves


def even(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


# ------------------------------------------------------------------ planning


def dealt_rows(piece: pd.DataFrame) -> pd.DataFrame:
    """Rows of a cut block with their new shard: each of its amounts takes the largest rows that fit, and hands on what is
    too little for any; the rows that are left go to the shard that they are in, or to the last of the others."""
    piece = piece.sort_values(["size", "nth"], ascending=[False, True], kind="stable")
    own, shares = int(piece["shard"].iloc[0]), [(x["to"], x["bytes"]) for x in piece["shares"].iloc[0]]
    stays = own if any(to == own for to, _ in shares) else shares[-1][0]
    to, sizes = [stays] * len(piece), piece["size"].tolist()
    open_, room = list(range(len(sizes))), 0
    for dest, amount in shares:
        if dest == stays:
            continue
        room += amount  # with what was too little for a row of the one before
        rest = []
        for k in open_:
            if sizes[k] <= room:
                to[k], room = dest, room - sizes[k]
            else:
                rest.append(k)
        open_ = rest
    return piece.assign(shard=to)[["shard", "shard0", "block0", "nth", "size"]].astype({"shard": "int32"})


def moved_once(rows: DataFrame, moves: list[tuple[int, int, int]]) -> DataFrame:
    """rows (shard, shard0, block0, nth, size) with the shard that the moves give each of them."""
    spark, by_shard = rows.sparkSession, {}
    for a, b, amount in sorted(moves, key=lambda m: (m[0], m[0] != m[1], m[1])):
        spans = by_shard.setdefault(a, [])
        low = spans[-1]["high"] if spans else 0
        spans.append({"to": b, "low": low, "high": low + amount})
    spans = spark.createDataFrame(list(by_shard.items()), "shard int, spans array<struct<to:int,low:long,high:long>>")
    pieces = rows.groupBy("shard", "shard0", "block0").agg(F.sum("size").alias("bytes"))
    # old blocks of a shard first, by number, then those that came to it
    order = Window.partitionBy("shard").orderBy(F.col("shard0") != F.col("shard"), "shard0", "block0")
    pieces = pieces.withColumn("high", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    overlap = lambda x: F.least("high", x["high"]) - F.greatest(F.col("high") - F.col("bytes"), x["low"])
    shares = F.filter(F.transform("spans", lambda x: F.struct(x["to"].alias("to"), overlap(x).alias("bytes"))), lambda x: x["bytes"] > 0)
    shares = F.transform(shares, lambda x: F.struct(x["to"].alias("to"), x["bytes"].alias("bytes")))
    pieces = stage(pieces.join(F.broadcast(spans), "shard").select("shard", "shard0", "block0", shares.alias("shares")))
    met = rows.join(F.broadcast(pieces), ["shard", "shard0", "block0"])
    whole = met.where(F.size("shares") == 1).select(F.col("shares")[0]["to"].alias("shard"), "shard0", "block0", "nth", "size")
    cut = met.where(F.size("shares") > 1).groupBy("shard0", "block0", "shard").applyInPandas(dealt_rows, "shard int, shard0 int, block0 int, nth int, size long")
    return whole.unionByName(cut)


def settled(capacities: list[int], largest: list[int]) -> list[int]:
    """Capacities under which each shard can keep its largest row; the others give way, each by the same part."""
    total, over = sum(capacities), set()
    while True:
        rest = [k for k in range(len(capacities)) if k not in over]
        share, weight = max(0, total - sum(largest[k] for k in over)), sum(capacities[k] for k in rest)
        marks = [0, *(share * upto // weight if weight else 0 for upto in accumulate(capacities[k] for k in rest))]
        parts = dict(zip(rest, (b - a for a, b in zip(marks, marks[1:]))))
        more = {k for k in rest if capacities[k] and largest[k] > parts[k]}
        if not more:
            return [largest[k] if k in over else parts[k] for k in range(len(capacities))]
        over |= more


def planned(rows: DataFrame, capacities: list[int], rounds: int = ROUNDS) -> DataFrame:
    """rows (shard0, block0, nth, size) with the new shard of each."""
    now, close = rows.withColumn("shard", F.col("shard0")), EVEN * sum(capacities) / len(capacities)
    for k in range(rounds):
        known = now.groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).collect()  # one row a shard
        n = max([len(capacities), *(r["shard"] + 1 for r in known)])
        old, largest = [0] * n, [0] * n
        for r in known:
            old[r["shard"]], largest[r["shard"]] = r["bytes"], r["largest"]
        wanted = settled(capacities + [0] * (n - len(capacities)), largest)
        if sum(wanted) != sum(old) or k and all(abs(a - b) <= close for a, b in zip(old, wanted)):
            break
        moves = transfers(old, wanted)
        if all(a == b for a, b, _ in moves):
            break
        now = stage(moved_once(now, moves))
    return now


# -------------------------------------------------------------------- files


class ShardSet:
    """Shards of a table in a shared folder: files by generation, shard and block, and the manifest that says which count."""

    def __init__(self, spark: SparkSession, path: str, names: list[str], row: T.StructType, blocks: DataFrame | None = None, generation: int = 0) -> None:
        self.spark, self.path, self.names, self.blocks, self.generation = spark, path, names, blocks, generation
        kinds = [("size", T.LongType()), ("row", row), ("nth", T.IntegerType()), ("shard", T.IntegerType()), ("block", T.IntegerType())]
        self._shape = T.StructType([T.StructField(name, kind) for name, kind in kinds])

    def _write(self, rows: DataFrame, generation: int) -> DataFrame:
        """Write rows (shard, block, size, row), numbered within blocks; their blocks."""
        in_block = Window.partitionBy("shard", "block").orderBy(F.col("size").desc(), F.xxhash64("row"))
        numbered = rows.repartition("shard", "block").withColumn("nth", (F.row_number().over(in_block) - 1).cast("int"))
        # what a run that was cut off before its manifest has left is written over
        numbered.write.mode("overwrite").partitionBy("shard", "block").parquet(f"{self.path}/rows/generation={generation}")
        return self._files(generation).groupBy("shard", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).withColumn("generation", F.lit(generation))

    def _files(self, generation: int) -> DataFrame:
        return self.spark.read.schema(self._shape).parquet(f"{self.path}/rows/generation={generation}")

    def _commit(self, blocks: DataFrame, generation: int) -> None:
        """A manifest: the blocks that count, with the slot of their first row in their shard."""
        before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("rows").over(before), F.lit(0))
        listed = blocks.select("shard", "block", "generation", "rows", "bytes", first.alias("first"))
        # one file, so that it is there as a whole or not at all
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/of={generation}")
        self.blocks, self.generation = self.spark.read.schema(listed.schema).parquet(f"{self.path}/manifest/of={generation}"), generation

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ShardSet:
        """The shard set of a folder, as its newest manifest has it."""
        names = spark.read.parquet(f"{path}/columns").first()["names"]
        newest = spark.read.parquet(f"{path}/manifest").agg(F.coalesce(F.max("of"), F.lit(0))).first()[0]
        row = spark.read.parquet(f"{path}/rows/generation=0").schema["row"].dataType
        return cls(spark, path, names, row, spark.read.parquet(f"{path}/manifest/of={newest}"), newest)

    @classmethod
    def lay_out(cls, docs: DataFrame, path: str, shard: Callable[[dict[str, str]], Column], size: Callable[[dict[str, str]], Column], block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> ShardSet:
        """Write docs as a first generation. shard and size give a row's from the names that columns have in plain(docs)."""
        own = plain(docs)
        at = dict(zip(docs.columns, own.columns))
        rows = own.select(shard(at).cast("int").alias("shard"), size(at).cast("long").alias("size"), F.struct(*own.columns).alias("row"))
        sizes = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        known = sizes.collect()  # one row a shard
        in_bytes, in_rows = sum(r["bytes"] for r in known), sum(r["rows"] for r in known)
        most_bytes, most_rows = max(block_bytes, -(-in_bytes // MOST_BLOCKS)), max(block_rows, -(-in_rows // MOST_BLOCKS))
        counts = docs.sparkSession.createDataFrame([(r["shard"], -(-r["bytes"] // most_bytes), -(-r["rows"] // most_rows)) for r in known], "shard int, a long, b long")
        counts = counts.select("shard", F.greatest("a", "b").alias("blocks"))
        # rows that are alike in all they have go to several blocks too
        block = F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.col("blocks")).cast("int")
        made = cls(docs.sparkSession, path, docs.columns, rows.schema["row"].dataType)
        docs.sparkSession.createDataFrame([(docs.columns,)], "names array<string>").write.parquet(f"{path}/columns")
        made._commit(made._write(rows.join(F.broadcast(counts), "shard").select("shard", block.alias("block"), "size", "row"), 0), 0)
        return made

    def reshard(self, capacities: Callable[[int], list[int]]) -> None:
        """Move rows until shards have the sizes that capacities gives for the sum of all bytes; rewrite what is affected."""
        total = self.blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        held = self._live().select(F.col("shard").alias("shard0"), F.col("block").alias("block0"), "nth", "size")
        plan = planned(stage(held), capacities(total))
        affected = F.max(F.col("shard") != F.col("shard0")).alias("affected")
        blocks = stage(plan.groupBy("shard0", "block0").agg(affected).where("affected").drop("affected"))
        if blocks.isEmpty():
            return
        kept = self.blocks.join(F.broadcast(blocks), (F.col("shard") == F.col("shard0")) & (F.col("block") == F.col("block0")), "left_anti")
        # new blocks are numbered behind all that a shard had
        pieces = plan.join(F.broadcast(blocks), ["shard0", "block0"]).select("shard", "shard0", "block0").distinct()
        behind = self.blocks.groupBy("shard").agg((F.max("block") + 1).alias("next"))
        nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.col("shard0") != F.col("shard"), "shard0", "block0"))
        pieces = stage(pieces.join(behind, "shard", "left").select("shard", "shard0", "block0", (F.coalesce("next", F.lit(0)) + nth - 1).alias("block")))
        # where each row of an affected block goes: one entry a row, so that a block's rows are joined without their texts
        goes = plan.join(F.broadcast(pieces), ["shard", "shard0", "block0"]).select("shard0", "block0", "nth", "shard", "block")
        old = self._live().withColumnsRenamed({"shard": "shard0", "block": "block0"}).join(F.broadcast(blocks), ["shard0", "block0"])
        generation = self.generation + 1
        by_row = old.join(goes, ["shard0", "block0", "nth"]).select("shard", "block", "size", "row")
        self._commit(kept.drop("first").unionByName(self._write(by_row, generation)), generation)

    def _live(self) -> DataFrame:
        """shard, block, first, nth, size and row of all rows that count."""
        rows = self._files(0).limit(0).withColumn("first", F.lit(0).cast("long"))
        for generation in [r[0] for r in self.blocks.select("generation").distinct().orderBy("generation").collect()]:
            own = self.blocks.where(F.col("generation") == generation).select("shard", "block", "first")
            part = self._files(generation).join(F.broadcast(own), ["shard", "block"])
            rows = rows.unionByName(part)
        return rows

    def read(self) -> DataFrame:
        """The table with columns shard and slot (from 0, without gaps) before its own."""
        rows = self._live().select("shard", (F.col("first") + F.col("nth")).alias("slot"), "row.*")
        return rows.toDF("shard", "slot", *self.names)


def op13_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = lambda at: F.coalesce(F.octet_length(at["text"]), F.lit(0)) + OVERHEAD
    shards = ShardSet.lay_out(docs, scratch_folder(spark), lambda at: F.pmod(F.xxhash64(F.coalesce(at["text"], F.lit(""))), F.lit(OLD_SHARDS)), size)
    shards.reshard(lambda total: even(total, NEW_SHARDS))
    rows = shards.read()
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
