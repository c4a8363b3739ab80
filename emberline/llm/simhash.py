"""SimHash near-dedup: a self-join of fingerprints over binary tries.

Pairs of trie nodes are walked down together, level by level, with the differing bits so far, to single leaves; a pair
of nodes goes as soon as it is over the budget, or once both nodes lie in one component already. A task returns a
spanning forest of the links it found, at most one edge for each fingerprint, never all pairs.

One trie for all fingerprints can't be shared out: near its root each node must meet hundreds of others. So the trie is
laid out several times, each time with other bits on top. Of BUDGET + s blocks that make up the 64 bits, two
fingerprints within the budget agree on at least s; a layout for each choice of s blocks, with these on top, has every
such pair in one sub-trie under a shared top, and sub-tries with different tops need no visit. s grows with the number
of fingerprints, so that an evenly filled sub-trie has far fewer than MAX_NODE. A sub-trie that has more nonetheless is
laid out again, BUDGET + 1 times, with a block of the bits below its top moved up, until none has more: fingerprints
are distinct, so a sub-trie with few bits left is small. A fingerprint is copied once for each layout (5, 15, 35 or 70 times),
and BUDGET + 1 times for each further layout of a crowded place, whatever the number of rows.

Only distinct fingerprints are joined. Components come from rounds of star contraction over the forest edges, with each
round written to the shared scratch folder.

Defined results: a null, empty or wordless text has fingerprint zero, linked like any other; under 4 words the whole
sequence is the one shingle; equal texts share a fingerprint and so a component; null ids never name a component that
has other ids; repeated rows stay; an empty table gives no rows; other columns are ignored, whatever they are called,
or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.shared import drop_staged, join_splitting_hot, match_rows, place, plain, restored, stage, table

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Fingerprints of a sub-trie that one task takes; a larger one is laid out again.
MAX_NODE = 50_000
#: Shared top bits up to which a sub-trie is laid out again; below, it has at most 2**(63 - SPLIT_TO) fingerprints.
SPLIT_TO = 48
#: Rows that one partition gets on average.
PER_TASK = 200_000
#: Node pairs or leaf pairs held at once while a trie is walked.
CHUNK = 1 << 20


# ---------------------------------------------------------------- fingerprints


def text_digest(text: str) -> F.Column:
    """SHA-256 of the text as it is, in hex."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of `shingle` words (ASCII lower case, ASCII white space between words), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, n - shingle + 1)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if over half of the shingle hashes have it. Signed, as Spark's long."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK // 16):
        part = hashes[at : at + CHUNK // 16]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """id and fp of every row of docs; with digest also the text's."""
    more = ["digest"] if digest else []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([simhash(t.as_py(), shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), fp, *batch.columns[2:]], ["id", "fp", *more])

    kind = docs.schema[id_col].dataType.simpleString()
    text = place(docs, text_col)
    rows = plain(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(text).alias("text"), *[text_digest(text).alias(n) for n in more])
    return rows.mapInArrow(of, f"id {kind}, fp long" + "".join(f", {n} string" for n in more))


# ------------------------------------------------------------------ trie walk


def merge_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union of the components of u[i] and v[i]; root[i] is the smallest member of i's component, before and after."""
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(ru[apart], rv[apart]), np.minimum(ru[apart], rv[apart]))
        while not np.array_equal(up := root[root], root):
            root = up


def pairs_below(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of leaves under each pair of nodes; for a node with itself each pair once."""
    wide = bhi - blo
    each = (ahi - alo) * wide
    of = np.repeat(np.arange(len(each)), each)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    i, j = alo[of] + nth // wide[of], blo[of] + nth % wide[of]
    keep = i < j
    return i[keep], j[keep]


def walk_tries(keys: np.ndarray, nodes: tuple[np.ndarray, ...], budget: int = BUDGET) -> np.ndarray:
    """Component roots of the leaves (positions in keys) by the links under the given pairs of nodes.

    keys: unsigned 64-bit, rising inside each node. nodes: arrays alo, ahi, blo, bhi, differing bits so far, depth;
    all leaves of a node share the bits above its depth.
    """
    root = np.arange(len(keys))
    zeros: dict[int, np.ndarray] = {}
    turns = np.arange(len(keys))

    def split_at(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in zeros:
            clear = (keys >> np.uint64(63 - depth)) & np.uint64(1) == 0
            zeros[depth] = np.concatenate(([0], np.cumsum(clear, dtype=np.int64)))
        return lo + zeros[depth][hi] - zeros[depth][lo]

    alo, ahi, blo, bhi, off, depth = nodes
    work = [tuple(x[depth == d] for x in (alo, ahi, blo, bhi, off)) + (int(d),) for d in np.unique(depth)[::-1]]
    while work:
        alo, ahi, blo, bhi, off, d = work.pop()
        if len(alo) > CHUNK // 4:
            half = len(alo) // 2
            work += [(alo[s], ahi[s], blo[s], bhi[s], off[s], d) for s in (slice(half, None), slice(half))]
            continue
        one = (turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (root[alo] == root[blo])
        if one.any():
            alo, ahi, blo, bhi, off = (x[~one] for x in (alo, ahi, blo, bhi, off))
        few = ((ahi - alo) * (bhi - blo) == 1) | (d == 64)
        if few.any():
            i, j = pairs_below(alo[few], ahi[few], blo[few], bhi[few])
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                root = merge_roots(root, i[near], j[near])
                turns = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
            alo, ahi, blo, bhi, off = (x[~few] for x in (alo, ahi, blo, bhi, off))
        if not len(alo):
            continue
        am, bm = split_at(alo, ahi, d), split_at(blo, bhi, d)
        own = (alo == blo) & (ahi == bhi)
        across = [(alo, am, bm, bhi, off + 1, np.ones(len(own), bool)), (am, ahi, blo, bm, off + 1, ~own)]
        along = [(alo, am, blo, bm, off, np.ones(len(own), bool)), (am, ahi, bm, bhi, off, np.ones(len(own), bool))]
        for group in (across, along):  # the last pushed goes first: equal halves join leaves soonest, which prunes the rest
            kids = [np.concatenate(x) for x in zip(*group)]
            ok = kids[5] & (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)
            if ok.any():
                work.append(tuple(x[ok] for x in kids[:5]) + (d + 1,))
    return root


def blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of so many blocks that make up 64 bits."""
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def layouts(n: int, budget: int, max_node: int) -> list[list[tuple[int, int]]]:
    """Orders of the blocks of a fingerprint, and how many stand on top, so that n spread fingerprints fill no sub-trie."""
    for shared in range(1, 5):
        cut = blocks(budget + shared)
        if n <= (max_node // 4) << min(sum(w for _, w in c) for c in combinations(cut, shared)):
            break
    return [([*top, *(x for x in cut if x not in top)], sum(w for _, w in top)) for top in combinations(cut, shared)]


def _gathered(order: list[tuple[int, int]]) -> str:
    """SQL of fp with its blocks in this order from the top."""
    out, at = [], 0
    for a, w in order:
        at += w
        out.append(f"shiftleft(shiftrightunsigned(fp, {64 - a - w}) & {(1 << w) - 1}L, {64 - at})")
    return "(" + " | ".join(out) + ")"


def _laid_again(budget: int) -> F.Column:
    """Array of (layout, bits, turned) that put each block of the bits below the top up to the others."""
    each = []
    for j in range(budget + 1):
        first, after = f"(bits + (64 - bits) * {j} div {budget + 1})", f"(bits + (64 - bits) * {j + 1} div {budget + 1})"
        first, after = f"cast({first} as int)", f"cast({after} as int)"
        top = "shiftleft(shiftrightunsigned(turned, 64 - bits), 64 - bits)"
        own = f"shiftleft(shiftrightunsigned(shiftleft(turned, {first}), 64 - {after} + {first}), 64 - bits - {after} + {first})"
        skipped = f" | shiftleft(shiftrightunsigned(shiftleft(turned, bits), 64 - {first} + bits), 64 - {after})" if j else ""
        rest = f"(turned & (shiftleft(1L, 64 - {after}) - 1))"
        each.append(f"struct(layout * 16 + {j + 1} as layout, bits + {after} - {first} as bits, ({top} | {own}{skipped} | {rest}) as turned)")
    return F.expr(f"array({', '.join(each)})")


def forest_of_partition(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Spanning forest (u > v by fingerprint) of the links among rows with the same layout and top."""
    order = np.lexsort((pdf["turned"].to_numpy().view(np.uint64), pdf["layout"].to_numpy()))
    layout, bits, turned, fp = (pdf[c].to_numpy()[order] for c in ("layout", "bits", "turned", "fp"))
    turned = turned.view(np.uint64)
    top = turned >> (64 - bits).astype(np.uint64)
    new = np.ones(len(order), bool)
    new[1:] = (layout[1:] != layout[:-1]) | (top[1:] != top[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(order))
    start, end = start[end - start > 1], end[end - start > 1]
    nodes = (start, end, start, end, np.zeros(len(start), np.int64), bits[start].astype(np.int64))
    root = walk_tries(turned, nodes, budget)
    led = np.flatnonzero(root != np.arange(len(root)))
    a, b = fp[led], fp[root[led]]
    return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})


def laid_out(distinct: DataFrame, n: int, budget: int = BUDGET, max_node: int = MAX_NODE) -> tuple[DataFrame, int]:
    """Rows layout, bits, turned, top and fp of the n fingerprints, and their number. Fingerprints that share layout and
    top make up a sub-trie, of at most max_node; any two within the budget share one at least."""
    top = F.expr("shiftrightunsigned(turned, 64 - bits)").alias("top")
    first = [f"struct({k}L as layout, {bits} as bits, {_gathered(order)} as turned)" for k, (order, bits) in enumerate(layouts(n, budget, max_node), 1)]
    laid = distinct.select("fp", F.inline(F.expr(f"array({', '.join(first)})"))).select("layout", "bits", "turned", top, "fp")
    count, done, total = n * len(first), [], 0
    while True:
        crowded = stage(laid.where(f"bits <= {SPLIT_TO}").groupBy("layout", "top").agg(F.count("*").alias("size")).where(F.col("size") > max_node))
        if crowded.isEmpty():
            done.append(laid)
            total += count
            break
        met = join_splitting_hot(laid, crowded.withColumn("crowd", F.col("size")), ["layout", "top"], "size", count, "left")
        done.append(met.where("crowd is null").drop("crowd"))
        again = met.where("crowd is not null").select("fp", F.col("bits").alias("bits"), "layout", "turned")
        laid = stage(again.select("fp", F.inline(_laid_again(budget))).select("layout", "bits", "turned", top, "fp"))
        total += count
        count = laid.count()
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows, total


def link_forest(distinct: DataFrame, budget: int = BUDGET, max_node: int = MAX_NODE) -> DataFrame:
    """Edges (u > v) over distinct fingerprints (column fp) with the same components as all links within the budget."""
    rows, total = laid_out(distinct, distinct.count(), budget, max_node)
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_TASK))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            yield forest_of_partition(pd.concat(held, ignore_index=True), budget)

    return rows.repartition(parts, "layout", "top").mapInPandas(joined, "u long, v long").distinct()


# ----------------------------------------------------------------- components


def star_contraction(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge (u > v); root is the smallest node that can be reached."""
    edges, before = stage(edges), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = join_splitting_hot(both, least, ["u"], "degree", 2 * mark[0]).where("v > u")
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = join_splitting_hot(large, least, ["u"], "degree", large.count())
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        done = stage(small.where("u != v").distinct())
        drop_staged(edges)
        drop_staged(large)
        edges = done


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, digest: bool = False) -> DataFrame:
    """One row per row of docs: id, fp, root (a fingerprint) of its component and component_id, the smallest id of all
    rows that links reach; with digest also the text's."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle, digest))
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")))
    roots = stage(star_contraction(link_forest(distinct, budget)))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    of_print = stage(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root")))
    named = of_print.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("prints"))
    of_print = join_splitting_hot(of_print.select("fp", "n", "root"), named, ["root"], "prints", distinct.count())
    return join_splitting_hot(prints, stage(of_print.select("fp", "n", "root", "component_id")), ["fp"], "n", prints.count())


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of docs for each component, with all its columns: of the rows whose id names it, that of the least digest.

    Ids may be null or repeat in several components; a text is in one only, so id and digest tell which row is meant.
    """
    named = near_groups(docs, id_col, text_col, shingle, budget, digest=True).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = stage(named.groupBy("root").agg(F.min("id").alias("_kept_id"), F.min("digest").alias("_kept_digest"), F.count("*").alias("_kept_n")).drop("root"))
    total = kept.agg(F.coalesce(F.sum("_kept_n"), F.lit(0))).first()[0]
    with_digest = plain(docs).withColumn("_digest", text_digest(place(docs, text_col)))
    met = match_rows(with_digest, kept, [(place(docs, id_col), "_kept_id"), ("_digest", "_kept_digest")], "_kept_n", total)
    return restored(met.where("_nth = 1"), docs)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
