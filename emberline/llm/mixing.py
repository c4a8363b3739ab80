"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the copy rate of its documents: so many whole copies for each, and one fractional
copy probability, the same for all of the source. Documents are dealt by hash into blocks of about BLOCK. In a block,
pairs of fractional documents trade expected words, at random and without bias, until one of the two is integral; the
fractional one meets the next document. Every block leaves at most one fractional document, which goes on to the next
level of the tree, where FAN_IN blocks meet. Words are kept exactly at each trade, so a source misses its target only
by what its very last document is rounded by, at most half its words. That miss is then handed on, up to EXCHANGES
times, to the one document of the source whose size comes nearest to it and which can give or take a copy, so that
sources of a few documents come near their targets too. So of each source all documents but the last and EXCHANGES
others are included as pivotal rounding leaves them, with just the probability that their source's rate gives.

What is random comes from hashes of id, text and the number of a copy among equal rows; neither the layout of the table
nor the number of tasks matters. Equal rows are counted and dealt out anew, so they spread over blocks like others.

Defined results: a null text has size 0, is its source's like any other and takes nothing; null is a source of its
own, ordered last; where all sizes are 0 all targets are 0; rows that repeat are documents of their own; equal rows
may swap what they take; an empty table gives no rows; other columns are ignored, whatever they are called, or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.shared import join_splitting_hot, match_rows, place, plain, restored, stage, table
from emberline.operators.logs import with_sequence

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating; what they share, as a part of all sizes; the most copies of a source.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK, FAN_IN, EXCHANGES = 128, 64, 4
#: Equal rows that are dealt out by one task.
EQUAL = 1 << 16
SEED = 20240229
#: A mass this near to none or all of a document is integral.
NEAR = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n, source_size and target for each source of sized (source, size).

    A source's target is its weight times a level that all sources share, or its stop if that is less. The level that
    shares out everything is found from below: at each level some sources stop, and what the stops leave gives the next
    level to the others, until no more of them stop.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ordered = with_sequence(by_source.withColumn("last", F.col("source").isNull()), ["last", "source"], out="rank")
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    s = stage(ordered.select("source", "n", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("stop")))
    shared = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        stops = F.col("stop") <= F.col("weight") * F.lit(level)
        n, left, open_ = s.agg(F.count_if(stops), F.lit(shared) - F.coalesce(F.sum(F.when(stops, F.col("stop"))), F.lit(0.0)), F.sum(F.when(~stops, F.col("weight")))).first()
        if n == stopped or not open_:
            break
        level, stopped = left / open_, n
    return s.select("source", "n", "source_size", F.least("stop", F.col("weight") * F.lit(level)).alias("target"))


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def pivot_block(items: Column, place: list[Column], last: bool) -> Column:
    """Array of the items (struct with cap and mass) of one block, with copies 0 or 1, or null for the one still fractional.

    place: what, with an item's position, seeds its random number. last: the one still fractional is rounded.
    """
    def settled(x: Column, mass: Column, copies: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["row"].alias("row"), x["cap"].alias("cap"), mass.alias("mass"), copies.cast("int").alias("copies"))

    def meet(acc: Column, x: Column) -> Column:
        cur = F.element_at(acc, -1)
        chance = F.pmod(F.xxhash64(F.lit(SEED), *place, F.size(acc)), F.lit(1 << 52)) / F.lit(float(1 << 52))

        def trade(b: Column) -> Column:
            up, down = F.least(b["cap1"] - b["mass1"], b["mass2"]), F.least(b["mass1"], b["cap2"] - b["mass2"])
            return F.struct(*[b[c].alias(c) for c in ("mass1", "cap1", "mass2", "cap2")], F.when(chance * (up + down) < down, up).otherwise(-down).alias("move"))

        def parted(t: Column) -> Column:
            a, b = t["mass1"] + t["move"], t["mass2"] - t["move"]
            a_done = (a <= t["cap1"] * NEAR) | (a >= t["cap1"] * (1 - NEAR))
            b_done = (b <= t["cap2"] * NEAR) | (b >= t["cap2"] * (1 - NEAR))
            own = settled(cur, a, F.when(a_done, F.round(a / t["cap1"])))
            new = settled(x, b, F.when(b_done, F.round(b / t["cap2"])))
            rest = F.slice(acc, 1, F.size(acc) - 1)
            # the fractional one, if any, stands last
            return F.when(b_done & ~a_done, F.concat(rest, F.array(new, own))).otherwise(F.concat(rest, F.array(own, new)))

        start = F.struct(cur["mass"].alias("mass1"), cur["cap"].alias("cap1"), x["mass"].alias("mass2"), x["cap"].alias("cap2"))
        joined = _let(start, lambda b: _let(trade(b), parted))
        return F.when((F.size(acc) == 0) | cur["copies"].isNotNull(), F.concat(acc, F.array(settled(x, x["mass"], F.lit(None))))).otherwise(joined)

    empty = F.slice(F.transform(items, lambda x: settled(x, x["mass"], F.lit(None))), 1, 0)
    done = F.aggregate(items, empty, meet)
    if not last:
        return done
    return F.transform(done, lambda x: settled(x, x["mass"], F.coalesce(x["copies"], F.round(x["mass"] / x["cap"]).cast("int"))))


def hand_on_misses(taken: DataFrame, misses: DataFrame, total: int) -> DataFrame:
    """nth and way (1 or -1) of the documents of taken (nth, source, size, h, extra and others) that take a copy more or
    less, so that the misses (source, rows, miss: words short) get small."""
    turned = None
    for _ in range(EXCHANGES):
        met = join_splitting_hot(taken.where("size > 0").select("nth", "source", "size", "h", "extra"), misses, ["source"], "rows", total)
        able = ((F.col("miss") > 0) & (F.col("extra") == 0)) | ((F.col("miss") < 0) & (F.col("extra") == 1))
        off = F.abs(F.col("size") - F.abs("miss"))
        met = met.where(able & (off < F.abs("miss")))
        met = met if turned is None else met.join(turned.select("nth"), "nth", "left_anti")
        best = met.groupBy("source").agg(F.min(F.struct(off.alias("off"), "h", "nth", "size", F.signum("miss").alias("way"))).alias("best"))
        best = stage(best.select("source", "best.nth", "best.size", F.col("best.way").cast("int").alias("way")))
        if best.isEmpty():
            break
        turned = best if turned is None else turned.unionByName(best)
        met = misses.join(best.select(F.col("source").alias("_source"), "size", "way"), F.col("source").eqNullSafe(F.col("_source")), "left")
        misses = stage(met.select("source", "rows", (F.col("miss") - F.coalesce(F.col("size") * F.col("way"), F.lit(0.0))).alias("miss")))
    return turned.select("nth", "way") if turned is not None else taken.select("nth", F.lit(0).alias("way")).limit(0)


def counted_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, h and nth of each row of docs; h tells rows apart that have all else in common, nth all rows."""
    own = plain(docs)
    row_id, text, source = (place(docs, c) for c in (id_col, text_col, source_col))
    h = F.xxhash64(F.col(row_id), F.col(text), F.lit(SEED))
    each = own.select(F.col(row_id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), h.alias("of"))
    each = each.groupBy("id", "source", "size", "of").agg(F.count("*").alias("times"))
    few = each.where(F.col("times") <= EQUAL).withColumn("first", F.lit(0).cast("long"))
    # very many equal rows are dealt out by many tasks
    many = each.where(F.col("times") > EQUAL).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(EQUAL))))
    both = few.unionByName(many.repartition("of", "first"))
    rows = both.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + EQUAL, "times") - 1)))
    return stage(rows.select("id", "source", "size", F.xxhash64("of", "copy").alias("h")).withColumn("nth", F.monotonically_increasing_id()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target and copies (0, 1 or 2)."""
    sized = counted_documents(docs, id_col, text_col, source_col)
    sources = stage(source_targets(sized))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.when(rate >= MOST, F.lit(int(MOST))).otherwise(F.floor(rate + NEAR).cast("int"))
    dealt = sources.withColumn("base", base).withColumn("part", F.greatest(rate - F.col("base"), F.lit(0.0)))
    dealt = dealt.select("source", F.col("n").alias("rows"), "base", "part", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    most, total = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = join_splitting_hot(sized, dealt, ["source"], "rows", total)
    whole = (F.col("part") <= NEAR) | (F.col("size") == 0)
    row = F.struct("id", "size", "nth", "base")
    fixed = rows.where(whole).select("id", "size", "nth", "base", "source", "h", F.lit(0).alias("extra"))
    item = F.struct("h", row.alias("row"), F.col("size").cast("double").alias("cap"), (F.col("size") * F.col("part")).alias("mass"))
    open_ = rows.where(~whole).select("source", F.pmod("h", F.col("blocks")).alias("block"), item.alias("item"))
    blocks, level, parts = -(-most // BLOCK), 0, []
    while True:
        last = blocks <= 1
        grouped = open_.groupBy("source", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
        settled = stage(grouped.select("source", "block", F.inline(pivot_block(F.col("items"), [F.col("source"), F.col("block"), F.lit(level)], last))))
        parts.append(settled.where("copies is not null").select("row.*", "source", "h", F.col("copies").alias("extra")))
        if last:
            break
        open_ = settled.where("copies is null").select("source", F.expr(f"block div {FAN_IN}").alias("block"), F.struct("h", "row", "cap", "mass").alias("item"))
        blocks, level = -(-blocks // FAN_IN), level + 1
    misses = settled.groupBy("source").agg(F.sum(F.col("mass") - F.col("copies") * F.col("cap")).alias("miss"))
    misses = misses.select(F.col("source").alias("_source"), "miss").where(F.abs("miss") >= 1)
    misses = stage(misses.join(dealt.select("source", "rows"), F.col("_source").eqNullSafe(F.col("source"))).select("source", "rows", "miss"))
    taken = parts[0]
    for more in parts[1:]:
        taken = taken.unionByName(more)
    turned = hand_on_misses(taken, misses, total).select(F.col("nth").alias("_nth"), "way")
    taken = taken.join(turned, F.col("nth") == F.col("_nth"), "left").withColumn("extra", F.col("extra") + F.coalesce("way", F.lit(0))).select(*fixed.columns).unionByName(fixed)
    named = sources.select("source", F.col("n").alias("rows"), "source_size", "target")
    out = join_splitting_hot(taken, named, ["source"], "rows", total)
    return out.select("id", "source", "size", "source_size", "target", (F.col("base") + F.col("extra")).alias("copies"))


def repeat_to_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    key = ["_m_id", "_m_source", "_m_size"]
    mixed = mix(docs, id_col, text_col, source_col).select(F.col("id").alias("_m_id"), F.col("source").alias("_m_source"), F.col("size").alias("_m_size"), "copies")
    mixed = stage(mixed.groupBy(*key).agg(F.sum("copies").alias("_m_copies"), F.count("*").alias("_m_rows")).where("_m_copies > 0"))
    total = mixed.agg(F.coalesce(F.sum("_m_rows"), F.lit(0))).first()[0]
    keyed = plain(docs).withColumn("_d_size", word_count(place(docs, text_col)))
    nth = match_rows(keyed, mixed, [(place(docs, id_col), "_m_id"), (place(docs, source_col), "_m_source"), ("_d_size", "_m_size")], "_m_rows", total)
    times = F.expr("cast(_m_copies div _m_rows as int) + if(_nth <= _m_copies % _m_rows, 1, 0)")
    return restored(nth.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))), docs)


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
