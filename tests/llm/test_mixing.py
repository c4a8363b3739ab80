import random
from collections import defaultdict

from helpers import AWKWARD, documents, write_tables

from emberline.llm import mixing as M


def brute_targets(sizes):
    """Reshare what is above the stops until nothing is."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    stops, left, open_, target = {s: 2 * sizes[s] for s in sources}, 1.5 * sum(sizes.values()), set(sources), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= stops[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(stops[s]) for s in over}
        left, open_ = left - sum(stops[s] for s in over), open_ - over
    return target


def rows_of(seed, n=900):
    rng = random.Random(seed)
    return [(k, " ".join(["w"] * rng.choice([0, 3, 40, 90, 400])), "en", rng.choice(["a", "a", "b", "é", "Z", "c", None, "hot", "hot", "hot"])) for k in range(n)]


def test_targets_sums_and_copies(spark, tmp_path):
    rows = rows_of(3)
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows))
    got = M.op4_pivotal_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    source, size = {r[0]: r[3] for r in rows}, {r[0]: len(r[1].split()) for r in rows}
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.002 * target[s] + 3
    again = {(r.doc_id, r.taken) for r in M.op4_pivotal_mixing(spark, sf).repartition(3).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_pivotal_rounding_is_unbiased_and_keeps_words(spark):
    """4,000 blocks of the same documents: each is included as often as its mass says, to 4 standard errors."""
    F, blocks = M.F, 4000
    docs = [(k, 10.0 + 7 * (k % 5) * k, 0.2 + 0.05 * (k % 9)) for k in range(13)]
    item = lambda k, cap, part: F.struct(F.lit(k).alias("h"), F.struct(F.lit(k).alias("id")).alias("row"), F.lit(cap).alias("cap"), F.lit(cap * part).alias("mass"))
    items = F.array(*[item(*d) for d in docs])
    out = spark.range(blocks).select("id", F.inline(M.pivot_block(items, [F.col("id")], False))).toPandas()
    out["row"] = [r["id"] for r in out["row"]]
    left = out[out.copies.isnull()]
    assert left.groupby("id").size().max() == 1 and (abs(out.groupby("id").mass.sum() - sum(c * p for _, c, p in docs)) < 1e-6).all()
    share = (out.mass / out.cap).groupby(out.row).mean()
    assert all(abs(share[k] - p) < 4 * (p * (1 - p) / blocks) ** 0.5 for k, _, p in docs)


def test_what_is_turned_is_little(spark, monkeypatch):
    docs, by = documents(spark, rows_of(5, 500)), {}
    for n in (0, 4):
        monkeypatch.setattr(M, "EXCHANGES", n)
        by[n] = {r.id: r for r in M.mix(docs).collect()}
    turned = defaultdict(int)
    for i, r in by[4].items():
        turned[r.source] += r.copies != by[0][i].copies
    assert max(turned.values()) <= 4


def test_equal_rows_spread_over_blocks_whatever_the_layout(spark, monkeypatch):
    rows = [(1, "w " * 10, "en", "hot")] * 700 + rows_of(6, 200)
    monkeypatch.setattr(M, "EQUAL", 64)
    key = lambda d: sorted(((r.id, r.size, r.copies) for r in M.mix(d).collect()), key=str)
    got = key(documents(spark, rows))
    assert len(got) == 900 and got == key(documents(spark, rows[::-1]).repartition(7))
    hot = M.counted_documents(documents(spark, rows), "doc_id", "text", "source").where("id = 1 and source = 'hot'")
    assert hot.select("h").distinct().count() >= 700 and hot.groupBy(M.F.pmod("h", M.F.lit(6))).count().where("count > 200").count() == 0


def test_stage_repeats_rows_and_awkward_tables(spark, tmp_path):
    rows = [(r[0], r[1], "en", "a" if k % 2 else None) for k, r in enumerate(AWKWARD)]
    docs = documents(spark, rows).withColumns({c: M.F.lit("clash") for c in ("size", "_copy", "_nth", "_key", "h", "c0", "dotted.name")})
    mixed = M.mix(docs).collect()
    assert len(mixed) == len(rows)
    out = M.repeat_to_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed)
    assert M.mix(documents(spark, [])).count() == 0
    assert {r.copies for r in M.mix(documents(spark, [(1, None), (2, " ")])).collect()} <= {0, 2}
