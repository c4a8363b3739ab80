import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import AWKWARD, documents, write_tables

from emberline.llm import simhash as S


def brute_fingerprint(text):
    words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, budget=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    for text in [None, "", "One", "a B c", "A b c d", "x " * 50, "naïve ≠ 😀 text with more words than four", " \x0b tabs\tand\nlines here too"]:
        assert S.simhash(text) & (1 << 64) - 1 == brute_fingerprint(text)


def near_prints(seed, n=400):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, n)]
    for _ in range(5):
        flip = rng.random(n) < 0.7
        near = np.where(flip, near ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), near)
    return np.unique(np.concatenate([base, near]))


@pytest.mark.parametrize("max_node", [50_000, 40])
def test_trie_walk_matches_all_pairs(spark, max_node):
    fps = near_prints(max_node)
    distinct = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    rows = S.laid_out(distinct, len(fps), 4, max_node)[0].toPandas()
    assert rows.groupby(["layout", "top"]).size().max() <= max_node
    forest = S.forest_of_partition(rows, 4)
    at = {int(v): k for k, v in enumerate(fps.view(np.int64))}
    got = S.merge_roots(np.arange(len(fps)), np.array([at[u] for u in forest.u], int), np.array([at[v] for v in forest.v], int))
    assert got.tolist() == brute_components([int(f) for f in fps])


def test_rows_laid_out_grow_in_proportion(spark):
    """Where every layout is crowded, copies are bounded by the layouts, not by the number of fingerprints."""
    rng = np.random.default_rng(3)
    made = [(int(x),) for x in np.unique(rng.integers(-(2**63), 2**63 - 1, 8000))]
    few, many = (spark.createDataFrame(made[:n], "fp long") for n in (1000, 8000))
    assert S.laid_out(few, 1000, 4, 50)[0].count() == 5 * 1000 and S.laid_out(many, 8000, 4, 50)[0].count() == 5 * 8000
    assert [len(S.layouts(n, 4, 50_000)) for n in (10**7, 10**9, 10**11, 10**13)] == [5, 15, 35, 70]


def make_rows(seed):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(300)]
    rows = [(r[0], r[1]) for r in AWKWARD if r[0] is not None]
    for k in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for c in range(rng.choice([1, 1, 2, 8])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 + 20 * k + c, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("max_node", [50_000, 8])
def test_components_match_brute_force(spark, tmp_path, max_node, monkeypatch):
    rows = make_rows(max_node)
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    monkeypatch.setattr(S.link_forest, "__defaults__", (4, max_node))
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.op2_simhash_near_dedup(spark, sf).collect())
    assert got == sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root))
    kept = sorted(r.doc_id for r in S.keep_one_of_each_group(documents(spark, rows)).collect())
    assert kept == sorted(set(least.values()))


def test_chains_hot_hubs_nulls_and_empty(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(1000 + k, 999) for k in range(60)], "u long, v long")
    roots = {r.node: r.root for r in S.star_contraction(edges).collect()}
    assert all(roots[k] == 0 for k in range(1, 41)) and all(roots[1000 + k] == 999 for k in range(60))
    assert S.near_groups(documents(spark, [])).count() == 0
    got = {(r.id, r.component_id) for r in S.near_groups(documents(spark, [(None, "a b c d e"), (3, "a b c d e"), (None, "zz yy")])).collect()}
    assert got == {(None, 3), (3, 3), (None, None)}


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rng = random.Random(8)
    say = lambda: " ".join("w%d" % rng.randrange(9999) for _ in range(60))
    alone, pair, twin, shared = [say() for _ in range(12)], say(), say(), say()
    rows = [(None, t) for t in alone] + [(7, pair), (7, twin), (3, shared), (7, shared + " "), (None, shared + "\n"), (9, pair), (9, pair), (None, None), (None, "")]
    for k in range(3):
        docs = documents(spark, rng.sample(rows, len(rows))).repartition(k + 1)
        kept = [(r.doc_id, r.text or "") for r in S.keep_one_of_each_group(docs).collect()]
        assert sorted(kept, key=str) == sorted([*((None, t) for t in alone), (7, pair), (7, twin), (3, shared), (None, "")], key=str)
