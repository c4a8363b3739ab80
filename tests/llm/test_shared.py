import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberline.llm import shared


def table_of(spark, rng, n=600):
    """n rows, of which a half has one key and a sixth a null key."""
    keys = [rng.choice(["hot", "hot", "hot", None, *"abcdefgh"[:2]]) if k % 3 else f"k{k % 40}" for k in range(n)]
    return keys, spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long").repartition(5)


@pytest.mark.parametrize("most", [1, 4, 20_000])
def test_both_branches_of_a_join_that_splits_hot_keys(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "HOT_SHARE", most)
    keys, left = table_of(spark, random.Random(1))
    n = Counter(keys)
    right = spark.createDataFrame([(k, c, f"v{k}") for k, c in n.items() if k != "a"], "k string, n long, v string")
    got = shared.join_splitting_hot(left, right, ["k"], "n", len(keys))
    assert sorted((r.i, r.v) for r in got.collect()) == sorted((i, f"v{k}") for i, k in enumerate(keys) if k != "a")
    kept = shared.join_splitting_hot(left, right, ["k"], "n", len(keys), "left")
    assert sorted((r.i, str(r.v)) for r in kept.collect()) == sorted((i, "None" if k == "a" else f"v{k}") for i, k in enumerate(keys))


@pytest.mark.parametrize("most", [1, 4])
def test_matched_rows_are_numbered_once_each(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "HOT_SHARE", most)
    keys, rows = table_of(spark, random.Random(2))
    n = Counter(keys)
    found = spark.createDataFrame([(k, c, f"v{k}") for k, c in n.items()], "f string, n long, v string")
    got = shared.match_rows(rows, found, [("k", "f")], "n", len(keys)).collect()
    assert sorted(r.i for r in got) == list(range(len(keys))) and all(r.v == f"v{r.k}" for r in got)
    for k, c in n.items():
        assert sorted(r["_nth"] for r in got if r.k == k) == list(range(1, c + 1))
    hot = {k for k, c in n.items() if c * shared.hot_share(spark) >= len(keys)}
    assert ("hot" in hot) == (most == 4)


def test_rows_numbered_in_place_don_t_meet(spark):
    rows = spark.range(1000).select(F.lit(0).alias("k"), "id").repartition(6)
    got = shared.numbered_in_place(rows, "k").collect()
    assert sorted(r["_nth"] for r in got) == list(range(1, 1001))
