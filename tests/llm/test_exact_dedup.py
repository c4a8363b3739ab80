import hashlib
import random
import re
from collections import defaultdict

import pytest
from helpers import AWKWARD, documents, write_tables

from emberline.llm.exact_dedup import fold_counts, group_copies, keep_first_copies, op7_exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1, 3, 256])
def test_matches_brute_force_with_hot_groups(spark, tmp_path, capacity):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in AWKWARD] + [(100 + k, "hot  text") for k in range(120)] + [(300 + k, f"t {rng.randrange(40)}") for k in range(150)]
    rng.shuffle(rows)
    got = group_copies(documents(spark, rows).repartition(5), capacity=capacity)
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got.collect()], key=str) == brute(rows)
    kept = keep_first_copies(documents(spark, rows), capacity=capacity)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([r[0] for r in brute(rows) if r[3]], key=str)


def test_query_and_empty_table(spark, tmp_path):
    sf = write_tables(spark, tmp_path, documents=documents(spark, [(r[0], r[1]) for r in AWKWARD]))
    assert op7_exact_dedup(spark, sf).count() == len(AWKWARD)
    assert group_copies(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "a"), (2, "a")]).withColumnRenamed("lang", "digest").withColumnRenamed("source", "row")
    assert keep_first_copies(clash).columns == clash.columns


def test_summaries_keep_what_is_frequent():
    counters = {}
    rng = random.Random(1)
    stream = ["x"] * 40 + [str(k) for k in range(60)]
    rng.shuffle(stream)
    for at in range(0, 100, 7):
        part = defaultdict(int)
        for s in stream[at : at + 7]:
            part[s] += 1
        counters = fold_counts(counters, part, 2)
        assert len(counters) <= 2
    assert "x" in counters
