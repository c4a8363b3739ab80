import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import AWKWARD, documents, write_tables

from emberline.llm import treap_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    """(item, rank, id, score) by scoring all documents for each item."""
    tf = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(c.values()) for c in tf]
    n, total, df = sum(x > 0 for x in sizes), sum(sizes), Counter(w for c in tf for w in c)
    out = []
    for item, text in items:
        asked, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for (i, _), c, size in zip(docs, tf, sizes):
            m = 25 + 75 * size * n // max(total, 1)
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, r in asked.items() if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "And", "naïve", "x-1", "été", "ÉTÉ", "a_b", "日本"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, [60, 40] + [1] * (len(words) - 2), k=rng.choice([1, 5, 30, 200])))) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(40)]  # copies, all with one score
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for k in range(25)] + [(90, None), (91, "--"), (None, "W1 w1 w1"), (92, "unknown"), (92, "w2 w3")]
    return docs, items


def results(spark, docs, items, **options):
    found = S.search(documents(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted([(r.item, r.rank, r.id, r.score) for r in found.collect()], key=str)


@pytest.mark.parametrize("options", [{}, {"max_terms": 12, "block_postings": 300}])
def test_equals_scoring_of_all_documents(spark, options):
    docs, items = corpus(len(options))
    assert results(spark, docs, items, **options) == brute(docs, items)


def test_awkward_rows_and_empty_tables(spark):
    docs, items = [(r[0], r[1]) for r in AWKWARD], [(1, "one id"), (2, "the lazy"), (3, ""), (4, "NAÏVE naïve")]
    assert results(spark, docs, items) == brute(docs, items)
    assert results(spark, [], items) == [] and results(spark, docs, []) == []
    clash = documents(spark, docs).withColumnsRenamed({"lang": "terms", "source": "n", "n_chars": "query"})
    found = S.search(clash, spark.createDataFrame([(1, "one", 5)], "item_id long, text string, score int"))
    assert [(r.item, r.rank, r.id) for r in found.orderBy("rank").collect()] == [(1, 1, 4), (1, 2, 5), (1, 3, 5)]


def test_walk_scores_few_documents():
    """One document stands out by rare terms: most subtrees go unseen."""
    rng, n = random.Random(3), 20_000
    rows = [(0, d, rng.randrange(5, 90)) for d in range(n)] + [(t, d, 10**4) for t in (1, 2, 3) for d in range(700, 730)]
    index = S.TreapIndex(*(np.array(c) for c in zip(*rows)))
    query, doc, score, scored = index.search([(np.arange(4), np.ones(4, np.int64))], 10)
    by = Counter()
    for _, d, x in rows:
        by[d] += x
    assert [(d, s) for d, s in zip(doc.tolist(), score.tolist())] == sorted(by.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert scored < n / 100


def test_treaps_stay_balanced_where_all_impacts_are_equal():
    index = S.TreapIndex(np.zeros(1 << 15, np.int64), np.arange(1 << 15), np.full(1 << 15, 7))
    depth, level = 0, np.array([index.roots[0]])
    while len(level):
        depth, level = depth + 1, np.concatenate((index.left[level], index.right[level]))
        level = level[level != index.nil]
    assert depth < 60


def test_query_equals_its_sql(spark, tmp_path):
    docs, items = corpus(7, 120)
    items = [x for k, x in enumerate(items) if x[0] is not None and x[0] not in [y[0] for y in items[:k]]]
    sf = write_tables(spark, tmp_path, documents=documents(spark, docs), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    want = con.execute(S.OP11_SQL).fetchall()
    got = [tuple(r) for r in S.op11_treap_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) 
