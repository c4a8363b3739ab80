import random

from helpers import AWKWARD, documents, write_tables

import corpus_pipeline


def test_stages_take_effect_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(160):
        text = [rng.choice(plain) for _ in range(80)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(5):
                text[rng.randrange(80)] = rng.choice(["vile", "awful"])
        rows.append((k, " ".join(text), "en", "s%d" % (k % 3)))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, rows[1][1] + " ", "en", "s1") for k in range(20)]
    rows += [(2000, rows[2][1].replace(rows[2][1].split()[0], "other", 1), "en", "s2"), (3000, None, None, None)]
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept.append((name, sorted(r.doc_id for r in docs.collect())))
    ids = dict(kept)
    assert not [i for i in ids["toxicity"] if i < 160 and i % 5 == 0] and len([i for i in ids["toxicity"] if i < 160]) == 128
    assert [i for i in ids["exact_dedup"] if i == 1 or 1000 <= i < 2000] == [1, *range(1000, 1001)]
    assert set(ids["mixing"]) <= set(ids["simhash_near_dedup"]) <= set(ids["exact_dedup"])
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids["mixing"])
    assert packed.count() == len(ids["mixing"])


def test_awkward_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for k, rows in enumerate(([], [(r[0], r[1]) for r in AWKWARD])):
        sf = write_tables(spark, tmp_path / str(k), documents=documents(spark, rows), labels=none)
        got = corpus_pipeline.run(spark, sf)
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and (got.count() > 0) == bool(rows)
