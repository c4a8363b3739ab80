import random

import numpy as np
from helpers import AWKWARD, documents, write_tables

from emberline.llm import toxicity as X


def corpus(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"word{k}" for k in range(200)], ["vile", "awful", "nasty", "horrid"]
    rows, labels = [], []
    for k in range(n):
        text, toxic = [rng.choice(plain) for _ in range(60)], rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 6)):
                text[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_fit_orders_thresholds_and_shares_weights():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 600)
    grades = np.digitize(x + rng.normal(0, 0.7, 600), [1.2, 2.6])
    w, t = X.fit_cumulative_link([{0: float(v)} if v else {} for v in x], grades, 1, l2=0.01)
    assert w[0] > 1 and t[0] < t[1]
    assert abs(t[0] / w[0] - 1.2) < 0.4 and abs(t[1] / w[0] - 2.6) < 0.4


def test_held_out_accuracy_and_graded_severity(spark, tmp_path):
    rows, labels = corpus(600, 1)
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in X.op8_toxicity(spark, sf).collect()}
    assert len(got) == 600
    right = [got[i].toxic == bool(y) for i, _, y in labels[300:]]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 for r in got.values())
    kept = X.drop_toxic(documents(spark, rows), X.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert kept.columns == documents(spark, []).columns and 0 < kept.count() < 600


def test_awkward_rows_and_missing_labels(spark, tmp_path):
    rows = [(r[0], r[1]) for r in AWKWARD]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows), labels=none)
    got = X.op8_toxicity(spark, sf).collect()
    assert len(got) == len(rows) and not any(r.toxic for r in got) and all(r.severity == 0 for r in got)
    one_class = spark.createDataFrame([(1, 1, 1), (None, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert X.fit(documents(spark, rows), one_class).thresholds == []
    model = X.OrdinalModel({"vile": 9.0}, [1.0, 4.0])
    assert X.drop_toxic(documents(spark, [*rows, (50, "so VILE")]), model).count() == len(rows)
    assert X.with_severity(documents(spark, []), model).count() == 0


def test_severity_matches_brute_force(spark):
    """The model's probabilities worked out anew from its weights, with no Counter, cache or Arrow."""
    rows, labels = corpus(200, 3)
    docs = documents(spark, [*rows, *[(1000 + k, r[1]) for k, r in enumerate(AWKWARD)]]).withColumns({c: X.F.lit(0) for c in ("_at_least", "severity", "c1", "a.b", "_severity")})
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in X.with_severity(docs, model).collect():
        words, z = "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split(), 0.0
        for feature, weight in model.weights.items():
            n = sum(w.startswith(feature[1:]) and len(w) > len(feature) - 1 if feature[0] == "^" else w == feature for w in words)
            z += weight * np.log1p(n)
        expected = [1 / (1 + np.exp(-(z - t))) for t in model.thresholds]
        assert np.allclose(r.severity.at_least, expected, atol=1e-9) and abs(r.severity.expected - sum(expected)) < 1e-9
        assert r.severity.grade == sum(p > X.CUT for p in expected) and r.severity.toxic == (expected[0] > X.CUT)
    assert X.drop_toxic(docs, model).columns == docs.columns


def test_no_near_weights_fit_better():
    r = np.random.default_rng(2)
    x = [{int(c): float(v) for c, v in zip(r.permutation(6)[:3], r.random(3) + 0.5)} for _ in range(300)]
    grades = np.digitize([sum(v * (c - 2) for c, v in d.items()) + r.normal() for d in x], [0.5, 2.5])

    def likelihood(w, t, l2=0.2):
        total = -l2 / 2 * float(w @ w)
        for d, g in zip(x, grades):
            p = [1.0, *(1 / (1 + np.exp(-(sum(w[c] * v for c, v in d.items()) - k))) for k in t), 0.0]
            total += np.log(p[g] - p[g + 1])
        return total

    w, t = X.fit_cumulative_link(x, grades, 6)
    best = likelihood(w, t)
    assert all(likelihood(w + r.normal(0, 0.1, 6), t + r.normal(0, 0.1, 2)) < best for _ in range(40))


def test_given_grades_are_taken(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choices([f"word{j}" for j in range(50)], k=30) + ["mild"] * 3 * (k % 3 == 1) + ["harsh"] * 3 * (k % 3 == 2))) for k in range(1000)]
    grades = spark.createDataFrame([(k, k % 3) for k, _ in texts[:800]], "doc_id long, grade int")
    docs = documents(spark, texts)
    got = X.with_severity(docs, X.fit(docs, grades, label_col="grade", graded=True)).collect()
    assert sum(r.severity.grade == r.doc_id % 3 for r in got if r.doc_id >= 800) >= 190
