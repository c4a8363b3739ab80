"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades run from 0 (clean) to GRADES - 1. The model has one weight for each feature, shared by all thresholds, and
rising thresholds t[1] < t[2] < ...: P(grade >= k) = sigmoid(x.w - t[k]). The expected severity is the sum of these.

The labels at hand tell toxic from clean only, so the one threshold that is measured is that between grade 0 and the
others. Grades 1 and 2 of the toxic training rows come from how many of their words lean strongly to the toxic rows: at
or above the median of the toxic rows is the top grade, under it the one below. What the model says between these two
grades is therefore its own notion of severity, not a measured one. Where a table has grades, give them as the label
column with graded=True: they are then taken as they are.

The classifier is fitted on at most MAX_TRAIN labelled rows, those whose ids have the smallest hashes; its features
are at most MAX_FEATURES words and beginnings of words that tell the two classes apart. It is applied to every row and whole text.

Defined results: a null or empty text has no features and gets the severity of the thresholds alone, below the
cut; rows repeat as they are; rows that share an id share its label, and labels that disagree for an id count as the
highest; of ids whose hashes tie the smaller one is taken first; a probability of just the cut isn't toxic; without
labels of both classes every severity is 0 and nothing is toxic; an empty table gives no rows; other columns are kept,
whatever they are called, but for one with the result's name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.shared import place, plain, restored, stage, table

GRADES = 3
MAX_TRAIN = 8_000
MAX_FEATURES = 2_000
#: A word is a feature if it is in so many training rows and its log-odds ratio is so many standard errors from 0.
MIN_ROWS, MIN_Z = 4, 4.0
#: Toxic if P(grade >= 1) is above this.
CUT = 0.5

#: Lengths of word beginnings that are features beside whole words; inflected and compound words share them.
BEGINNINGS = (4, 5, 6, 7)
#: Words whose features a worker remembers.
MEMORY = 200_000

WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[str, ...]:
    return (word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k))


def text_features(text: str | None) -> Counter:
    """Counts of the words of a text and of their beginnings."""
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for f in word_features(word):
            counts[f] += n
    return counts


class KnownFeatures(dict):
    """Features of a word that have a weight, worked out when first asked for."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = tuple(f for f in word_features(word) if f in self.weights)
        return out


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def at_least(self, text: str | None, known: KnownFeatures | None = None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        if not self.thresholds:
            return [0.0] * (GRADES - 1)
        known = KnownFeatures(self.weights) if known is None else known
        counts = Counter(f for w in WORD.findall((text or "").lower()) for f in known[w])
        z = sum(self.weights[f] * math.log1p(n) for f, n in sorted(counts.items()))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, z - t)))) for t in self.thresholds]


def fit_cumulative_link(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, l2: float = 0.2, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that make the penalised log-likelihood of the grades largest (Adam on the full batch)."""
    k = int(grades.max())
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    val = np.fromiter((v for r in rows for v in r.values()), np.float64, len(at))
    above = grades[:, None] >= np.arange(1, k + 1)[None, :]
    w = np.zeros(n_features)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    # thresholds are first[0] and gaps above it, kept positive as exponentials
    theta = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 0.1))))
    m, v = np.zeros(n_features + k), np.zeros(n_features + k)
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate(([theta[0]], np.exp(theta[1:]))))
        z = np.bincount(at, weights=val * w[col], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -60, 60)))
        full = np.hstack([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))])
        here = np.maximum(full[np.arange(len(rows)), grades] - full[np.arange(len(rows)), grades + 1], 1e-12)
        slope = np.hstack([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))])
        up, down = slope[np.arange(len(rows)), grades] / here, slope[np.arange(len(rows)), grades + 1] / here
        gz = up - down
        gt = np.zeros((len(rows), k + 2))
        gt[np.arange(len(rows)), grades] -= up
        gt[np.arange(len(rows)), grades + 1] += down
        gt = gt[:, 1 : k + 1].sum(axis=0)
        gw = np.bincount(col, weights=val * gz[at], minlength=n_features) - l2 * w
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, theta = w + move[:n_features], theta + move[n_features:]
    return w, np.cumsum(np.concatenate(([theta[0]], np.exp(theta[1:]))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, graded: bool = False) -> OrdinalModel:
    """Model from the labelled rows of docs with the smallest id hashes, at most max_train of them.

    The label tells toxic (not 0) from clean (0), or with graded is a grade from 0 to GRADES - 1.
    """
    own = plain(labels).select(F.col(place(labels, id_col)).alias("id"), F.col(place(labels, label_col)).alias("label"))
    own = own.where(F.col("label").isNotNull() & F.col("id").isNotNull())
    n = own.count()
    if not n:
        return OrdinalModel()
    spot = F.pmod(F.xxhash64(F.col("id"), F.lit("train")), F.lit(1 << 30))
    near = own.where(spot < int(min(1.0, 1.5 * max_train / n) * (1 << 30)))
    grade = F.col("label").cast("int") if graded else (F.col("label") != 0).cast("int")
    few = near.groupBy(F.col("id").alias("_id")).agg(F.max(grade).alias("_grade"))
    few = few.orderBy(F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1 << 30)), "_id").limit(max_train)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                ["grade", "words", "counts"],
            )

    text_of = plain(docs).join(F.broadcast(few), F.col(place(docs, id_col)) == F.col("_id")).select(F.col("_grade").alias("grade"), F.col(place(docs, text_col)).alias("text"))
    rows = stage(text_of.mapInArrow(words, "grade int, words array<string>, counts array<int>").withColumns({"row": F.monotonically_increasing_id(), "toxic": (F.col("grade") > 0).cast("int")}))
    by_class = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = by_class.get(1, 0), by_class.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel()
    odds = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lean = F.log((F.col("a") + 0.5) * (n0 - F.col("b") + 0.5) / ((F.col("b") + 0.5) * (n1 - F.col("a") + 0.5)))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (n1 - F.col("a") + 0.5) + 1 / (n0 - F.col("b") + 0.5))
    odds = odds.where(F.col("a") + F.col("b") >= MIN_ROWS).withColumn("z", lean / error).where(F.abs("z") >= MIN_Z)
    chosen = odds.orderBy(F.abs("z").desc(), "word").limit(MAX_FEATURES).select("word", "z").collect()
    if not chosen:
        return OrdinalModel()
    vocabulary = {r["word"]: i for i, r in enumerate(chosen)}
    strong = {i for i, r in enumerate(chosen) if r["z"] > 0}

    # at most max_train rows of at most MAX_FEATURES features; all else stays where it is
    places = F.broadcast(docs.sparkSession.createDataFrame(list(vocabulary.items()), "word string, place int"))
    each = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("f")).select("row", F.col("f.words").alias("word"), F.col("f.counts").alias("n"))
    pairs = each.join(places, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("features"))
    features = {r["row"]: r["features"] for r in pairs.collect()}
    trained = sorted((r["row"], r["grade"]) for r in rows.select("row", "grade").collect())
    x = [{f["place"]: math.log1p(f["n"]) for f in features.get(row, ())} for row, _ in trained]
    leaning = np.array([sum(f["n"] for f in features.get(row, ()) if f["place"] in strong) for row, _ in trained])
    grades = np.array([grade for _, grade in trained])
    if not graded:
        grades = np.where(grades == 0, 0, np.where(leaning >= np.median(leaning[grades == 1]), GRADES - 1, GRADES - 2))
    w, t = fit_cumulative_link(x, grades, len(vocabulary))
    return OrdinalModel({word: float(w[i]) for word, i in vocabulary.items()}, [float(v) for v in t])


def with_severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", out_col: str = "severity") -> DataFrame:
    """docs with a struct column: at_least (P(grade >= k) for k from 1), expected (severity), grade, toxic."""

    @F.pandas_udf("array<double>")
    def graded(text: pd.Series) -> pd.Series:
        known = KnownFeatures(model.weights)
        return text.map(lambda t: model.at_least(t, known))

    rows, text = plain(docs), F.col(place(docs, text_col))
    p = F.col("_at_least")
    parts = F.struct(
        p.alias("at_least"),
        F.aggregate(p, F.lit(0.0), lambda a, v: a + v).alias("expected"),
        F.size(F.filter(p, lambda v: v > CUT)).alias("grade"),
        (p[0] > CUT).alias("toxic"),
    )
    return restored(rows.withColumn("_at_least", graded(F.coalesce(text, F.lit("")))), docs, **{out_col: parts})


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't call toxic."""
    own = plain(docs)
    return restored(with_severity(own, model, place(docs, text_col), "_severity").where(~F.col("_severity.toxic")), docs)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = with_severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    s = F.col("severity")
    return graded.select("doc_id", s["expected"].alias("severity"), s["grade"].alias("grade"), s["at_least"][0].alias("p_toxic"), s["toxic"].alias("toxic"))
