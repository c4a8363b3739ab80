"""License scans by ordered signature rules, in DataFrame functions only.

A text is brought to a line of lower-case words. A rule has a keyword, a regular expression over that line, a priority,
a label and a confidence. Only rules whose keyword is among the text's words are tried, and only texts with any
rule's keyword are brought to a line at all. Every match is a span of words. A span that lies within a span of higher
priority, or within a longer one of the same priority, is suppressed; what stays gives labels and score.

The base phrases are rules as well; their places are counted before suppression, and their labels always stay.

Defined results: a null text counts as empty; without words n_words and n_base are 0 and the labels are empty strings;
equal spans of one priority keep the rule that stands first; repeated rows stay; an empty table gives no rows; other
columns are kept, whatever they are called, but for one with the result's name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.license_rules import BASE_RULES, Rule, gate, signature_rules
from emberline.llm.shared import place, plain, restored, table

#: Runs of what isn't part of a word, and of what is.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: More words than any rule matches; places that are summed up in one go; stretches of REACH words that are told apart in one go.
REACH, RUN, WIDE = 128, 256, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_line(text: Column) -> Column:
    """' w0 w1 ... ': the words, ASCII lower case, one space before each and one behind the last."""
    return F.translate(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), BREAK, " "), UPPER, LOWER)


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def rule_spans(line: Column, rule: Column) -> Column:
    """Array of spans (start and end word, inclusive) of all matches of one rule in a word line.

    A match begins at the space before its first word and ends with its last word. What stands between matches comes
    from splitting by the rule; a match's first word is numbered by the spaces before it.
    """
    size = F.transform(F.regexp_extract_all(line, rule["pattern"], F.lit(0)), spaces)
    gap = F.transform(F.split(line, rule["pattern"]), spaces)
    step = F.zip_with(F.slice(gap, 1, F.size(size)), F.concat(F.array(F.lit(0)), size), lambda g, m: F.coalesce(g, F.lit(0)) + m)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))

    def placed(x: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            q = (k / F.lit(RUN)).cast("int")
            before = total(F.slice(x["runs"], 1, q)) + total(F.slice(x["step"], q * RUN + 1, k - q * RUN + 1))
            return F.struct(before.alias("start"), (before + m - 1).alias("end"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["score"].alias("score"))

        return F.transform(x["size"], one)

    def with_runs(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), (F.size(x["step"]) / F.lit(RUN)).cast("int")), lambda q: total(F.slice(x["step"], q * RUN + 1, RUN)))
        return F.struct(x["size"].alias("size"), x["step"].alias("step"), runs.alias("runs"))

    start = F.array(F.struct(size.alias("size"), step.alias("step")))
    return F.flatten(F.transform(F.transform(start, with_runs), placed))


def rules_literal(rules: list[Rule]) -> Column:
    rows = [r._asdict() | {"rank": k} for k, r in enumerate(rules)]
    shape = "array<struct<keyword:string,pattern:string,priority:int,rank:int,label:string,score:double>>"
    return F.from_json(F.lit(json.dumps(rows)), F.lit(shape))


def surviving(spans: Column) -> Column:
    """Spans that no other span suppresses.

    Containment and priority are transitive, so a span goes if any span beats it, itself suppressed or not. Rules match
    under REACH words, so what holds a span starts in the same stretch of REACH words or in the one before.
    """

    def beaten(d: Column, near: Column) -> Column:
        def by(e: Column) -> Column:
            holds = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
            longer = (e["start"] < d["start"]) | (e["end"] > d["end"])
            return holds & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (e["rank"] < d["rank"]))))

        return F.exists(near, by)

    stretch = lambda s: (s["start"] / F.lit(REACH)).cast("int")
    last = F.coalesce(F.array_max(F.transform(spans, stretch)), F.lit(0))
    wide = F.transform(F.sequence(F.lit(0), (last / F.lit(WIDE)).cast("int")), lambda w: F.struct(w.alias("w"), F.filter(spans, lambda s: (stretch(s) / F.lit(WIDE)).cast("int") == w).alias("own")))
    fine = lambda x: F.transform(F.sequence(x["w"] * WIDE, x["w"] * WIDE + WIDE - 1), lambda q: F.filter(x["own"], lambda s: stretch(s) == q))
    by_stretch = F.array(F.flatten(F.transform(wide, fine)))

    def kept(x: Column) -> Column:
        near = lambda k: F.concat(F.when(k > 0, F.get(x, k - 1)).otherwise(F.slice(F.get(x, k), 1, 0)), F.get(x, k))
        return F.flatten(F.transform(x, lambda own, k: F.flatten(F.transform(F.array(near(k)), lambda n: F.filter(own, lambda d: ~beaten(d, n))))))

    return F.flatten(F.transform(by_stretch, kept))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "licenses", rules: list[Rule] | None = None) -> DataFrame:
    """docs with a struct column: n_words, base (spans of the base phrases) and spans (of all rules, after suppression)."""
    every = [*BASE_RULES, *(signature_rules() if rules is None else rules)]
    text = F.coalesce(F.col(place(docs, text_col)), F.lit(""))
    keywords = sorted({r.keyword for r in every})
    gated = plain(docs).withColumn("_line", F.when(text.rlike(gate(every)), word_line(text)))
    own = F.array_intersect(F.split(F.col("_line"), " "), F.lit(keywords))
    tried = F.filter(rules_literal(every), lambda r: F.array_contains(F.col("_own"), r["keyword"]))
    found = F.flatten(F.transform(F.col("_rules"), lambda r: rule_spans(F.col("_line"), r)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,rank:int,label:string,score:double>>")
    spanned = gated.withColumn("_own", own).withColumn("_rules", F.when(F.size("_own") > 0, tried)).withColumn("_all", F.when(F.size("_rules") > 0, found))
    base = F.filter(F.col("_all"), lambda s: s["rank"] < len(BASE_RULES))
    n_words = F.when(F.col("_line").isNotNull(), F.greatest(spaces(F.col("_line")) - 1, F.lit(0))).otherwise(F.regexp_count(text, F.lit(WORD)))
    out = F.struct(n_words.cast("long").alias("n_words"), F.coalesce(base, none).alias("base"), F.coalesce(surviving(F.col("_all")), none).alias("spans"))
    return restored(spanned, docs, **{out_col: out})


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("licenses")
    starts, base = F.transform(s["base"], lambda b: b["start"]), F.transform(s["base"], lambda b: b["label"])
    labels = F.concat(base, F.transform(s["spans"], lambda d: d["label"]))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return scan(docs).select(
        "doc_id",
        s["n_words"].alias("n_words"),
        F.size(s["base"]).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(labels).alias("labels"),
        F.coalesce(F.array_max(F.transform(s["spans"], lambda d: d["score"])), F.lit(0.0)).alias("score"),
    )
