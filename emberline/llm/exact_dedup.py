"""Exact dedup by heavy-hitter split.

Misra-Gries summaries of every partition are merged in a tree and name the digests that may be frequent. Their exact
counts and winners are then verified and broadcast, so that rows of frequent texts are decided where they are. The
remaining digests are counted by a grouping that combines before its shuffle, and their rows meet their group's winner
in a join that splits the larger ones.

Defined results: a null text counts as empty; a null id sorts after all others and is the winner only of a group
without other ids; rows that repeat id and text are rows like any others, and exactly one row of a group is kept;
an empty table gives no rows; other columns are ignored, whatever they are called, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.shared import drop_staged, join_splitting_hot, match_rows, place, plain, restored, stage, table

WHITE = r"[\x20\x09-\x0D]+"
#: Counters of a summary: a digest of over 1/(CAPACITY + 1) of all rows is found for sure.
CAPACITY = 256
#: Summaries merged in one task of the first level of the tree.
FAN_IN = 256


def text_digest(text: str) -> F.Column:
    """SHA-256 of the text with each run of ASCII white space made one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " "), 256))


def fold_counts(counters: dict[bytes, int], more: dict[bytes, int], capacity: int) -> dict[bytes, int]:
    """Merge two Misra-Gries summaries: add, then lower all counters until at most `capacity` are above zero."""
    for k, n in more.items():
        counters[k] = counters.get(k, 0) + n
    if len(counters) > capacity:
        cut = sorted(counters.values(), reverse=True)[capacity]
        counters = {k: n - cut for k, n in counters.items() if n > cut}
    return counters


def frequent_candidates(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most `capacity` digests (column digest) that include every one of over 1/(capacity + 1) of the rows."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[bytes, int] = {}
        for pdf in batches:
            counters = fold_counts(counters, pdf["digest"].value_counts().to_dict(), capacity)
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "digest": list(counters), "n": list(counters.values())})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counters: dict[bytes, int] = {}
        for _, own in pdf.groupby("part", sort=True):
            counters = fold_counts(counters, dict(zip(own["digest"], own["n"].astype(int))), capacity)
        return pd.DataFrame({"part": key[0] // FAN_IN, "digest": list(counters), "n": list(counters.values())})

    shape = "part long, digest binary, n long"
    leaves = digests.select("digest").mapInPandas(summarise, shape)
    inner = leaves.groupBy(F.expr(f"part div {FAN_IN}").alias("node")).applyInPandas(merge, shape)
    return inner.groupBy(F.lit(0).cast("long").alias("node")).applyInPandas(merge, shape).select("digest")


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept and digest (32 bytes)."""
    wanted = plain(docs).select(F.col(place(docs, id_col)).alias("id"), text_digest(place(docs, text_col)).alias("digest"))
    rows = stage(wanted.withColumn("row", F.monotonically_increasing_id()))
    candidates = stage(frequent_candidates(rows, capacity))
    total = rows.count()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")

    def groups(of: DataFrame) -> DataFrame:
        return of.groupBy("digest").agg(F.count("*").alias("n"), first).select("digest", "n", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))

    winners = stage(groups(rows.join(F.broadcast(candidates), "digest", "left_semi")).where(F.col("n") * (capacity + 1) > F.lit(total)))
    drop_staged(candidates)
    frequent = rows.join(F.broadcast(winners), "digest")
    # a row whose digest nothing else has needs no partner; the others meet the winner of their group
    rare = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    shared = groups(rare).where("n > 1").withColumn("size", F.col("n"))
    met = join_splitting_hot(rare, shared, ["digest"], "size", total, "left")
    met = met.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")))
    met = met.withColumns({"keep_row": F.coalesce("keep_row", "row"), "n": F.coalesce("n", F.lit(1))})
    out = ["id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "digest"]
    return frequent.select(*out).unionByName(met.select(*out))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs, with all their columns, that exact dedup keeps."""
    groups = stage(group_copies(docs, id_col, text_col, capacity).where("kept"))
    kept = groups.select(F.col("id").alias("_kept_id"), F.col("digest").alias("_kept_digest"), F.col("group_size").alias("_kept_n"))
    total = kept.agg(F.coalesce(F.sum("_kept_n"), F.lit(0))).first()[0]
    with_digest = plain(docs).withColumn("_digest", text_digest(place(docs, text_col)))
    met = match_rows(with_digest, kept, [(place(docs, id_col), "_kept_id"), ("_digest", "_kept_digest")], "_kept_n", total)
    return restored(met.where("_nth = 1"), docs)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = group_copies(table(spark, sf_dir, "documents"))
    return copies.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS nth
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
"""
