"""Helpers the training-data operators share: scratch tables that survive lost executors, joins that split hot keys,
and names that can't clash with those of a user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.sources.scratch import drop_written as drop_staged  # noqa: F401
from emberline.sources.scratch import written as stage  # noqa: F401

#: At most so many keys of a join are broadcast.
HOT_SHARE = 20_000


def hot_share(spark: SparkSession) -> int:
    """A key with at least 1/hot_share of the rows is hot: it has the rows of a whole task of the shuffle, or more. So
    at most hot_share keys are hot."""
    return min(HOT_SHARE, int(spark.conf.get("spark.sql.shuffle.partitions")))


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place: whatever a user's columns are called, twice or with dots, no
    helper column takes the place of one of them."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The name of a column of df in plain(df)."""
    return f"c{df.columns.index(column)}"


def restored(rows: DataFrame, df: DataFrame, **added: Column) -> DataFrame:
    """The columns of plain(df) in rows, under df's own names, and added ones, which take the place of any so called."""
    kept = [k for k, c in enumerate(df.columns) if c not in added]
    return rows.select(*[f"c{k}" for k in kept], *added.values()).toDF(*[df.columns[k] for k in kept], *added)


def join_splitting_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join in which right has one row a key and `count` says how many rows of left have that key.

    Hot keys, of which there are at most HOT_SHARE, are broadcast, and their rows never shuffle; the rest meets in a
    shuffle join. Null keys match null keys. total: rows of left.
    """
    is_hot = (F.col(count) * hot_share(left.sparkSession) >= F.lit(total)) & (F.col(count) > 1)
    hot, cold = right.where(is_hot).drop(count), right.where(~is_hot).drop(count)
    values = [c for c in hot.columns if c not in on]

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}{c}") for c in df.columns])

    def same(tag: str):
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"{tag}{c}"))
        return cond

    h, c = F.broadcast(renamed(hot, "_h_")), renamed(cold, "_c_")
    by_map = left.join(h, same("_h_"), "inner").select(*left.columns, *[F.col(f"_h_{v}").alias(v) for v in values])
    rest = left.join(F.broadcast(renamed(hot.select(*on), "_h_")), same("_h_"), "left_anti")
    by_shuffle = rest.join(c, same("_c_"), how).select(*left.columns, *[F.col(f"_c_{v}").alias(v) for v in values])
    return by_map.unionByName(by_shuffle)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def match_rows(rows: DataFrame, found: DataFrame, on: list[tuple[str, str]], count: str, total: int) -> DataFrame:
    """Inner join of wide rows with found, one row for each key of it, on pairs of columns of which null matches null.

    Adds `_nth`, which numbers the rows that share a key from 1. `count`, a column of found, says how many rows have the
    key at most; total is how many there are. Rows of ordinary keys are shuffled once, by a hash of the key, and numbered
    by a hash of all that a row has, so that a task which runs again numbers them alike. Rows of hot keys never meet: they
    find their key in a broadcast and are numbered where they are, as `numbered_in_place` says.
    """
    spark = rows.sparkSession
    is_hot = (F.col(count) * hot_share(spark) >= F.lit(total)) & (F.col(count) > 1)
    hot = stage(found.where(is_hot).withColumn("_which", F.monotonically_increasing_id()))
    keyed = rows.withColumn("_key", F.xxhash64(*[F.col(a) for a, _ in on]))
    wanted = found.where(~is_hot).withColumn("_found_key", F.xxhash64(*[F.col(b) for _, b in on]))
    same, same_hot = F.col("_key") == F.col("_found_key"), F.lit(True)
    for a, b in on:  # not written as <=>, which Spark would make a key of the shuffle
        same = same & F.coalesce(F.col(a) == F.col(b), F.col(a).isNull() & F.col(b).isNull())
        same_hot = same_hot & F.col(a).eqNullSafe(F.col(b))
    all_of_it = F.xxhash64(*[F.col(f.name) for f in rows.schema if _hashable(f.dataType)])
    repeats = Window.partitionBy("_key", *[a for a, _ in on]).orderBy(all_of_it)
    if hot.isEmpty():
        return keyed.join(wanted, same).withColumn("_nth", F.row_number().over(repeats)).drop("_key", "_found_key")
    rest = keyed.join(F.broadcast(hot.select(*[b for _, b in on])), same_hot, "left_anti")
    few = rest.join(wanted, same).withColumn("_nth", F.row_number().over(repeats)).drop("_key", "_found_key")
    many = numbered_in_place(rows.join(F.broadcast(hot), same_hot), "_which")
    return few.unionByName(many.drop("_which"))


def numbered_in_place(rows: DataFrame, key: str) -> DataFrame:
    """rows with `_nth`, numbers from 1 of the rows that share a key: they are written, numbered in each written part, and
    the numbers of a part begin after those of the parts before it. So no task sees more rows of a key than it wrote."""
    held = stage(rows.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = held.groupBy(F.col(key).alias("_of"), part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_of", "_part", (F.sum("_size").over(Window.partitionBy("_of").orderBy("_part")) - F.col("_size")).alias("_before"))
    met = held.join(before, (F.col(key) == F.col("_of")) & (part == F.col("_part")))
    nth = F.row_number().over(Window.partitionBy("_of", "_part").orderBy("_row"))
    return met.withColumn("_nth", nth + F.col("_before")).drop("_row", "_of", "_part", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
