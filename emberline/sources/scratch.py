"""Scratch folders that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's applications, deleted when it ends.
_made: set[str] = set()


def scratch_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder of the warehouse, which on a cluster must not be one machine's. A file: folder that
    spark.checkpoint.dir names is taken as it is, as it may be mounted on all machines."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not spark.sparkContext.master.startswith("local") and base.partition(":")[0] in ("file", base):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return base


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete_folder(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone; the folder is named by its application
        pass


def scratch_folder(spark: SparkSession) -> str:
    """A new folder, under one of the application's own, which goes when this process ends."""
    own = f"{scratch_base(spark)}/emberline-{spark.sparkContext.applicationId}"
    if own not in _made:
        _made.add(own)
        atexit.register(_delete_at_exit, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back: what follows doesn't repeat its work and sees the same rows each time."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete what written() wrote and df reads, once nothing else reads it any more."""
    spark = df.sparkSession
    mark = f"/emberline-{spark.sparkContext.applicationId}/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if mark in f}:
        delete_folder(spark, folder)
