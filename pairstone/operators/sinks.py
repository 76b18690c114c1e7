"""Writing: partitions rebuilt in place, builds that are swapped in whole, batches with commit points, columns that come later.

A table is a folder of generations; the pointer table names the generation that counts, and is itself
written anew in one rename. A reader sees the old generation or the new one, never half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rebuild_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of path that df has rows for; all others stay."""
    df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _move(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(a, b):
        raise OSError(f"{old} can't be moved to {new}")


def build_and_swap(df: DataFrame, path: str, check: Callable[[DataFrame], bool]) -> bool:
    """Write df beside path, check what was written, and only then move it in; the old one is kept as path.before. False, and no change, where the check fails."""
    spark = df.sparkSession
    fresh = f"{path}.building"
    df.write.mode("overwrite").parquet(fresh)
    if not check(spark.read.schema(df.schema).parquet(fresh)):
        return False
    if _exists(spark, path):
        snapshot(spark, path, f"{path}.before")
    _move(spark, fresh, path)
    return True


def snapshot(spark: SparkSession, path: str, to: str) -> None:
    """Move a table aside, over an older snapshot."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(to)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _move(spark, path, to)


def append_batches(df: DataFrame, path: str, batch: str) -> int:
    """Append the batches of df (a column of numbers) that path doesn't hold yet, each as a partition that appears whole. Gives how many were new."""
    spark = df.sparkSession
    done = spark.read.parquet(path).select(batch).distinct() if _exists(spark, path) else None
    fresh = df.join(F.broadcast(done), batch, "left_anti") if done is not None else df  # one row for each batch
    n = fresh.select(batch).distinct().count()
    if n:
        rebuild_partitions(fresh, path, batch)
    return n


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of like, in its order and types: those that df lacks are null, those that like lacks come after."""
    have = {c: df[c].cast(like.schema[c].dataType).alias(c) if c in df.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns}
    return df.select(*have.values(), *[c for c in df.columns if c not in have])


def append_evolving(df: DataFrame, path: str) -> None:
    """Append rows that may have new columns or lack old ones."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = with_columns_of(df, spark.read.option("mergeSchema", True).parquet(path))
    df.write.mode("append").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines in one file: aggregates, never the table itself."""
    df.coalesce(1).write.mode("overwrite").json(path)


def insert_or_ignore(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and those of the batch whose keys are new; of a key that the batch has twice, any row."""
    return stored.unionByName(batch.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti"))


def insert_or_replace(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch, and the stored rows whose keys it lacks."""
    return insert_or_ignore(batch.dropDuplicates(keys), stored, keys)
