"""Tables in the folder that driver and executors share: intermediate results that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def _master(spark: SparkSession) -> str:
    return spark.sparkContext.master


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting only a session on one machine may go on, in a folder of its own."""
    named, master = _named(spark), _master(spark)
    if named:
        return named.rstrip("/")
    if master == "local" or master.startswith("local["):
        return "file:///tmp/pairstone-checkpoints"
    raise ValueError(f"spark.checkpoint.dir is not set: the executors of {master} need a shared folder for intermediate tables")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
