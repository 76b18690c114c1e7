"""Streams over the events table: watermarked windows, and a keyed upsert that a replay doesn't change.

The reference batch result is the oracle of each: an available-now run over the files gives the
same rows. Checkpoints go to the shared folder that the session names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.operators import decisions
from pairstone.shared import new_path


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def hourly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums by hour and type. In append mode an hour is final once the watermark has passed it, and rows that come later are dropped; in complete mode every row counts."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all files there are; its rows go to a table in the shared folder, whole batches at a time, which is read back."""
    path = new_path(spark, "stream-table")

    def write(batch: DataFrame, number: int) -> None:
        # In complete mode a batch is the whole result; otherwise a batch that runs again replaces itself.
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = result.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", new_path(spark, "stream")).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def upsert_into(path: str, keys: list[str], hash_column: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is merged into a table of generations, of which the last is the truth.

    A batch that runs again writes the same generation again, so a replay changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), "last_seen").alias("r")).select(*keys, "r.*")
        if number == 0:
            merged = fresh
        else:
            merged = decisions.upsert(spark.read.parquet(f"{path}/{number - 1}"), fresh, keys, hash_column).drop("action").select(*fresh.columns)
        merged.write.mode("overwrite").parquet(f"{path}/{number}")

    return merge
