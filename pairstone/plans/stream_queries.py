"""Streaming queries, and the batch windows that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairstone.plans.registry import query
from pairstone.sources.people import table
from pairstone.streaming import events


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.run(spark, events.hourly(events.read_events(spark, sf_dir)), "complete")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 900 THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, starts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, count(DISTINCT run) AS runs FROM r GROUP BY user_id"""
)
def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with at most 900 whole-second steps between neighbours."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    gap = second - F.lag(second).over(order)
    rows = table(spark, sf_dir, "events").withColumn("starts", F.when(gap <= 900, 0).otherwise(1))
    return rows.groupBy("user_id").agg(F.sum("starts").cast("long").alias("runs"))
