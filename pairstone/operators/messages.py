"""Reconstruction of conversations: sender carry, joined runs, adjacency within a time window, replies.

Windows are partitioned by page, the unit in which an export is read; a page is bounded by the
exporter, so no window gathers more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

JOIN_SECONDS = 900


def carried(rows: DataFrame) -> DataFrame:
    """A message without a sender takes the last one on its page; a service row breaks the chain."""
    order = W.partitionBy("page").orderBy("message_id")
    chained = rows.withColumn("chain", F.count_if("is_service").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.last("sender", ignorenulls=True).over(W.partitionBy("page", "chain").orderBy("message_id").rowsBetween(W.unboundedPreceding, 0))
    return chained.where(~F.col("is_service")).select("*", F.coalesce("sender", last).alias("poster"), F.col("sender").isNull().alias("inherited")).drop("chain")


def bundled(rows: DataFrame) -> DataFrame:
    """Runs of joined messages: bundle_id (its first message), head_joined, and each member's relation."""
    order = W.partitionBy("page").orderBy("message_id")
    starts = ~F.col("is_joined") | (F.row_number().over(order) == 1)
    runs = rows.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("page", "run").orderBy("message_id")
    head = F.first(F.struct("message_id", "is_joined", "poster", "sent_at")).over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return runs.withColumn("head", head).select("page", F.col("head.message_id").alias("bundle_id"), "message_id", F.when(F.col("message_id") == F.col("head.message_id"), "PRIMARY").otherwise("JOINED").alias("relation"), F.col("head.is_joined").alias("head_joined"), F.col("head.poster").alias("bundle_poster"), F.col("head.sent_at").alias("started_at"))


def bundles(members: DataFrame) -> DataFrame:
    grouped = members.groupBy("page", "bundle_id").agg(F.count("*").alias("n_members"), F.max("head_joined").alias("head_joined"), F.max("bundle_poster").alias("poster"), F.max("started_at").alias("started_at"))
    return grouped.select("page", "bundle_id", "n_members", F.when(F.col("n_members") == 1, "SINGLE").otherwise("JOINED_RUN").alias("type"), F.when(F.col("head_joined"), "SUGGESTED").otherwise("STRUCTURAL").alias("confidence"), "poster", "started_at")


def adjacency(found: DataFrame) -> DataFrame:
    """Consecutive bundles of one poster at most JOIN_SECONDS apart."""
    order = W.partitionBy("page").orderBy("started_at", "bundle_id")
    before = F.lag(F.struct("bundle_id", "poster", "started_at")).over(order)
    gap = F.col("started_at") - F.col("before.started_at")
    return found.withColumn("before", before).where((F.col("before.poster") == F.col("poster")) & (gap >= 0) & (gap <= JOIN_SECONDS)).select("page", F.col("before.bundle_id").alias("earlier"), F.col("bundle_id").alias("later"), gap.alias("seconds_apart"))


def replies(rows: DataFrame) -> DataFrame:
    """Reply links; a target that the page doesn't have stays as a dangling link."""
    targets = rows.select("page", F.col("message_id").alias("reply_to"), F.lit(True).alias("resolved"))
    return rows.where("reply_to IS NOT NULL").select("page", "message_id", "reply_to").join(targets, ["page", "reply_to"], "left").select("page", "message_id", "reply_to", F.coalesce("resolved", F.lit(False)).alias("resolved"))
