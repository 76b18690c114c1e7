"""Messages in the shape of a chat export, derived from conversations; a page holds PAGE conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.sources.people import table

#: Conversations of a page, so that pages grow in number, not in size.
PAGE = 20


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, message_id, sender (null where the export repeats none), is_service, is_joined, sent_at, reply_to, body."""
    conv, turn = F.col("conv_id"), F.col("turn")
    number = (conv * 100 + turn).cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.floor(conv / PAGE).cast("long").alias("page"),
        number.alias("message_id"),
        F.when(number % 3 == 0, F.concat(F.col("role"), (conv % 5).cast("string"))).alias("sender"),
        (number % 11 == 5).alias("is_service"),
        (number % 4 != 0).alias("is_joined"),
        (F.lit(1_700_000_000) + conv * 600 + turn * (conv % 7) * 60).cast("long").alias("sent_at"),
        F.when(number % 5 == 0, number - turn % 3 - 1).alias("reply_to"),
        F.col("text").alias("body"),
    )


MESSAGES_SQL = f"""
messages AS (
    SELECT conv_id // {PAGE} AS page, conv_id * 100 + turn AS message_id,
           CASE WHEN (conv_id * 100 + turn) % 3 = 0 THEN role || (conv_id % 5) END AS sender,
           (conv_id * 100 + turn) % 11 = 5 AS is_service, (conv_id * 100 + turn) % 4 <> 0 AS is_joined,
           1700000000 + conv_id * 600 + turn * (conv_id % 7) * 60 AS sent_at,
           CASE WHEN (conv_id * 100 + turn) % 5 = 0 THEN conv_id * 100 + turn - turn % 3 - 1 END AS reply_to,
           text AS body
    FROM conversations
)"""
