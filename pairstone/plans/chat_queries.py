"""Chat-export queries: pages are written from the conversations and read back; the SQL never sees a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairstone.plans.registry import query
from pairstone.sources import chat_export
from pairstone.sources.messages import MESSAGES_SQL, messages

WITH = f"WITH {MESSAGES_SQL}"
_KIND = "CASE WHEN is_service THEN 'SERVICE' WHEN message_id % 13 = 7 OR message_id <= 0 THEN 'UNPARSED' ELSE 'MESSAGE' END"


def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_export.scan(chat_export.exported(messages(spark, sf_dir)))


@query(
    f"""{WITH} SELECT page AS page_id, row_number() OVER (PARTITION BY page ORDER BY message_id) - 1 AS place, {_KIND} AS row_kind,
       CASE WHEN {_KIND} <> 'UNPARSED' AND (message_id % 13 <> 7 AND NOT is_service) THEN message_id END AS message_id, CASE WHEN is_service THEN false ELSE is_joined END AS is_joined,
       CASE WHEN NOT is_service THEN sender END AS sender, CASE WHEN NOT is_service THEN strftime(make_timestamp(sent_at * 1000000), '%d.%m.%Y %H:%M:%S') END AS sent_raw,
       nullif(regexp_replace(coalesce(body, '') || CASE WHEN NOT is_service AND message_id % 6 = 0 THEN '@someonecall' ELSE '' END, '^\\s+|\\s+$', '', 'g'), '') AS text FROM messages"""
)
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message, service and unparsed rows, in their order, with sender, stamp and text."""
    return exported_rows(spark, sf_dir).select("page_id", "place", "row_kind", "message_id", "is_joined", "sender", "sent_raw", "text")


@query(
    f"""{WITH} SELECT message_id, reply_to, CASE WHEN reply_to IS NOT NULL AND message_id % 2 = 0 THEN 'messages2.html' END AS reply_file,
       CASE WHEN message_id % 7 = 2 THEN 'Origin ' || (message_id % 5) END AS forwarded_from, CASE WHEN message_id % 7 = 2 THEN TIMESTAMP '2020-02-01 03:04:05' END AS forwarded_at,
       CASE message_id % 4 WHEN 1 THEN 'PHOTO:photos/p' || message_id || '.jpg:photos/t' || message_id || '.jpg' WHEN 3 THEN 'VIDEO:Video file:Not included, change data exporting settings to download.' ELSE '' END AS media,
       CASE WHEN message_id % 6 = 0 THEN 'USERNAME=someone,PHONE=+98912' ELSE '' END AS contacts
FROM messages WHERE {_KIND} = 'MESSAGE'"""
)
def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, forwards, media and contact evidence of the messages."""
    rows = exported_rows(spark, sf_dir).where("row_kind = 'MESSAGE'")
    media = F.array_join(F.transform("media", lambda m: F.concat_ws(":", m["kind"], m["href"], m["thumbnail"], m["title"], m["absence"])), ";")
    contacts = F.array_join(F.transform("contacts", lambda c: F.concat_ws("=", c["kind"], c["value"])), ",")
    stamp = F.to_timestamp("forwarded_raw", "dd.MM.yyyy HH:mm:ss").cast("timestamp_ntz")
    return rows.select("message_id", "reply_to", "reply_file", "forwarded_from", stamp.alias("forwarded_at"), media.alias("media"), contacts.alias("contacts"))


@query(f"{WITH} SELECT page AS page_id, count(*) AS elements, count(*) FILTER ({_KIND} = 'MESSAGE') AS messages, count(*) FILTER ({_KIND} = 'SERVICE') AS services, count(*) FILTER ({_KIND} = 'UNPARSED') AS unparsed, count(DISTINCT sender) FILTER ({_KIND} = 'MESSAGE') AS senders FROM messages GROUP BY page")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a page's import, by kind of row."""
    of = lambda kind: F.count_if(F.col("row_kind") == kind)
    sender = F.when(F.col("row_kind") == "MESSAGE", F.col("sender"))
    return exported_rows(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("elements"), of("MESSAGE").alias("messages"), of("SERVICE").alias("services"), of("UNPARSED").alias("unparsed"), F.count_distinct(sender).alias("senders"))


@query(f"{WITH}, p AS (SELECT DISTINCT sender FROM messages WHERE sender IS NOT NULL) SELECT sender, left(sha256('pairstone|' || sender), 8) AS poster_hash FROM p")
def poster_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders as eight characters of a salted digest."""
    return messages(spark, sf_dir).where("sender IS NOT NULL").select("sender").distinct().select("sender", F.left(F.sha2(F.concat(F.lit("pairstone|"), "sender"), 256), F.lit(8)).alias("poster_hash"))


@query(
    f"""{WITH}, s AS (SELECT page, message_id, CASE WHEN message_id % 9 <> 4 THEN make_timestamp(sent_at * 1000000) END AS stamp FROM messages)
SELECT page, message_id, row_number() OVER (PARTITION BY page ORDER BY stamp NULLS LAST, message_id) AS place FROM s"""
)
def chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a page by their printed day-first stamps; those without one come last."""
    raw = F.when(F.col("message_id") % 9 != 4, F.date_format(F.timestamp_seconds("sent_at"), "dd.MM.yyyy HH:mm:ss"))
    rows = messages(spark, sf_dir).select("page", "message_id", F.to_timestamp(raw, "dd.MM.yyyy HH:mm:ss").alias("at"))
    return rows.select("page", "message_id", F.row_number().over(W.partitionBy("page").orderBy(F.asc_nulls_last("at"), "message_id")).alias("place"))


@query(f"{WITH}, h AS (SELECT page, sha256(string_agg(message_id || ':' || sha256(coalesce(body, '')), '|' ORDER BY message_id)) AS digest FROM messages GROUP BY page) SELECT count(*) AS pages, sha256(string_agg(page || '=' || digest, '|' ORDER BY page)) AS export_digest FROM h")
def export_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of an export: a digest over its pages' digests in their order. One short row for each page meets at the end."""
    one = F.concat(F.col("message_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("body", F.lit("")), 256))
    in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"]), "|")
    pages = messages(spark, sf_dir).groupBy("page").agg(F.sha2(in_order("message_id", one), 256).alias("digest"))
    return pages.agg(F.count("*").alias("pages"), F.sha2(in_order("page", F.concat(F.col("page").cast("string"), F.lit("="), "digest")), 256).alias("export_digest"))
