"""Passes over the facts store, set comparisons, bounded lists, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.operators import linkage, passes
from pairstone.plans.fact_queries import WITH
from pairstone.plans.link_queries import CODES, FIELDS, codes, fields_of
from pairstone.plans.registry import query
from pairstone.sources.facts import facts
from pairstone.sources.messages import MESSAGES_SQL, messages
from pairstone.sources.people import _pick


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("band", _pick(F.col("profile") % 3, ["LOW", "MID", "HIGH"]))


@query(
    f"""{WITH}, v AS (SELECT *, (['LOW', 'MID', 'HIGH'])[profile % 3 + 1] AS band, (['CONFIRMED', 'CONTRADICTED', 'UNCONFIRMED'])[profile % 3 + 1] AS v1, (['CONFIRMED', 'UNCONFIRMED'])[profile // 3 % 2 + 1] AS verdict FROM facts),
p AS (SELECT *, status = 'REVIEW_REQUIRED' AND verdict = 'CONFIRMED' AND band <> 'LOW' AS hit FROM v)
SELECT profile, digest, field, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status, CASE WHEN hit THEN field || '*07' ELSE value END AS value, CASE WHEN hit THEN source || '|proposal' ELSE source END AS source FROM p"""
)
def proposal_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _banded(spark, sf_dir)
    verdicts = rows.select(*passes.KEY, _pick(F.floor(F.col("profile") / 3) % 2, ["CONFIRMED", "UNCONFIRMED"]).alias("verdict"), F.concat("field", F.lit("*07")).alias("reading"))
    return passes.promoted(rows, verdicts).select("profile", "digest", "field", "status", "value", "source")


@query(
    f"""{WITH}, c AS (SELECT DISTINCT profile, CASE WHEN profile % 4 <> 1 THEN (['O', 'A', 'B'])[profile % 3 + 1] END AS claim FROM facts)
SELECT profile, 'ABO' AS field, claim AS value, 'CAPTION_CLAIM' AS provenance FROM c WHERE claim IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.profile = c.profile AND f.field = 'ABO' AND f.status = 'RESOLVED')"""
)
def caption_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    claims = rows.select("profile").distinct().withColumn("claim", F.when(F.col("profile") % 4 != 1, _pick(F.col("profile") % 3, ["O", "A", "B"])))
    return passes.published(rows, claims, "ABO")


@query(
    f"""{WITH}, old AS (SELECT digest, field, value, CASE WHEN profile % 2 = 0 THEN 'UNANIMOUS' ELSE 'SPLIT' END AS stability FROM facts WHERE profile % 5 <> 0),
new AS (SELECT digest, field, CASE WHEN profile % 7 = 0 THEN 'x' ELSE value END AS value FROM facts)
SELECT n.digest, n.field, n.value, CASE WHEN n.value IS NOT DISTINCT FROM o.value AND o.stability IS NOT NULL THEN o.stability END AS stability,
       NOT (n.value IS NOT DISTINCT FROM o.value AND o.stability IS NOT NULL) AND o.value IS NOT NULL AS invalidated
FROM new n LEFT JOIN old o ON o.digest = n.digest AND o.field = n.field"""
)
def refresh_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    old = rows.where("profile % 5 <> 0").select("digest", "field", "value", F.when(F.col("profile") % 2 == 0, "UNANIMOUS").otherwise("SPLIT").alias("stability"))
    new = rows.select("digest", "field", F.when(F.col("profile") % 7 == 0, "x").otherwise(F.col("value")).alias("value"))
    return passes.refreshed(old, new)


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return passes.dangling(lines, orders, "l_orderkey")


@query(f"WITH x AS (SELECT 1) {CODES} {FIELDS} SELECT least(a, b) AS low, greatest(a, b) AS high, count(*) AS pairs FROM (SELECT (a + 7) // 8 AS a, (b + 7) // 8 AS b FROM judged WHERE verdict <> 'accepted') WHERE a <> b GROUP BY ALL")
def media_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes(spark, sf_dir)
    refused = linkage.veto(linkage.hamming_pairs(rows), fields_of(rows)).where("verdict <> 'accepted'")
    return passes.carried_conflicts(refused, rows.select("id", F.floor((F.col("id") + 7) / 8).alias("profile")))


@query(f"WITH {MESSAGES_SQL}, m AS (SELECT page, substr(body, 1, 1500) AS body, row_number() OVER (PARTITION BY page ORDER BY sent_at, message_id) AS place, count(*) OVER (PARTITION BY page) AS \"of\" FROM messages) SELECT * FROM m WHERE place <= 60")
def bounded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 messages of 1500 characters for a page."""
    return passes.bounded_list(messages(spark, sf_dir), "page", ["sent_at", "message_id"], 60, "body", 1500)


@query(
    f"""{WITH}, a AS (SELECT profile, list_distinct(list(value)) AS x FROM facts WHERE status = 'RESOLVED' AND field IN ('A', 'B') GROUP BY profile),
b AS (SELECT profile, list_distinct(list(value)) AS y FROM facts WHERE status = 'RESOLVED' AND field <> 'A' GROUP BY profile),
j AS (SELECT coalesce(a.profile, b.profile) AS profile, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b ON a.profile = b.profile)
SELECT profile, len(list_intersect(x, y)) AS shared, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS first_only, len(list_filter(y, lambda v: NOT list_contains(x, v))) AS second_only,
       len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS subset FROM j"""
)
def store_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).where("status = 'RESOLVED'")
    return passes.shared_keys(rows.where(F.col("field").isin("A", "B")), rows.where("field <> 'A'"))
