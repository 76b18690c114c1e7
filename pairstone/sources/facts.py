"""A facts store derived from order lines: one row for each document and field, with status and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.sources.people import _pick, table

#: The fields of a profile, and those of them that are genes.
FIELDS = ("A", "B", "DRB1", "DQB1", "ABO", "RH", "ROLE")
GENES = ("A", "B", "DRB1", "DQB1")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, digest, representative, field, status, value, second_allele, source, rule_id, reason."""
    k, part, supp, line = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select((k.cast("long") / 4).cast("long").alias("profile"), F.format_string("%012d-%d", k, line).alias("digest"), part.alias("p"), supp.alias("u"), line.alias("l"), q.alias("q"))
    field = _pick(F.col("p") % 7, list(FIELDS))
    status = _pick(F.col("q") % 5, ["RESOLVED", "RESOLVED", "RESOLVED", "REVIEW_REQUIRED", "UNKNOWN"])
    made = rows.select("profile", "digest", field.alias("field"), status.alias("status"), "u", "l", "q")
    # A document may print a field once: of repeated draws the smallest value stands.
    value = F.when(F.col("status") == "RESOLVED", F.concat(F.col("field"), F.lit("*"), F.lpad((F.col("u") % 3 + 1).cast("string"), 2, "0")))
    return (
        made.select("profile", "digest", "field", "status", value.alias("value"), _pick(F.col("u") % 3, ["READ", "UNREAD", None]).alias("second_allele"), _pick(F.col("l") % 4, ["grid|primary", "row|primary", "", "caption|chat"]).alias("source"), F.concat(F.col("field"), F.lit("/r"), (F.col("l") % 3).cast("string")).alias("rule_id"), _pick(F.col("q") % 4, ["too many boxes", "label owned by another", "empty cell", "foreign prefix"]).alias("reason"))
        .groupBy("profile", "digest", "field")
        .agg(F.min(F.struct("status", "value", "second_allele", "source", "rule_id", "reason")).alias("f"))
        .select("profile", "digest", "field", "f.*")
    )


FACTS_SQL = """
drawn AS (
    SELECT l_orderkey // 4 AS profile, lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber AS digest,
           (['A', 'B', 'DRB1', 'DQB1', 'ABO', 'RH', 'ROLE'])[l_partkey % 7 + 1] AS field,
           (['RESOLVED', 'RESOLVED', 'RESOLVED', 'REVIEW_REQUIRED', 'UNKNOWN'])[l_quantity::BIGINT % 5 + 1] AS status,
           l_suppkey AS u, l_linenumber AS l, l_quantity::BIGINT AS q
    FROM lineitem
),
fact_rows AS (
    SELECT profile, digest, field, status,
           CASE WHEN status = 'RESOLVED' THEN field || '*' || lpad((u % 3 + 1)::VARCHAR, 2, '0') END AS value,
           (['READ', 'UNREAD', NULL])[u % 3 + 1] AS second_allele,
           (['grid|primary', 'row|primary', '', 'caption|chat'])[l % 4 + 1] AS source,
           field || '/r' || (l % 3) AS rule_id,
           (['too many boxes', 'label owned by another', 'empty cell', 'foreign prefix'])[q % 4 + 1] AS reason
    FROM drawn
),
facts AS (
    SELECT profile, digest, field, status, value, second_allele, source, rule_id, reason FROM (
        SELECT *, row_number() OVER (PARTITION BY profile, digest, field
            ORDER BY status, value NULLS FIRST, second_allele NULLS FIRST, source, rule_id, reason) AS nth FROM fact_rows)
    WHERE nth = 1
)"""
