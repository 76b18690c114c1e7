"""Readers over derived captions, stamps and identifiers, and over the raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.functions import alleles, readers
from pairstone.plans.registry import query
from pairstone.sources import pages
from pairstone.sources.people import _pick, table

#: Texts of which captions are made.
OPENINGS = ("donor", "recipient", "اهدا كليه", "بیمار", "", "نیازمند donor", "donor recipient", "hello")
TAILS = (" O+", " blood group A", " AB- B+", " گروه خونی B", "", " O+ O-", " wanted A+", " 12")
CAPTIONS = f"""
captions AS (
    SELECT o_orderkey AS id, ({list(OPENINGS)})[o_orderkey % 8 + 1] || ({list(TAILS)})[o_custkey % 8 + 1] AS caption FROM orders
),
normal AS (SELECT *, regexp_replace(translate(caption, 'يكى', 'یکی'), '[‌ـً-ْ]', '', 'g') AS t FROM captions)"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(_pick(F.col("o_orderkey") % 8, list(OPENINGS)), _pick(F.col("o_custkey") % 8, list(TAILS))).alias("caption"))


ROLE_SQL = f"""
roles AS (
    SELECT id, CASE WHEN trim(t) = '' THEN 'NONE' WHEN d AND r THEN 'REFUSED' WHEN NOT d AND NOT r THEN 'NONE' WHEN q THEN 'REFUSED' ELSE 'STATEMENT' END AS tier, d
    FROM (SELECT id, t, regexp_matches(lower(t), '{readers.DONOR_WORDS}') AS d, regexp_matches(lower(t), '{readers.RECIPIENT_WORDS}') AS r, regexp_matches(lower(t), '{readers.REQUEST_WORDS}') AS q FROM normal)
)"""


@query(f"WITH {CAPTIONS}, {ROLE_SQL} SELECT id, tier, CASE WHEN tier = 'STATEMENT' THEN CASE WHEN d THEN 'DONOR' ELSE 'RECIPIENT' END END AS role FROM roles")
def caption_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions(spark, sf_dir).select("id", readers.caption_role(F.col("caption")).alias("c")).select("id", "c.tier", "c.role")


GROUP_SQL = rf"""
found AS (
    SELECT id, t, regexp_extract_all(t, '(?:^|[^A-Za-z])((?:AB|A|B|O)[+-])', 1) AS signed,
           regexp_extract_all(t, '(?:{readers.BLOOD_WORDS})[^+-]{{0,{readers.REACH - 2}}}?(?:[^A-Za-z])(AB|A|B|O)(?:[^A-Za-z+-]|$)', 1) AS bare FROM normal
),
counted AS (
    SELECT id, t, list_sort(list_distinct(list_concat(list_transform(signed, lambda x: regexp_replace(x, '[+-]', '', 'g')), bare))) AS groups,
           list_distinct(list_transform(signed, lambda x: right(x, 1))) AS signs FROM found
),
tiers AS (
    SELECT *, CASE WHEN len(groups) = 0 THEN 'NONE' WHEN len(groups) > 1 OR len(signs) > 1 THEN 'REFUSED'
                   WHEN regexp_matches(t, '{readers.REQUEST_WORDS}') THEN 'REFUSED' ELSE 'STATEMENT' END AS tier FROM counted
)"""


@query(f"WITH {CAPTIONS}, {GROUP_SQL} SELECT id, tier, CASE WHEN tier = 'STATEMENT' THEN groups[1] END AS blood_group, CASE WHEN tier = 'STATEMENT' THEN signs[1] END AS rh FROM tiers")
def caption_abo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions(spark, sf_dir).select("id", readers.caption_group(F.col("caption")).alias("c")).select("id", "c.tier", "c.blood_group", "c.rh")


@query(
    f"""WITH {CAPTIONS}, {ROLE_SQL}, {GROUP_SQL},
j AS (SELECT o.o_custkey AS person, CASE WHEN r.tier = 'STATEMENT' THEN CASE WHEN r.d THEN 'DONOR' ELSE 'RECIPIENT' END END AS role,
      CASE WHEN g.tier = 'STATEMENT' THEN g.groups[1] END AS blood_group FROM orders o JOIN roles r ON r.id = o.o_orderkey JOIN tiers g ON g.id = o.o_orderkey)
SELECT person, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS role, CASE WHEN count(DISTINCT blood_group) = 1 THEN min(blood_group) END AS blood_group FROM j GROUP BY person"""
)
def unanimous_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all captions of a person agree on, or nothing."""
    rows = captions(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person")), "id")
    read = rows.select("person", readers.caption_role(F.col("caption"))["role"].alias("role"), readers.caption_group(F.col("caption"))["blood_group"].alias("blood_group"))
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return read.groupBy("person").agg(only("role"), only("blood_group"))


IDS = "ids AS (SELECT c_custkey AS id, lpad(((c_custkey * 7919 + 1000003) * 31 % 10000000000)::VARCHAR, 10, '0') AS digits FROM customer)"


@query(
    f"""WITH {IDS}, w AS (SELECT id, digits, list_sum(list_transform(range(1, 10), lambda i: substr(digits, i::INT, 1)::INT * (11 - i))) % 11 AS rest, right(digits, 1)::INT AS c FROM ids)
SELECT id, digits, len(list_distinct(string_split(digits, ''))) >= 3 AND CASE WHEN rest < 2 THEN c = rest ELSE c = 11 - rest END AS valid FROM w"""
)
def pii_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(((F.col("c_custkey") * 7919 + 1000003) * 31 % 10000000000).cast("string"), 10, "0")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), digits.alias("digits"), readers.valid_id(digits).alias("valid"))


@query("SELECT c_custkey AS id, regexp_replace(regexp_replace(c_name, '[A-Za-z]', 'L', 'g'), '[0-9]', 'd', 'g') AS mask, left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS redacted, substr(sha256('pepper' || lower(regexp_replace(trim(c_name), '\\s+', ' ', 'g'))), 1, 32) AS name_hash FROM customer")
def masks_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), readers.shape_mask(name).alias("mask"), readers.redacted(name).alias("redacted"), readers.salted_hash(name, "pepper").alias("name_hash"))


@query(
    """WITH s AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') || CASE o_orderkey % 3 WHEN 0 THEN ' UTC+03:30' WHEN 1 THEN ' UTC-05:00' ELSE '' END AS raw, o_orderdate FROM orders)
SELECT id, o_orderdate AS "at", CASE id % 3 WHEN 0 THEN 210 WHEN 1 THEN -300 END AS offset_minutes FROM s"""
)
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"), F.when(k % 3 == 0, " UTC+03:30").when(k % 3 == 1, " UTC-05:00").otherwise(""))
    return table(spark, sf_dir, "orders").select(k.alias("id"), readers.stamp(raw).alias("s")).select("id", "s.at", "s.offset_minutes")


@query(
    """WITH t AS (SELECT p_partkey AS id, 'A*' || lpad((p_partkey % 5 + 1)::VARCHAR, 2, '0') || ' b*07, DRB1*' || lpad((p_size % 9)::VARCHAR, 2, '0') || ' x DQB1*05 ' || CASE WHEN p_partkey % 2 = 0 THEN 'A*01' ELSE '' END AS text FROM part),
f AS (SELECT id, list_sort(list_distinct(regexp_extract_all(upper(text), '((?:A|B|C|DRB1|DQB1)\\*[0-9]{2})', 1))) AS found FROM t)
SELECT id, CASE WHEN len(found) >= 4 THEN array_to_string(found, '|') END AS fingerprint FROM f"""
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.lit("A*"), two(k % 5 + 1), F.lit(" b*07, DRB1*"), two(F.col("p_size") % 9), F.lit(" x DQB1*05 "), F.when(k % 2 == 0, "A*01").otherwise(""))
    return table(spark, sf_dir, "part").select(k.alias("id"), readers.fingerprint(text).alias("fingerprint"))


@query(
    """WITH t AS (SELECT p_partkey AS id, (['A*24', '*24:02', ' drb1*15:01 ', 'A*2', 'B*07:02N', 'A24', 'C*01:02:03', 'Q 1'])[p_partkey % 8 + 1] AS raw FROM part),
n AS (SELECT id, CASE WHEN upper(trim(raw)) LIKE '*%' THEN 'A' || regexp_replace(upper(trim(raw)), '\\s+', '', 'g') ELSE regexp_replace(upper(trim(raw)), '\\s+', '', 'g') END AS named FROM t)
SELECT id, CASE WHEN regexp_matches(named, '^[A-Z]+[0-9]*\\*[0-9]{2,3}(:[0-9]{2,3}){0,3}[NQLSCA]?$') THEN named END AS allele FROM n"""
)
def reported_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(F.col("p_partkey") % 8, ["A*24", "*24:02", " drb1*15:01 ", "A*2", "B*07:02N", "A24", "C*01:02:03", "Q 1"])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), alleles.normalise_reported(raw, F.lit("A")).alias("allele"))


@query("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="((?:https?://|tel:|/)[^"]*)"', 1)))::VARCHAR AS links FROM pages""".replace("list_sort(", "array_to_string(list_sort(").replace("::VARCHAR AS links", ", ' ') AS links"))
def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(readers.links(F.col("html")), " ").alias("links"))


@query()
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages parsed to title, visible text and links. No SQL: a parser reads the markup; tests hold it against small pages."""
    return pages.scan(table(spark, sf_dir, "pages"))


@query("WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT), 1) AS number FROM pages) SELECT page_id, host, number, row_number() OVER (PARTITION BY host ORDER BY number, page_id) AS place FROM u")
def natural_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host in the order of their numbers, the first of which isn't printed."""
    from pyspark.sql import Window as W

    number = F.coalesce(F.expr("try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT)"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), number.alias("number"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("host").orderBy("number", "page_id")))


@query("SELECT id, CASE WHEN w <= 0 OR h <= 0 THEN 'UNKNOWN' WHEN greatest(w, h) <= 560 THEN 'LOW' WHEN greatest(w, h) <= 900 THEN 'MID' ELSE 'HIGH' END AS band, contains(lower(name), '_thumb') AS thumbnail FROM (SELECT p_partkey AS id, (p_partkey * 37 % 1300)::INT AS w, (p_size * 41 % 1300)::INT AS h, CASE WHEN p_partkey % 3 = 0 THEN 'x_THUMB.jpg' ELSE 'x.jpg' END AS name FROM part)")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_partkey") * 37 % 1300).cast("int"), (F.col("p_size") * 41 % 1300).cast("int")
    name = F.when(F.col("p_partkey") % 3 == 0, "x_THUMB.jpg").otherwise("x.jpg")
    edge = F.greatest(w, h)
    band = F.when((w <= 0) | (h <= 0), "UNKNOWN").when(edge <= 560, "LOW").when(edge <= 900, "MID").otherwise("HIGH")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), band.alias("band"), F.contains(F.lower(name), F.lit("_thumb")).alias("thumbnail"))
