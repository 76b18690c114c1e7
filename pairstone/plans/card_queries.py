"""Decision cards over key-derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.functions import cards
from pairstone.plans.registry import query
from pairstone.sources.people import _pick, table

FAMILIES = ("01", "03", "04", "07", "11", "15", "08")
GENE_SQL = "CASE {0} WHEN '03' THEN 'DRB3' WHEN '11' THEN 'DRB3' WHEN '04' THEN 'DRB4' WHEN '07' THEN 'DRB4' WHEN '15' THEN 'DRB5' END"
DRB_INPUT = f"""
i AS (SELECT c_custkey AS id, ({list(FAMILIES)})[c_custkey % 7 + 1] AS f1, CASE WHEN c_custkey % 3 <> 0 THEN ({list(FAMILIES)})[c_custkey // 7 % 7 + 1] END AS f2, c_custkey // 5 % 9 AS p FROM customer),
k AS (SELECT id, list_filter([f1, f2], lambda x: x IS NOT NULL) AS families, list_filter([CASE WHEN p % 3 = 1 THEN 'DRB3' END, CASE WHEN p // 3 = 1 THEN 'DRB4' END, CASE WHEN p = 8 THEN 'DRB5' END], lambda x: x IS NOT NULL) AS present,
      list_filter([CASE WHEN p % 3 = 2 THEN 'DRB3' END, CASE WHEN p // 3 = 2 THEN 'DRB4' END], lambda x: x IS NOT NULL) AS absent FROM i),
e AS (SELECT *, list_filter(list_distinct(list_transform(families, lambda f: {GENE_SQL.format("f")})), lambda x: x IS NOT NULL) AS expected FROM k)"""


@query(
    f"""WITH {DRB_INPUT} SELECT id, CASE WHEN len(families) = 0 OR len(present) + len(absent) = 0 THEN 'NOT_CHECKABLE'
 WHEN len(families) = 1 AND len(present) >= 2 AND NOT list_has_any(present, expected) THEN 'FORBIDDEN_GENE_PRESENT'
 WHEN len(families) > 1 AND len(list_filter(present, lambda x: NOT list_contains(expected, x))) > 0 THEN 'FORBIDDEN_GENE_PRESENT'
 WHEN list_has_any(expected, absent) THEN 'EXPECTED_GENE_ABSENT' ELSE 'CONSISTENT' END AS verdict FROM e"""
)
def drb_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    p = F.floor(k / 5) % 9
    families = F.array_compact(F.array(_pick(k % 7, list(FAMILIES)), F.when(k % 3 != 0, _pick(F.floor(k / 7) % 7, list(FAMILIES)))))
    present = F.array_compact(F.array(F.when(p % 3 == 1, "DRB3"), F.when(F.floor(p / 3) == 1, "DRB4"), F.when(p == 8, "DRB5")))
    absent = F.array_compact(F.array(F.when(p % 3 == 2, "DRB3"), F.when(F.floor(p / 3) == 2, "DRB4")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), cards.drb_consistency(families, present, absent).alias("verdict"))


ABO_INPUT = """
i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN (['O', 'A', 'B', 'AB'])[o_orderkey % 3 + 1] END AS image, (['+', '-', NULL])[o_custkey % 3 + 1] AS image_sign,
      CASE o_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['A', 'O'] ELSE [(['O', 'A', 'B'])[o_custkey % 3 + 1]] END AS captions, (['+', '-', NULL])[o_orderkey // 2 % 3 + 1] AS sign,
      o_orderkey % 6 = 1 AS rescued, o_custkey % 4 AS boxes, o_orderkey % 9 = 0 AS disclaimed FROM orders),
s AS (SELECT *, CASE WHEN len(captions) = 1 THEN captions[1] END AS said FROM i),
c AS (SELECT *, said IS NOT NULL AND (coalesce(said <> image, false) OR (coalesce(said = image, false) AND coalesce(sign <> image_sign, false))) AS clash,
      image IS NOT NULL AND coalesce(said = image, false) AND NOT coalesce(sign <> image_sign, false) AS agreed FROM s),
d AS (SELECT *, CASE WHEN image IS NOT NULL AND clash THEN 'CONFLICT' WHEN image IS NOT NULL AND rescued AND boxes < 2 AND said IS NULL THEN 'REVIEW_REQUIRED'
      WHEN image IS NOT NULL THEN 'RESOLVED' WHEN said IS NOT NULL THEN 'CAPTION_CLAIM' ELSE 'UNKNOWN' END AS state FROM c)"""


@query(f"WITH {ABO_INPUT} SELECT state, CASE state WHEN 'RESOLVED' THEN image WHEN 'CAPTION_CLAIM' THEN said END AS value, agreed, agreed AND NOT disclaimed AS independent, count(*) AS n FROM d GROUP BY ALL")
def abo_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    none = F.array().cast("array<string>")
    captions = F.when(c % 5 == 0, none).when(c % 5 == 1, F.array(F.lit("A"), F.lit("O"))).otherwise(F.array(_pick(c % 3, ["O", "A", "B"])))
    found = cards.reconcile_group(F.when(k % 4 != 0, _pick(k % 3, ["O", "A", "B", "AB"])), _pick(c % 3, ["+", "-", None]), captions, _pick(F.floor(k / 2) % 3, ["+", "-", None]), k % 6 == 1, c % 4, k % 9 == 0)
    return table(spark, sf_dir, "orders").select(found.alias("f")).groupBy("f.state", "f.value", "f.agreed", "f.independent").agg(F.count("*").alias("n"))


ROLE_INPUT = """
i AS (SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS in_review, (['DONOR', 'RECIPIENT', NULL])[o_orderkey % 3 + 1] AS form, (['STRONG', 'BARE'])[o_custkey % 2 + 1] AS tier,
      o_custkey % 5 = 0 AS test, (['DONOR', 'RECIPIENT', NULL, NULL])[o_custkey % 4 + 1] AS caption, (['DONOR', NULL])[o_orderkey // 3 % 2 + 1] AS sender FROM orders)"""


@query(
    f"""WITH {ROLE_INPUT}, d AS (SELECT
 CASE WHEN in_review THEN 'review' WHEN form = 'DONOR' AND test THEN 'review' WHEN form IS NOT NULL AND caption IS NOT NULL AND caption <> form THEN 'review' WHEN form IS NOT NULL THEN 'finding'
      WHEN test OR caption IS NOT NULL OR sender IS NOT NULL THEN 'proposal' ELSE 'none' END AS state,
 CASE WHEN in_review THEN NULL WHEN form IS NOT NULL THEN form WHEN test THEN 'RECIPIENT' ELSE coalesce(caption, sender) END AS role,
 CASE WHEN in_review THEN 'FORM_REVIEW' WHEN form = 'DONOR' AND test THEN 'TEST' WHEN form IS NOT NULL AND caption IS NOT NULL AND caption <> form THEN 'CAPTION_VETO' WHEN form IS NOT NULL AND tier = 'STRONG' THEN 'FORM'
      WHEN form IS NOT NULL AND caption = form THEN 'FORM+CAPTION' WHEN form IS NOT NULL THEN 'BARE' WHEN test THEN 'TEST' WHEN caption IS NOT NULL THEN 'CAPTION' WHEN sender IS NOT NULL THEN 'SENDER' ELSE 'NONE' END AS rule FROM i)
SELECT state, role, rule, count(*) AS n FROM d GROUP BY ALL"""
)
def role_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    found = cards.role_decision(k % 13 == 0, _pick(k % 3, ["DONOR", "RECIPIENT", None]), _pick(c % 2, ["STRONG", "BARE"]), c % 5 == 0, _pick(c % 4, ["DONOR", "RECIPIENT", None, None]), _pick(F.floor(k / 3) % 2, ["DONOR", None]))
    return table(spark, sf_dir, "orders").select(found.alias("f")).groupBy("f.state", "f.role", "f.rule").agg(F.count("*").alias("n"))


READINGS = ("A*02,A*24", "24,02", "B*07", "", "xx", "02", "A*24:01 02:01")


@query(
    f"""WITH i AS (SELECT p_partkey AS id, (['A*02,A*24', 'A*02', 'A*24,A*02'])[p_partkey % 3 + 1] AS accepted, ({list(READINGS)})[p_size % 7 + 1] AS reading, p_partkey % 11 <> 0 AS covered FROM part),
t AS (SELECT *, list_filter(regexp_split_to_array(reading, '[,;/+\\s]+'), lambda t: t <> '') AS tokens FROM i),
u AS (SELECT *, list_filter(tokens, lambda t: regexp_matches(t, '^(?:[A-Z0-9]+\\*)?[0-9]{{2}}')) AS usable FROM t),
f AS (SELECT *, list_sort(list_transform(string_split(accepted, ','), lambda t: split_part(t, '*', 2))) AS own,
      list_sort(list_transform(usable, lambda t: split_part(CASE WHEN contains(t, '*') THEN split_part(t, '*', 2) ELSE t END, ':', 1))) AS seen FROM u)
SELECT id, CASE WHEN NOT covered THEN 'UNCONFIRMED' WHEN len(list_filter(tokens, lambda t: contains(t, '*') AND split_part(t, '*', 1) <> 'A')) > 0 THEN 'CONTRADICTED'
       WHEN len(usable) = 0 THEN 'UNCONFIRMED' WHEN own = seen THEN 'CONFIRMED' ELSE 'CONTRADICTED' END AS verdict FROM f"""
)
def confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    accepted = _pick(k % 3, ["A*02,A*24", "A*02", "A*24,A*02"])
    return table(spark, sf_dir, "part").select(k.alias("id"), cards.confirmation(accepted, _pick(F.col("p_size") % 7, list(READINGS)), F.lit("A"), k % 11 != 0).alias("verdict"))


@query(
    """WITH v AS (SELECT l_orderkey AS id, list(CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN '24' WHEN l_partkey % 7 = 0 THEN '2' ELSE lpad((l_suppkey % 2)::VARCHAR, 2, '0') END) AS votes FROM lineitem GROUP BY l_orderkey),
r AS (SELECT id, list_filter(votes, lambda x: x IS NOT NULL) AS read FROM v),
k AS (SELECT id, len(read) AS n, len(list_distinct(read)) AS kinds, len(list_distinct(list_transform(read, lambda x: length(x)))) AS digits FROM r)
SELECT id, CASE WHEN n = 0 THEN 'ILLEGIBLE' WHEN digits > 1 THEN 'DIGITS_LOST' WHEN kinds = 1 THEN 'UNANIMOUS' ELSE 'SPLIT' END AS stability FROM k"""
)
def jitter_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    vote = F.when(part % 6 == 0, None).when(F.col("l_orderkey") % 3 == 0, "24").when(part % 7 == 0, "2").otherwise(F.lpad((F.col("l_suppkey") % 2).cast("string"), 2, "0"))
    # collect_list drops unread shifts, which the card ignores; an order's lines are few.
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), vote.alias("vote")).groupBy("id").agg(F.collect_list("vote").alias("votes")).select("id", cards.stability(F.col("votes")).alias("stability"))


@query(
    """WITH i AS (SELECT o_orderkey AS id, o_orderkey % 14 AS h, o_custkey % 40 AS v, (o_orderkey % 5) / 2 AS mad, (o_custkey % 5) / 4 AS agreement, (o_orderkey % 11 - 5) / 4 AS rulings,
  CASE WHEN o_custkey % 9 <> 0 THEN (o_orderkey % 11 - 5) / 4 + (o_custkey % 5) END AS sweep, o_custkey % 8 AS ratio FROM orders)
SELECT id, CASE WHEN coalesce(h < 6 OR mad > 1.5 OR agreement < 0.7 OR (v >= 3 * h AND v >= 12) OR sweep IS NULL OR ratio < 3 OR abs(sweep - rulings) > 2, true) THEN 'UNCERTAIN' WHEN abs(rulings) < 0.5 THEN 'STRAIGHT' ELSE 'ROTATE' END AS tilt FROM i"""
)
def page_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    rulings = (k % 11 - 5).cast("double") / 4
    return table(spark, sf_dir, "orders").select(k.alias("id"), cards.page_tilt(k % 14, c % 40, (k % 5).cast("double") / 2, (c % 5).cast("double") / 4, rulings, F.when(c % 9 != 0, rulings + c % 5), c % 8).alias("tilt"))


@query(
    """WITH s AS (SELECT o_custkey AS id, max(list_position(['NEGATIVE', 'NOT_PERFORMED', 'EXPIRED', 'INDETERMINATE', 'POSITIVE'], (['NOT_PERFORMED', 'NEGATIVE', 'EXPIRED', 'NEGATIVE', 'INDETERMINATE', 'NEGATIVE', 'POSITIVE'])[o_orderkey % 7 + 1])) AS worst FROM orders GROUP BY o_custkey)
SELECT id, (['NEGATIVE', 'NOT_PERFORMED', 'EXPIRED', 'INDETERMINATE', 'POSITIVE'])[worst] AS state FROM s"""
)
def crossmatch_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _pick(F.col("o_orderkey") % 7, ["NOT_PERFORMED", "NEGATIVE", "EXPIRED", "NEGATIVE", "INDETERMINATE", "NEGATIVE", "POSITIVE"])
    # The set of states is at most five, however many rows a key has.
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(state).alias("s")).select("id", cards.crossmatch_worst(F.col("s")).alias("state"))


@query("SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT // 10 AS toman, CASE WHEN o_orderkey % 4 = 0 THEN 'LABORATORY_MEASURED' WHEN o_orderkey % 4 = 1 THEN 'CAPTION_CLAIM' WHEN o_orderkey % 4 = 2 THEN 'PATIENT_REPORTED_ON_FORM' ELSE 'UNKNOWN' END AS provenance FROM orders")
def value_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in toman and provenance classes; no ranking query reads a sum."""
    source = _pick(F.col("o_orderkey") % 4, ["LABORATORY_PRINTED", "CAPTION_CLAIM", "PATIENT_REPORTED_ON_FORM", "GUESS"])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), cards.toman(F.floor("o_totalprice")).alias("toman"), cards.provenance_class(source).alias("provenance"))
