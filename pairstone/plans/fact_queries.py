"""Consolidation, checks, scoring of readings, engine agreement, queue tiers and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairstone.operators import consolidate, decisions, gold, scoring
from pairstone.plans.registry import query
from pairstone.sources.facts import FACTS_SQL, facts

WITH = f"WITH {FACTS_SQL}"
ROUTED = """,
reps AS (SELECT profile, max(digest) AS representative FROM facts GROUP BY profile),
grouped AS (
    SELECT f.profile, f.field, list_sort(list_distinct(list(value) FILTER (status = 'RESOLVED'))) AS vals,
           coalesce(max(digest) FILTER (status = 'RESOLVED' AND digest = representative), min(digest) FILTER (status = 'RESOLVED')) AS digest,
           count(*) AS members_answering, count(*) FILTER (status <> 'RESOLVED') AS members_unresolved,
           count(*) FILTER (status = 'REVIEW_REQUIRED') AS in_review, arg_min(status, digest) AS state
    FROM facts f JOIN reps USING (profile) GROUP BY f.profile, f.field
),
routed AS (
    SELECT g.profile, g.field, coalesce(len(vals), 0) AS n,
           CASE WHEN coalesce(len(vals), 0) > 1 THEN 'conflict' WHEN len(vals) = 1 THEN 'fact' WHEN in_review > 0 THEN 'review' ELSE 'unknown' END AS route,
           CASE WHEN len(vals) = 1 THEN g.digest END AS digest, CASE WHEN len(vals) = 1 THEN vals[1] END AS value,
           members_answering, members_unresolved, CASE WHEN coalesce(len(vals), 0) = 0 THEN state END AS state
    FROM grouped g
)"""


@query(f"{WITH} SELECT * FROM facts")
def fact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)


@query(
    f"""{WITH} {ROUTED}
SELECT r.profile, r.field, r.route, r.digest, r.value, r.members_answering, r.members_unresolved, r.state,
       CASE WHEN r.route = 'fact' THEN f.field || ':' || CASE WHEN split_part(f.source, '|', 1) <> '' THEN split_part(f.source, '|', 1) ELSE split_part(f.rule_id, '/', 1) END END AS evidence_group
FROM routed r LEFT JOIN facts f ON f.profile = r.profile AND f.field = r.field AND f.digest = r.digest"""
)
def gold_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.routed(facts(spark, sf_dir)).drop("values")


@query(
    f"""{WITH}, v AS (SELECT profile, field, value, min(digest) AS digest FROM facts WHERE status = 'RESOLVED' GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY profile, field ORDER BY value, digest) AS nth FROM v)
SELECT a.profile, a.field, a.value AS value_a, a.digest AS digest_a, b.value AS value_b, b.digest AS digest_b
FROM c a JOIN c b ON a.profile = b.profile AND a.field = b.field AND a.nth = 1 AND b.nth > 1"""
)
def gold_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.conflicts(facts(spark, sf_dir))


_GOLD = f"""{WITH} {ROUTED},
fact_of AS (SELECT r.profile, r.field, r.digest, r.value, f.field || ':' || CASE WHEN split_part(f.source, '|', 1) <> '' THEN split_part(f.source, '|', 1) ELSE split_part(f.rule_id, '/', 1) END AS evidence
    FROM routed r JOIN facts f ON f.profile = r.profile AND f.field = r.field AND f.digest = r.digest WHERE r.route = 'fact'),
tiered AS (SELECT profile, field, digest, value, CASE WHEN evidence LIKE '%:grid' THEN 'A' WHEN evidence LIKE '%:row' THEN 'B' ELSE 'C' END AS tier FROM fact_of),
docs AS (SELECT DISTINCT f.profile, f.digest, f.digest = r.representative AS representative FROM facts f JOIN reps r USING (profile)),
wide AS (SELECT profile, max(value) FILTER (field = 'A') AS a, max(value) FILTER (field = 'B') AS b, max(value) FILTER (field = 'DRB1') AS d FROM routed WHERE route = 'fact' GROUP BY profile),
keyed AS (SELECT profile, min(profile) OVER (PARTITION BY a, b, d) AS low FROM wide WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL),
candidates AS (SELECT low, CASE WHEN profile % 3 = 0 THEN -1 ELSE profile END AS high FROM keyed WHERE profile > low),
documents_ AS (SELECT profile, digest, CASE WHEN profile % 53 = 2 THEN false ELSE representative END AS representative FROM docs WHERE profile % 47 <> 9 UNION ALL SELECT profile + 1, digest, profile % 82 = 3 FROM docs WHERE profile % 41 = 3),
gold AS (SELECT profile, field, digest, CASE WHEN profile % 31 = 2 THEN value || 'x' ELSE value END AS value, CASE WHEN profile % 37 = 5 THEN 'Z' ELSE tier END AS tier FROM tiered),
profiles AS (SELECT r.profile, CASE WHEN r.profile % 59 = 1 THEN 'none' ELSE r.representative END AS representative, (SELECT count(*) FROM docs d WHERE d.profile = r.profile) + (r.profile % 29 = 4)::INT AS n_documents,
    (SELECT count(*) FROM tiered t WHERE t.profile = r.profile) AS n_facts, CASE WHEN r.profile % 43 = 6 THEN 'CLAIMED' ELSE 'HISTORICAL_UNCLAIMED' END AS status FROM reps r),
review AS (SELECT profile, field FROM routed WHERE route = 'review' UNION ALL SELECT profile, field FROM tiered WHERE profile % 61 = 8),
clash AS (SELECT profile, field FROM routed WHERE route = 'conflict' UNION ALL SELECT profile, field FROM tiered WHERE profile % 61 = 8 AND field = 'B'),
resolved AS (SELECT digest, field, value FROM facts WHERE status = 'RESOLVED')"""
_GOLD_CHECKS = {
    "own_representative": "(SELECT representative FROM profiles GROUP BY 1 HAVING count(*) > 1)",
    "document_in_one_profile": "(SELECT digest FROM documents_ GROUP BY 1 HAVING count(*) > 1)",
    "every_document_is_there": "(SELECT DISTINCT digest FROM facts WHERE digest NOT IN (SELECT digest FROM documents_))",
    "one_representative_each": "(SELECT profile FROM documents_ WHERE representative GROUP BY 1 HAVING count(*) <> 1)",
    "no_profile_without_representative": "(SELECT profile FROM profiles WHERE profile NOT IN (SELECT profile FROM documents_ WHERE representative))",
    "fact_is_no_conflict": "(SELECT * FROM gold g WHERE EXISTS (SELECT 1 FROM clash c WHERE c.profile = g.profile AND c.field = g.field))",
    "fact_is_not_in_review": "(SELECT * FROM gold g WHERE EXISTS (SELECT 1 FROM review c WHERE c.profile = g.profile AND c.field = g.field))",
    "fact_names_its_document": "(SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM documents_ d WHERE d.profile = g.profile AND d.digest = g.digest))",
    "fact_has_a_tier": "(SELECT * FROM gold WHERE tier NOT IN ('A', 'B', 'C'))",
    "profile_is_unclaimed": "(SELECT * FROM profiles WHERE status <> 'HISTORICAL_UNCLAIMED')",
    "candidates_survive": "(SELECT DISTINCT low, high FROM candidates WHERE low NOT IN (SELECT profile FROM profiles) OR high NOT IN (SELECT profile FROM profiles))",
    "candidates_differ": "(SELECT * FROM candidates WHERE low = high)",
    "candidates_share_no_document": "(SELECT c.low, c.high, d.digest FROM candidates c JOIN (SELECT DISTINCT profile, digest FROM documents_) d ON d.profile = c.low JOIN (SELECT DISTINCT profile, digest FROM documents_) e ON e.profile = c.high AND e.digest = d.digest)",
    "counters_are_right": "(SELECT * FROM profiles p WHERE n_documents <> (SELECT count(*) FROM documents_ d WHERE d.profile = p.profile) OR n_facts <> (SELECT count(*) FROM gold g WHERE g.profile = p.profile))",
    "no_profile_is_empty": "(SELECT * FROM profiles WHERE profile NOT IN (SELECT profile FROM documents_))",
    "representative_is_its_own": "(SELECT * FROM profiles p WHERE NOT EXISTS (SELECT 1 FROM documents_ d WHERE d.profile = p.profile AND d.digest = p.representative))",
    "value_is_the_source_s": "(SELECT * FROM gold g LEFT JOIN resolved s ON s.digest = g.digest AND s.field = g.field WHERE s.value IS NULL OR s.value <> g.value)",
}


@query(_GOLD + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) AS violations FROM {v}" for k, v in _GOLD_CHECKS.items()))
def gold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariants of a store with faults of every kind: each count is what was broken."""
    store = facts(spark, sf_dir)
    return gold.violations(gold.damaged(gold.build(store)), store)


@query(
    f"""{WITH} {ROUTED},
wide AS (SELECT profile, max(value) FILTER (field = 'A') AS a, max(value) FILTER (field = 'B') AS b, max(value) FILTER (field = 'DRB1') AS d FROM routed WHERE route = 'fact' GROUP BY profile),
keyed AS (SELECT profile, a || '|' || b || '|' || d AS genotype FROM wide WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL),
numbered AS (SELECT *, min(profile) OVER (PARTITION BY genotype) AS low, count(*) OVER (PARTITION BY genotype) AS group_size FROM keyed)
SELECT genotype, low, profile AS high, group_size FROM numbered WHERE profile > low"""
)
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.duplicate_candidates(facts(spark, sf_dir))


@query(f"{WITH} SELECT field, status, count(*) AS n FROM facts GROUP BY ALL")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("field", "status").agg(F.count("*").alias("n"))


@query(
    f"""{WITH}, r AS (SELECT field, split_part(source, '|', 1) AS family, count(*) AS anchored, count(*) FILTER (status = 'RESOLVED') AS resolved,
       count(*) FILTER (reason = 'empty cell') AS empty FROM facts GROUP BY ALL)
SELECT *, round(resolved / anchored, 6) AS resolve_rate, anchored >= 200 AND resolved / anchored < 0.01 AS not_tested FROM r"""
)
def resolve_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored, resolved and empty cells by field and layout family; a field is untested where many are anchored and hardly any resolves."""
    rate = F.col("resolved") / F.col("anchored")
    rows = facts(spark, sf_dir).groupBy("field", F.substring_index("source", "|", 1).alias("family"))
    counts = rows.agg(F.count("*").alias("anchored"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if(F.col("reason") == "empty cell").alias("empty"))
    return counts.select("*", F.round(rate, 6).alias("resolve_rate"), ((F.col("anchored") >= 200) & (rate < 0.01)).alias("not_tested"))


LABELS = """,
labelled AS (
    SELECT f.*, CASE hash_state WHEN 0 THEN 'VALUE' WHEN 1 THEN 'VALUE' WHEN 2 THEN 'BLANK' WHEN 3 THEN 'PRESENT_ONLY' ELSE 'NOT_PRINTED' END AS state,
           CASE WHEN hash_state IN (0, 1) THEN field || '*' || lpad((hash_value % 3 + 1)::VARCHAR, 2, '0') END AS answer
    FROM (SELECT *, profile % 5 AS hash_state, CASE WHEN profile % 7 = 0 THEN profile ELSE coalesce(right(value, 2)::BIGINT - 1, profile) END AS hash_value FROM facts) f
),
outcomes AS (
    SELECT *, CASE WHEN status <> 'RESOLVED' THEN CASE WHEN state IN ('VALUE', 'PRESENT_ONLY') THEN 'MISSED' ELSE 'CORRECT_ABSTENTION' END
                   WHEN state = 'PRESENT_ONLY' THEN 'CORRECT' WHEN state = 'VALUE' AND value = answer THEN 'CORRECT' ELSE 'FALSE_ACCEPTANCE' END AS outcome
    FROM labelled
)"""


@query(
    f"""{WITH} {LABELS}
SELECT field, outcome, count(*) AS n FROM outcomes GROUP BY ALL"""
)
def label_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.labelled(facts(spark, sf_dir)).withColumn("outcome", scoring.outcome()).groupBy("field", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""{WITH} {LABELS}, s AS (SELECT field, count(*) AS cells, count(*) FILTER (outcome = 'CORRECT') AS correct, count(*) FILTER (outcome = 'FALSE_ACCEPTANCE') AS wrong,
    count(*) FILTER (outcome = 'MISSED') AS missed FROM outcomes GROUP BY field)
SELECT *, round(correct / nullif(correct + wrong, 0), 6) AS precision, round(correct / nullif(correct + missed + wrong, 0), 6) AS recall, CASE WHEN wrong = 0 THEN round(3.0 / cells, 6) END AS bound FROM s"""
)
def label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall by field, and the rule-of-three bound where nothing was wrong."""
    return scoring.score(scoring.labelled(facts(spark, sf_dir)))


@query(
    f"""{WITH} {LABELS}, g AS (SELECT field || ':' || CASE WHEN split_part(source, '|', 1) <> '' THEN split_part(source, '|', 1) ELSE split_part(rule_id, '/', 1) END AS evidence_group,
    outcome FROM outcomes WHERE status = 'RESOLVED'), n AS (SELECT evidence_group, count(*) AS labels, count(*) FILTER (outcome = 'CORRECT') AS correct FROM g GROUP BY ALL)
SELECT *, CASE WHEN labels >= 26 AND correct / labels >= 0.99 THEN 'A' ELSE 'B' END AS tier FROM n"""
)
def tier_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.labelled(facts(spark, sf_dir)).where("status = 'RESOLVED'")
    group = consolidate.evidence_group(F.col("field"), F.col("source"), F.col("rule_id"))
    return consolidate.tiers(rows.select(group.alias("evidence_group"), (scoring.outcome() == "CORRECT").alias("correct")))


ENGINES = """,
readings AS (
    SELECT profile, digest, field, engine, CASE (u * 7 + e) % 6 WHEN 0 THEN NULL ELSE field || '*' || lpad((CASE WHEN (u + e) % 4 = 0 THEN e ELSE u % 3 + 1 END)::VARCHAR, 2, '0') END AS reading
    FROM (SELECT *, profile % 97 + length(digest) AS u FROM facts) CROSS JOIN (VALUES ('north/1', 1), ('north/2', 2), ('south/1', 3)) AS t(engine, e)
)"""


@query(
    f"""{WITH} {ENGINES},
per AS (SELECT digest, profile, field, list_sort(list_distinct(list(reading) FILTER (reading IS NOT NULL))) AS vals,
       count(DISTINCT CASE WHEN reading IS NOT NULL THEN split_part(engine, '/', 1) END) AS families, count(*) FILTER (reading IS NULL) AS silent FROM readings GROUP BY ALL)
SELECT profile, digest, field, vals[1] AS agreed, families FROM per WHERE len(vals) = 1 AND families >= 2"""
)
def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.agreement(scoring.readings(facts(spark, sf_dir)))


@query(
    f"""{WITH}, roles AS (SELECT digest, bool_or(field = 'ROLE' AND status = 'RESOLVED') AS has_role, count(*) FILTER (status = 'RESOLVED' AND field IN ('A', 'B', 'DRB1', 'DQB1')) AS genes FROM facts GROUP BY digest)
SELECT f.digest, f.field, CASE WHEN f.reason = 'foreign prefix' THEN 3 WHEN f.status = 'RESOLVED' THEN 2 WHEN r.has_role AND r.genes >= 1 THEN 1
       WHEN f.reason = 'too many boxes' THEN 4 WHEN split_part(f.source, '|', 1) = 'caption' THEN 4 ELSE 5 END AS tier
FROM facts f JOIN roles r USING (digest) WHERE f.status = 'REVIEW_REQUIRED' OR (f.status = 'RESOLVED' AND f.second_allele IS NULL)"""
)
def queue_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.queue(facts(spark, sf_dir))


@query(
    f"""{WITH}, h AS (SELECT *, sha256('7|' || digest || '|' || field) AS dice FROM facts WHERE status = 'RESOLVED'),
ranked AS (SELECT digest, field, source, row_number() OVER (PARTITION BY field, source ORDER BY dice) AS nth FROM h)
SELECT digest, field, source, nth FROM ranked WHERE nth <= 5"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five resolved cells of each field and source, drawn by a seeded hash; the draw is the same on any cluster."""
    dice = F.sha2(F.concat_ws("|", F.lit("7"), "digest", "field"), 256)
    rows = facts(spark, sf_dir).where("status = 'RESOLVED'").withColumn("dice", dice)
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("field", "source").orderBy("dice"))).where("nth <= 5").select("digest", "field", "source", "nth")


@query(
    f"""{WITH}, n AS (SELECT profile, row_number() OVER (ORDER BY profile) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT profile FROM facts WHERE field = 'DRB1' AND status = 'RESOLVED'))
SELECT profile FROM n WHERE i % greatest(1, n // 25) = 0 AND i // greatest(1, n // 25) < 25"""
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th typed profile in order. Places come from a count of the rows before, by range partitions, not from one global window."""
    return scoring.systematic(facts(spark, sf_dir).where("field = 'DRB1' AND status = 'RESOLVED'").select("profile").distinct(), "profile", 25)


WITHDRAWN = """,
layered AS (
    SELECT *, CASE WHEN status = 'RESOLVED' AND second_allele IS NULL AND split_part(source, '|', 1) = 'row' THEN 'REVIEW_REQUIRED' ELSE status END AS status_after,
           CASE WHEN status = 'RESOLVED' AND second_allele IS NULL AND split_part(source, '|', 1) = 'row' THEN source || '|gate1-withdrawn' ELSE source END AS source_after
    FROM facts
)"""


@query(f"{WITH} {WITHDRAWN} SELECT field, status, status_after, source_after, count(*) AS n FROM layered GROUP BY ALL")
def precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = facts(spark, sf_dir)
    after = decisions.withdraw(before)
    both = before.join(after.select("profile", "digest", "field", F.col("status").alias("status_after"), F.col("source").alias("source_after")), ["profile", "digest", "field"])
    return both.groupBy("field", "status", "status_after", "source_after").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT count(*) AS cells, 0 AS changed_twice, 0 AS not_restored FROM facts")
def decision_layers_are_reversible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withdrawing twice changes nothing more, and undoing it gives the base back."""
    base = facts(spark, sf_dir)
    return decisions.reversible(base)


@query(
    f"""{WITH},
old AS (SELECT digest, field, value FROM facts WHERE status = 'RESOLVED' AND profile % 5 <> 0),
new AS (SELECT digest, field, CASE WHEN profile % 3 = 0 AND value LIKE '%01' THEN field || '*09' ELSE value END AS value FROM facts WHERE status = 'RESOLVED' AND profile % 4 <> 0),
d AS (SELECT coalesce(o.field, n.field) AS field, CASE WHEN o.value IS NULL THEN 'gained' WHEN n.value IS NULL THEN 'dropped' WHEN o.value = n.value THEN 'same' ELSE 'swapped' END AS change
      FROM old o FULL JOIN new n ON o.digest = n.digest AND o.field = n.field)
SELECT field, change, count(*) AS n FROM d GROUP BY ALL"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = facts(spark, sf_dir).where("status = 'RESOLVED'")
    old = base.where("profile % 5 <> 0").select("digest", "field", "value")
    new = base.where("profile % 4 <> 0").select("digest", "field", F.when((F.col("profile") % 3 == 0) & F.col("value").endswith("01"), F.concat("field", F.lit("*09"))).otherwise(F.col("value")).alias("value"))
    return decisions.diff(old, new).groupBy("field", "change").agg(F.count("*").alias("n"))
