"""Consolidation of document facts into one answer for each profile and field.

First matching line: more than one distinct resolved value -> conflict; one -> fact, by the
representative document's row if that resolved, else by the smallest digest's; any row under review -> review;
else unknown. All of it is one pre-aggregated pass over (profile, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LABELS, LEAST_SHARE = 26, 0.99


def representatives(facts: DataFrame) -> DataFrame:
    """The representative document of each profile: here the one with the largest digest."""
    return facts.groupBy("profile").agg(F.max("digest").alias("representative"))


def evidence_group(field: Column, source: Column, rule_id: Column) -> Column:
    """Field and first source tag, or else the rule's family."""
    tag = F.substring_index(source, "|", 1)
    return F.concat_ws(":", field, F.when(tag != "", tag).otherwise(F.substring_index(rule_id, "/", 1)))


def routed(facts: DataFrame) -> DataFrame:
    """profile, field, route, and what the route carries."""
    resolved = F.col("status") == "RESOLVED"
    row = F.struct("digest", "value", "second_allele", evidence_group(F.col("field"), F.col("source"), F.col("rule_id")).alias("evidence_group"))
    with_rep = facts.join(representatives(facts), "profile")
    grouped = with_rep.groupBy("profile", "field").agg(
        F.array_sort(F.collect_set(F.when(resolved, F.col("value")))).alias("values"),
        F.max(F.when(resolved & (F.col("digest") == F.col("representative")), row)).alias("own"),
        F.min(F.when(resolved, row)).alias("first"),
        F.count("*").alias("members_answering"),
        F.count_if(~resolved).alias("members_unresolved"),
        F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("in_review"),
        F.min_by("status", "digest").alias("state"),
    )
    n = F.size("values")
    route = F.when(n > 1, "conflict").when(n == 1, "fact").when(F.col("in_review") > 0, "review").otherwise("unknown")
    chosen = F.when(n == 1, F.coalesce("own", "first"))
    return grouped.select("profile", "field", route.alias("route"), "values", chosen["digest"].alias("digest"), chosen["value"].alias("value"), chosen["evidence_group"].alias("evidence_group"), "members_answering", "members_unresolved", F.when(n == 0, F.col("state")).alias("state"))


def conflicts(facts: DataFrame) -> DataFrame:
    """A star from the smallest (value, digest) of a conflict to the smallest digest of each other value."""
    rows = facts.where("status = 'RESOLVED'").groupBy("profile", "field", "value").agg(F.min("digest").alias("digest"))
    centers = rows.groupBy("profile", "field").agg(F.min(F.struct("value", "digest")).alias("c"), F.count("*").alias("n")).where("n > 1")
    return rows.join(centers, ["profile", "field"]).where(F.col("value") != F.col("c.value")).select("profile", "field", F.col("c.value").alias("value_a"), F.col("c.digest").alias("digest_a"), F.col("value").alias("value_b"), F.col("digest").alias("digest_b"))


def tiers(labelled: DataFrame) -> DataFrame:
    """Tier of each rule group from (group, correct): A with enough labels and share, else B; C is for groups without labels."""
    share = F.col("correct") / F.col("labels")
    return labelled.groupBy("evidence_group").agg(F.count("*").alias("labels"), F.count_if("correct").alias("correct")).withColumn("tier", F.when((F.col("labels") >= LEAST_LABELS) & (share >= LEAST_SHARE), "A").otherwise("B"))


def duplicate_candidates(facts: DataFrame) -> DataFrame:
    """Profiles with the same values in all gene fields, in pairs (low, high); values are compared as stored."""
    wide = routed(facts).where("route = 'fact'").groupBy("profile").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("m"))
    key = F.concat_ws("|", *[F.col("m")[g] for g in ("A", "B", "DRB1")])
    keyed = wide.where(F.col("m")["A"].isNotNull() & F.col("m")["B"].isNotNull() & F.col("m")["DRB1"].isNotNull()).select("profile", key.alias("genotype"))
    least = keyed.groupBy("genotype").agg(F.min("profile").alias("low"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(least, "genotype").where("profile > low").select("genotype", "low", F.col("profile").alias("high"), F.col("n").alias("group_size"))
