"""A consolidated store as tables, and the invariants that a finished build must keep, each as a count of violations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstone.operators import consolidate
from pairstone.shared import written

UNCLAIMED = "HISTORICAL_UNCLAIMED"


@dataclass(frozen=True)
class Store:
    profiles: DataFrame  # profile, representative, n_documents, n_facts, status
    documents: DataFrame  # profile, digest, representative
    facts: DataFrame  # profile, field, digest, value, tier
    review: DataFrame  # profile, field
    conflicts: DataFrame  # profile, field
    candidates: DataFrame  # low, high


def build(facts: DataFrame) -> Store:
    """The tables of a store from its facts."""
    routed = written(consolidate.routed(facts))
    representatives = consolidate.representatives(facts)
    documents = facts.select("profile", "digest").distinct().join(representatives, "profile").select("profile", "digest", (F.col("digest") == F.col("representative")).alias("representative"))
    tier = F.when(F.col("evidence_group").endswith(":grid"), "A").when(F.col("evidence_group").endswith(":row"), "B").otherwise("C")
    found = routed.where("route = 'fact'").select("profile", "field", "digest", "value", tier.alias("tier"))
    counts = documents.groupBy("profile").agg(F.count("*").alias("n_documents")).join(found.groupBy("profile").agg(F.count("*").alias("n_facts")), "profile", "left")
    profiles = representatives.join(counts, "profile").select("profile", "representative", "n_documents", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.lit(UNCLAIMED).alias("status"))
    candidates = consolidate.duplicate_candidates(facts).select("low", "high")
    return Store(profiles, documents, found, *(routed.where(F.col("route") == x).select("profile", "field") for x in ("review", "conflict")), candidates)


def damaged(store: Store) -> Store:
    """The store with faults of every kind that the invariants look for, placed by key."""
    p = F.col("profile")
    strayed = store.documents.where(p % 41 == 3).select((p + 1).alias("profile"), "digest", (p % 82 == 3).alias("representative"))
    documents = store.documents.where(p % 47 != 9).withColumn("representative", F.when(p % 53 == 2, False).otherwise(F.col("representative")))
    facts = store.facts.withColumns({"tier": F.when(p % 37 == 5, "Z").otherwise(F.col("tier")), "value": F.when(p % 31 == 2, F.concat("value", F.lit("x"))).otherwise(F.col("value"))})
    profiles = store.profiles.withColumns(
        {
            "n_documents": F.col("n_documents") + (p % 29 == 4).cast("long"),
            "status": F.when(p % 43 == 6, "CLAIMED").otherwise(F.col("status")),
            "representative": F.when(p % 59 == 1, "none").otherwise(F.col("representative")),
        }
    )
    taken = store.facts.where(p % 61 == 8).select("profile", "field")
    return replace(
        store,
        profiles=profiles,
        documents=documents.unionByName(strayed),
        facts=facts,
        review=store.review.unionByName(taken),
        conflicts=store.conflicts.unionByName(taken.where(F.col("field") == "B")),
        candidates=store.candidates.withColumn("high", F.when(F.col("high") % 3 == 0, -1).otherwise(F.col("high"))),
    )


def violations(store: Store, source: DataFrame) -> DataFrame:
    """check, violations: sixteen invariants of a store against itself and the facts that it was built from."""
    profiles, documents, facts = store.profiles, store.documents, store.facts
    own = documents.select("profile", "digest").distinct()
    stored = source.where("status = 'RESOLVED'").select("digest", "field", F.col("value").alias("stored"))
    here = profiles.select("profile")
    counted = profiles.join(documents.groupBy("profile").agg(F.count("*").alias("d")), "profile", "left").join(facts.groupBy("profile").agg(F.count("*").alias("f")), "profile", "left")
    lost = store.candidates.join(here.withColumnRenamed("profile", "low"), "low", "left_anti").select("low", "high").unionByName(store.candidates.join(here.withColumnRenamed("profile", "high"), "high", "left_anti").select("low", "high"))
    of = own.select(F.col("profile").alias("low"), "digest"), own.select(F.col("profile").alias("high"), "digest")
    found = {
        "own_representative": profiles.groupBy("representative").count().where("count > 1"),
        "document_in_one_profile": documents.groupBy("digest").count().where("count > 1"),
        "every_document_is_there": source.select("digest").distinct().join(documents.select("digest"), "digest", "left_anti"),
        "one_representative_each": documents.where("representative").groupBy("profile").count().where("count <> 1"),
        "no_profile_without_representative": profiles.join(documents.where("representative").select("profile"), "profile", "left_anti"),
        "fact_is_no_conflict": facts.join(store.conflicts, ["profile", "field"], "left_semi"),
        "fact_is_not_in_review": facts.join(store.review, ["profile", "field"], "left_semi"),
        "fact_names_its_document": facts.join(own, ["profile", "digest"], "left_anti"),
        "fact_has_a_tier": facts.where(~F.col("tier").isin("A", "B", "C")),
        "profile_is_unclaimed": profiles.where(F.col("status") != UNCLAIMED),
        "candidates_survive": lost.distinct(),
        "candidates_differ": store.candidates.where("low = high"),
        "candidates_share_no_document": store.candidates.join(of[0], "low").join(of[1], ["high", "digest"]),
        "counters_are_right": counted.where("n_documents <> coalesce(d, 0) OR n_facts <> coalesce(f, 0)"),
        "no_profile_is_empty": profiles.join(own.select("profile"), "profile", "left_anti"),
        "representative_is_its_own": profiles.join(own.withColumnRenamed("digest", "representative"), ["profile", "representative"], "left_anti"),
        "value_is_the_source_s": facts.join(stored, ["digest", "field"], "left").where("stored IS NULL OR stored <> value"),
    }
    rows = [x.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, x in found.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
