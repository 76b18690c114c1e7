"""Decision layers over an immutable base: withdrawals that can be undone, refreshes, differences of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "gate1-withdrawn"
KEY = ["profile", "digest", "field"]


def withdraw(facts: DataFrame) -> DataFrame:
    """Readings of a row layout without a second-allele flag go to review; the source says so, which makes the step its own inverse's key."""
    hit = (F.col("status") == "RESOLVED") & F.col("second_allele").isNull() & (F.substring_index("source", "|", 1) == "row") & ~F.col("source").endswith(TAG)
    return facts.withColumns({"status": F.when(hit, "REVIEW_REQUIRED").otherwise(F.col("status")), "source": F.when(hit, F.concat("source", F.lit(f"|{TAG}"))).otherwise(F.col("source"))})


def restore(facts: DataFrame) -> DataFrame:
    """Undo withdraw(): only what carries its tag changes."""
    hit = F.col("source").endswith(f"|{TAG}")
    return facts.withColumns({"status": F.when(hit, "RESOLVED").otherwise(F.col("status")), "source": F.when(hit, F.regexp_replace("source", rf"\|{TAG}$", "")).otherwise(F.col("source"))})


def reversible(base: DataFrame) -> DataFrame:
    once = withdraw(base)
    twice, undone = withdraw(once), restore(once)

    def differing(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.join(b.select(*KEY, F.col("status").alias("s2"), F.col("source").alias("t2")), KEY).agg(F.count_if(~F.col("status").eqNullSafe(F.col("s2")) | ~F.col("source").eqNullSafe(F.col("t2"))).alias(name))

    return base.agg(F.count("*").alias("cells")).crossJoin(differing(once, twice, "changed_twice")).crossJoin(differing(base, undone, "not_restored"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """digest, field, change: gained, dropped, swapped or same between two snapshots."""
    a, b = old.withColumnRenamed("value", "before"), new.withColumnRenamed("value", "after")
    change = F.when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "dropped").when(F.col("before") == F.col("after"), "same").otherwise("swapped")
    return a.join(b, ["digest", "field"], "full").select("digest", "field", change.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """Keyed upsert: new keys are inserted, changed hashes replace the row, equal ones only move last_seen. Adds `action`."""
    s, i = stored.alias("s"), incoming.alias("i")
    joined = s.join(i, keys, "full")
    same = F.col(f"s.{hash_column}").eqNullSafe(F.col(f"i.{hash_column}"))
    action = F.when(F.col(f"s.{hash_column}").isNull(), "inserted").when(F.col(f"i.{hash_column}").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    fresh = action.isin("inserted", "updated")
    others = [c for c in stored.columns if c not in (*keys, "first_seen", "last_seen")]
    values = [F.when(fresh, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in others]
    seen = [F.when(fresh, F.col("i.last_seen")).otherwise(F.col("s.first_seen")).alias("first_seen"), F.coalesce("i.last_seen", "s.last_seen").alias("last_seen")]
    return joined.select(*keys, *values, *seen, action.alias("action"))
