"""Passes that change a facts store as pure layers: promotion, publication, refresh, carrying conflicts, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["profile", "digest", "field"]


def promoted(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cells under review that an independent reading confirms resolve with its value; the source says by which pass.

    verdicts: KEY, verdict, reading. A low-quality page is never promoted. Applying the pass again changes nothing.
    """
    joined = facts.join(verdicts, KEY, "left")
    hit = (F.col("status") == "REVIEW_REQUIRED") & (F.col("verdict") == "CONFIRMED") & (F.col("band") != "LOW")
    new = {"status": F.when(hit, "RESOLVED").otherwise(F.col("status")), "value": F.when(hit, F.col("reading")).otherwise(F.col("value")), "source": F.when(hit, F.concat_ws("|", "source", F.lit("proposal"))).otherwise(F.col("source"))}
    return joined.withColumns(new).select(*facts.columns)


def published(facts: DataFrame, claims: DataFrame, field: str) -> DataFrame:
    """Claims (profile, claim) fill a field that no document of the profile resolved; nothing is overwritten."""
    settled = facts.where((F.col("field") == field) & (F.col("status") == "RESOLVED")).select("profile").distinct()
    return claims.where("claim IS NOT NULL").join(settled, "profile", "left_anti").select("profile", F.lit(field).alias("field"), F.col("claim").alias("value"), F.lit("CAPTION_CLAIM").alias("provenance"))


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """New cells with the old stability where nothing changed; changed cells lose what depended on them."""
    before = old.select("digest", "field", F.col("value").alias("was"), F.col("stability").alias("kept"))
    joined = new.join(before, ["digest", "field"], "left")
    same = F.col("value").eqNullSafe(F.col("was")) & F.col("kept").isNotNull()
    return joined.select("digest", "field", "value", F.when(same, F.col("kept")).alias("stability"), (~same & F.col("was").isNotNull()).alias("invalidated"))


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def carried_conflicts(refused: DataFrame, home: DataFrame) -> DataFrame:
    """Refused near-duplicates of different profiles as (low, high) pairs of profiles, each once."""
    one, two = home.select(F.col("id").alias("a"), F.col("profile").alias("pa")), home.select(F.col("id").alias("b"), F.col("profile").alias("pb"))
    met = refused.join(one, "a").join(two, "b").where("pa <> pb")
    return met.groupBy(F.least("pa", "pb").alias("low"), F.greatest("pa", "pb").alias("high")).agg(F.count("*").alias("pairs"))


def bounded_list(rows: DataFrame, group: str, order: list[str], most: int, text: str, size: int) -> DataFrame:
    """At most `most` texts of each group in order, cut to `size` characters, with how many there are in all."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    total = rows.groupBy(group).agg(F.count("*").alias("of"))
    return rows.withColumn("place", place).where(F.col("place") <= most).join(total, group).select(group, "place", "of", F.substring(text, 1, size).alias(text))


def shared_keys(one: DataFrame, two: DataFrame) -> DataFrame:
    """By profile: values that both stores have, values of one only, whether one's are among the other's."""
    a = one.groupBy("profile").agg(F.collect_set("value").alias("x"))
    b = two.groupBy("profile").agg(F.collect_set("value").alias("y"))
    none = F.array().cast("array<string>")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    return a.join(b, "profile", "full").select("profile", F.size(F.array_intersect(x, y)).alias("shared"), F.size(F.array_except(x, y)).alias("first_only"), F.size(F.array_except(y, x)).alias("second_only"), (F.size(F.array_except(x, y)) == 0).alias("subset"))
