"""Scoring of readings against labels, agreement of engines, review queue, draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.shared import written

from pairstone.sources.facts import GENES


def labelled(facts: DataFrame) -> DataFrame:
    """facts with a human answer for each cell: state and answer, derived from keys."""
    five = F.col("profile") % 5
    state = F.when(five <= 1, "VALUE").when(five == 2, "BLANK").when(five == 3, "PRESENT_ONLY").otherwise("NOT_PRINTED")
    drawn = F.when(F.col("profile") % 7 == 0, F.col("profile")).otherwise(F.coalesce(F.try_to_number(F.right("value", F.lit(2)), F.lit("99")).cast("long") - 1, F.col("profile")))
    return facts.select("*", state.alias("state"), F.when(five <= 1, F.concat("field", F.lit("*"), F.lpad((drawn % 3 + 1).cast("string"), 2, "0"))).alias("answer"))


def outcome() -> Column:
    """What a reading is worth against its label; first matching line."""
    state = F.col("state")
    return (
        F.when((F.col("status") != "RESOLVED") & state.isin("VALUE", "PRESENT_ONLY", "ABSENT"), "MISSED")
        .when(F.col("status") != "RESOLVED", "CORRECT_ABSTENTION")
        .when(state == "PRESENT_ONLY", "CORRECT")
        .when((state == "VALUE") & (F.col("value") == F.col("answer")), "CORRECT")
        .otherwise("FALSE_ACCEPTANCE")
    )


def score(rows: DataFrame) -> DataFrame:
    found = rows.withColumn("outcome", outcome()).groupBy("field").agg(F.count("*").alias("cells"), *[F.count_if(F.col("outcome") == x).alias(y) for x, y in (("CORRECT", "correct"), ("FALSE_ACCEPTANCE", "wrong"), ("MISSED", "missed"))])
    correct, wrong, missed = F.col("correct"), F.col("wrong"), F.col("missed")
    return found.select("*", F.round(F.try_divide(correct, correct + wrong), 6).alias("precision"), F.round(F.try_divide(correct, correct + missed + wrong), 6).alias("recall"), F.when(wrong == 0, F.round(F.lit(3.0) / F.col("cells"), 6)).alias("bound"))


def readings(facts: DataFrame) -> DataFrame:
    """Readings of three engines of two families for each cell, derived from keys."""
    engines = F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), F.lit(e).alias("e")) for n, e in (("north/1", 1), ("north/2", 2), ("south/1", 3))])).alias("x")
    u, e = F.col("profile") % 97 + F.length("digest"), F.col("x.e")
    number = F.when((u + e) % 4 == 0, e.cast("long")).otherwise(u % 3 + 1)
    return facts.select("profile", "digest", "field", engines).select("profile", "digest", "field", "x.engine", F.when((u * 7 + e) % 6 != 0, F.concat("field", F.lit("*"), F.lpad(number.cast("string"), 2, "0"))).alias("reading"))


def agreement(read: DataFrame) -> DataFrame:
    """Cells where all readings are one, from at least two engine families."""
    per = read.where("reading IS NOT NULL").groupBy("profile", "digest", "field").agg(F.min("reading").alias("agreed"), F.max("reading").alias("other"), F.count_distinct(F.substring_index("engine", "/", 1)).alias("families"))
    return per.where("agreed = other AND families >= 2").drop("other")


def queue(facts: DataFrame) -> DataFrame:
    """Review tiers of cells under review or unstable; first matching line."""
    per = facts.groupBy("digest").agg(F.bool_or((F.col("field") == "ROLE") & (F.col("status") == "RESOLVED")).alias("has_role"), F.count_if((F.col("status") == "RESOLVED") & F.col("field").isin(*GENES)).alias("genes"))
    open_ = facts.where((F.col("status") == "REVIEW_REQUIRED") | ((F.col("status") == "RESOLVED") & F.col("second_allele").isNull()))
    tier = (
        F.when(F.col("reason") == "foreign prefix", 3)
        .when(F.col("status") == "RESOLVED", 2)
        .when(F.col("has_role") & (F.col("genes") >= 1), 1)
        .when(F.col("reason") == "too many boxes", 4)
        .when(F.substring_index("source", "|", 1) == "caption", 4)
        .otherwise(5)
    )
    return open_.join(per, "digest").select("digest", "field", tier.alias("tier"))


def systematic(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Every n-th of `size` places of rows in the order of key: rows are numbered within written ranges, then shifted by the ranges before."""
    number = F.monotonically_increasing_id()
    ranges = rows.select(key).repartitionByRange(key).sortWithinPartitions(key)
    parts = written(ranges.select(key, F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("within")))
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    total, starts, before = sum(r.n for r in counts), [], 0
    for r in counts:
        starts.append((r.part, before))
        before += r.n
    if not total:
        return rows.select(key)
    step = max(1, total // size)
    offsets = rows.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.col("within")
    return parts.join(F.broadcast(offsets), "part").where((place % step == 0) & (place < step * size)).select(key)

