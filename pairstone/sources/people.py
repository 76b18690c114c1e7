"""Profiles derived from integer keys: recipients from customers, donors from suppliers.

The driver's tables hold no typings, so each one is computed from its key with arithmetic that
SQL engines share. One row for each person and locus; eligibility, group and the rest by person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Loci in the order of the mismatch vector, families used for each, and the loci that carry weights.
LOCI = ("A", "B", "C", "DRB1", "DQB1")
FAMILIES = (7, 9, 6, 5, 4)
PRESENCE = ("DRB3", "DRB4", "DRB5")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side (D or R), key, s (0 for recipients, 1 for donors)."""
    recipients = table(spark, sf_dir, "customer").select(F.lit("R").alias("side"), F.col("c_custkey").cast("long").alias("key"), F.lit(0).alias("s"))
    donors = table(spark, sf_dir, "supplier").select(F.lit("D").alias("side"), F.col("s_suppkey").cast("long").alias("key"), F.lit(1).alias("s"))
    return recipients.unionByName(donors)


def typings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, key, locus, value, second_allele, tier: the stored locus values in all the shapes that the parser knows."""
    loci = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(name).alias("locus"), F.lit(n).alias("n")) for j, (name, n) in enumerate(zip(LOCI, FAMILIES, strict=True))])).alias("l")
    rows = people(spark, sf_dir).select("side", "key", "s", loci).select("side", "key", "s", "l.*")
    a1 = F.lpad(((F.col("key") * 7 + F.col("s") + F.col("j")) % F.col("n") + 1).cast("string"), 2, "0")
    a2 = F.lpad(((F.col("key") * 11 + F.col("s") + 3 * F.col("j")) % F.col("n") + 1).cast("string"), 2, "0")
    shape = (F.col("key") * 13 + F.col("j") + F.col("s")) % 11
    star = F.concat(F.col("locus"), F.lit("*"))
    value = (
        F.when(shape == 0, None)
        .when(shape == 1, a1)
        .when(shape == 2, F.concat(star, a1))
        .when(shape == 3, F.concat_ws(",", a1, a2, a1))
        .when(shape == 4, F.concat(F.lit("X*"), a1, F.lit(","), a2))
        .when(shape == 5, F.concat(star, a1, F.lit(":01,"), star, a2, F.lit(":02")))
        .when(shape == 6, F.concat(a1, F.lit("/"), a2))
        .when(shape == 7, F.concat(star, a1, F.lit(" "), a2))
        .otherwise(F.concat(star, a1, F.lit(","), star, a2))
    )
    flag = F.when(shape == 2, "UNREAD").when(shape == 9, "READ").when(shape == 10, F.when(F.col("key") % 5 == 0, "UNREAD"))
    return rows.select("side", "key", "locus", value.alias("value"), flag.alias("second_allele"), _pick((F.col("key") + F.col("j")) % 4, ["A", "B", "C", None]).alias("tier"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, key, abo, lab (whether a laboratory measured the group), eligible, crossmatch, dsa, presence of three genes."""
    k, s = F.col("key"), F.col("s")
    presence = [_pick((k * 3 + s + g) % 5, ["PRESENT", "ABSENT", "UNKNOWN", "REVIEW_REQUIRED", "PRESENT"]).alias(name) for g, name in enumerate(PRESENCE)]
    return people(spark, sf_dir).select(
        "side",
        "key",
        F.when(k % 17 == 5, None).when(k % 19 == 7, "O+?").otherwise(_pick((k + s) % 4, ["O", "A", "B", "AB"])).alias("abo"),
        (k % 3 != 0).alias("lab"),
        (k % 23 != 11).alias("eligible"),
        F.when(k % 29 == 13, "POSITIVE").otherwise("NOT_PERFORMED").alias("crossmatch"),
        (k % 31 == 17).alias("dsa"),
        *presence,
    )
