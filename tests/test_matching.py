"""Hand tables of typing, mismatch, levels, penalties, and properties over whole grids."""

import pytest
from pyspark.sql import functions as F

from pairstone.functions import alleles
from pairstone.operators import matching as m


@pytest.mark.parametrize(
    ("value", "flag", "typing", "found"),
    [
        (None, None, "ABSENT", []),
        (" ", None, "ABSENT", []),
        (",;", "READ", "ABSENT", []),
        ("A*02,A*24", None, "BOTH", ["A*02", "A*24"]),
        ("02/24", None, "BOTH", ["A*02", "A*24"]),
        ("a*02 24", "read", "BOTH", ["A*02", "A*24"]),
        ("02", None, "ONE", ["A*02"]),
        ("A*02", "UNREAD", "ONE", ["A*02"]),
        ("02,24", "UNREAD", "REVIEW_REQUIRED", []),
        ("02", "READ", "REVIEW_REQUIRED", []),
        ("02,24,26", None, "REVIEW_REQUIRED", []),
        ("B*07,24", None, "REVIEW_REQUIRED", []),
    ],
)
def test_locus_value(spark, value, flag, typing, found):
    row = spark.createDataFrame([(value, flag, "A")], "v string, f string, l string").select(alleles.locus_value(F.col("v"), F.col("f"), F.col("l")).alias("x")).first().x
    assert (row.typing, row.alleles) == (typing, found)


def test_depth_and_truncation(spark):
    rows = spark.createDataFrame([("A*02",), ("A*02:01",), ("A*24N",), ("A*24N:02",), ("A*02::01",)], "a string").select(alleles.depth(F.col("a")), alleles.truncate(F.col("a"), 1), alleles.truncate(F.col("a"), 2)).collect()
    assert [tuple(r) for r in rows] == [(1, "A*02", "A*02"), (2, "A*02", "A*02:01"), (1, "A*24N", "A*24N"), (2, "A*24", "A*24N:02"), (2, "A*02", "A*02::01")]


def compared(spark, pairs):
    """The mismatch of each pair of cells (typing, allele, ...)."""
    rows = spark.createDataFrame([(i, d[0], [*d[1:]], r[0], [*r[1:]]) for i, (d, r) in enumerate(pairs)], "i int, dt string, da array<string>, rt string, ra array<string>")

    def cell(side):
        cut = alleles.prepared(F.col(f"{side}a"))
        return F.struct(F.col(f"{side}t").alias("typing"), F.col(f"{side}a").alias("alleles"), F.lit("A").alias("tier"), cut["least"].alias("least"), cut["at"].alias("at"))

    return [r.x for r in rows.select("i", cell("d").alias("d"), cell("r").alias("r")).select("i", m.mismatch(F.col("d"), F.col("r")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("donor", "recipient", "expected"),
    [
        (("BOTH", "A*02", "A*24"), ("BOTH", "A*02", "A*24"), ("KNOWN", 0, 0)),
        (("BOTH", "A*02", "A*24"), ("BOTH", "A*01", "A*03"), ("KNOWN", 2, 2)),
        (("BOTH", "A*02", "A*02"), ("BOTH", "A*01", "A*03"), ("KNOWN", 1, 1)),
        (("ONE", "A*02"), ("BOTH", "A*02", "A*03"), ("RANGE", 0, 1)),
        (("BOTH", "A*02", "A*24"), ("ONE", "A*02"), ("RANGE", 0, 1)),
        (("ONE", "A*02"), ("ONE", "A*02"), ("RANGE", 0, 1)),
        (("BOTH", "A*02:01", "A*24:02"), ("BOTH", "A*02", "A*24"), ("KNOWN", 0, 0)),
        (("REVIEW_REQUIRED",), ("BOTH", "A*02", "A*24"), ("UNKNOWN", None, None)),
        (("ABSENT",), ("BOTH", "A*02", "A*24"), ("UNKNOWN", None, None)),
    ],
)
def test_mismatch(spark, donor, recipient, expected):
    (row,) = compared(spark, [(donor, recipient)])
    assert (row.status, row.lower, row.upper) == expected


def test_asymmetry_of_known_counts(spark):
    """MM(D->R) - MM(R->D) = distinct donor alleles - distinct recipient alleles, over a whole grid."""
    names = ["A*01", "A*02", "A*03"]
    cells = [("BOTH", a, b) for a in names for b in names]
    pairs = [(d, r) for d in cells for r in cells]
    forth, back = compared(spark, pairs), compared(spark, [(r, d) for d, r in pairs])
    for (d, r), x, y in zip(pairs, forth, back, strict=True):
        assert x.upper - y.upper == len(set(d[1:])) - len(set(r[1:]))


def test_levels(spark):
    cases = [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, None, 2), (0, 1, 0, 2), (0, 2, 0, 3), (1, 1, 0, 4), (1, 2, 0, 5), (2, 0, 0, 6), (2, 2, 2, 7), (None, 0, 0, 99), (0, None, 0, 99)]
    rows = spark.createDataFrame(cases, "dr int, b int, a int, e int").select(m.level(F.col("dr"), F.col("b"), F.col("a")).alias("x"), "e").collect()
    assert [r.x for r in rows] == [r.e for r in rows]


def test_losing_a_typing_never_improves_a_place(spark):
    """For every pair and scored locus, deleting the donor's typing doesn't lower the sort key."""
    everyone = m.profiles(spark, "/root/testdata/sf0.001")
    pairs = everyone.where("side = 'R'").select(F.struct("*").alias("r")).crossJoin(everyone.where("side = 'D'").select(F.struct("*").alias("d")))
    key = ("bucket", "level", "dq", "penalty", "evidence", "unknown")
    base = m.scored(pairs).where("bucket <= 1").select(F.col("d.key").alias("dk"), F.col("r.key").alias("rk"), F.struct(*key).alias("before"))
    empty = F.struct(F.lit("ABSENT").alias("typing"), F.array().cast("array<string>").alias("alleles"))
    for locus in m.SCORED:
        cut = pairs.withColumn("d", F.col("d").withField(f"{locus}.typing", empty["typing"]).withField(f"{locus}.alleles", empty["alleles"]))
        after = m.scored(cut).select(F.col("d.key").alias("dk"), F.col("r.key").alias("rk"), F.struct(*key).alias("after"))
        assert base.join(after, ["dk", "rk"]).where("after < before").count() == 0


def test_blocked_pairs_are_never_ranked(spark):
    everyone = m.possible_pairs(spark, "/root/testdata/sf0.001")
    rows = m.ranked(everyone, 3)
    assert rows.where("bucket > 1").count() == 0
    assert rows.groupBy("anchor", "place").count().where("count > 1").count() == 0
