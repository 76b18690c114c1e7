"""Queries of the token grammar: tokens are put together from parts, and the SQL has the parts, not the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.functions import glyphs
from pairstone.plans.registry import query
from pairstone.sources import strict
from pairstone.sources.people import _pick, table

_NAMES = ["A", "B", "C", "DRB1", "DQB1", "DPA1"]
_STARS = ["*", "*", "+", "~", ""]
_PARTS_SQL = f"""parts AS (
    SELECT p_partkey AS id, ({_NAMES})[p_partkey % 6 + 1] AS locus, ({_STARS})[p_partkey // 6 % 5 + 1] AS star,
           lpad((p_partkey % 89 + 1)::VARCHAR, 2, '0') AS f1, CASE WHEN p_partkey % 4 = 1 THEN lpad((p_partkey % 31 + 1)::VARCHAR, 2, '0') END AS f2,
           p_partkey % 4 = 1 AND p_partkey % 8 = 5 AS suffixed, p_partkey % 5 = 3 AS damaged FROM part
),
tokens AS (
    SELECT *, CASE WHEN damaged AND star <> '' THEN translate(f1, '10', 'lO') ELSE f1 END AS g1 FROM parts
)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    two = lambda n: F.lpad((k % n + 1).cast("string"), 2, "0")
    star = _pick(F.floor(k / 6) % 5, _STARS)
    damaged = (k % 5 == 3) & (star != "")
    first = F.when(damaged, F.translate(two(89), "10", "lO")).otherwise(two(89))
    second = F.when(k % 4 == 1, F.concat(F.lit(":"), two(31), F.when(k % 8 == 5, "N").otherwise(""))).otherwise("")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(_pick(k % 6, _NAMES), star, first, second).alias("token"))


@query(
    f"""WITH {_PARTS_SQL} SELECT id, locus || '*' || f1 || coalesce(':' || f2, '') || CASE WHEN suffixed THEN 'N' ELSE '' END AS allele,
       (star <> '*' OR g1 <> f1) AS repaired, star = '' AS star_missing FROM tokens"""
)
def glyph_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged tokens read back to the alleles that they were made from."""
    read = glyphs.with_alleles(_tokens(spark, sf_dir), "token").select("id", F.get("alleles", F.lit(0)).alias("a"))
    return read.select("id", F.col("a.text").alias("allele"), "a.repaired", "a.star_missing")


@query(
    """WITH p AS (SELECT p_partkey AS id, lpad((p_partkey % 80 + 1)::VARCHAR, 2, '0') AS x, lpad((p_partkey * 7 % 80 + 1)::VARCHAR, 2, '0') AS y, p_partkey % 7 AS shape FROM part)
SELECT id, CASE WHEN shape IN (0, 1, 2) THEN 'B*' || x || ' B*' || y WHEN shape = 3 THEN 'A*' || x || ' A*' || y ELSE '' END AS alleles FROM p"""
)
def glyph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in one token: with one star or two, with epitopes behind B; epitopes behind another gene, three of them, or a dot with one star are refused."""
    k = F.col("p_partkey")
    x, y = (F.lpad((k * n % 80 + 1).cast("string"), 2, "0") for n in (1, 7))
    token = (
        F.when(k % 7 == 0, F.concat(F.lit("B*"), x, F.lit(","), y))
        .when(k % 7 == 1, F.concat(F.lit("B*"), x, F.lit(",*"), y))
        .when(k % 7 == 2, F.concat(F.lit("B*"), x, F.lit(",*"), y, F.lit(",Bw4, bw 6")))
        .when(k % 7 == 3, F.concat(F.lit("HLA-A*"), x, F.lit(" ; *"), y))
        .when(k % 7 == 4, F.concat(F.lit("A*"), x, F.lit(",*"), y, F.lit(",Bw4")))
        .when(k % 7 == 5, F.concat(F.lit("B*"), x, F.lit(",*"), y, F.lit(",Bw4,Bw6,Bw4")))
        .otherwise(F.concat(F.lit("A*"), x, F.lit("."), y))
    )
    rows = table(spark, sf_dir, "part").select(k.alias("id"), token.alias("token"))
    return glyphs.with_alleles(rows, "token").select("id", F.array_join(F.transform("alleles", lambda a: a["text"]), " ").alias("alleles"))


_LABELS = [("HLA-A:", "A", 1), ("A", None, 1), ("DRB1", "DRB1", 1), ("DRBl*", None, 0), ("HLA DRBl*", "DRB1", 1), ("D0B1", "DQB1", 1), ("DPB2", None, 1), ("HLA-DRB3/4/5", None, 1), ("DRX 3,4,5", None, 1), ("A*02", None, 0), ("Cw", None, 1), ("HLA-Cw.", "Cw", 1), ("name", None, 0), ("", None, 0)]
_LABEL_ROWS = ", ".join(f"({i}, {'NULL' if name is None else repr(name)}, {bool(shaped)})" for i, (_, name, shaped) in enumerate(_LABELS))


@query(f"SELECT p_partkey AS id, l.label, l.label_shaped FROM part JOIN (VALUES {_LABEL_ROWS}) l(i, label, label_shaped) ON l.i = p_partkey % {len(_LABELS)}")
def glyph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which locus a token names as a label, and whether it is only shaped like one."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick(F.col("p_partkey") % len(_LABELS), [x for x, _, _ in _LABELS]).alias("token"))
    return glyphs.with_alleles(rows, "token").select("id", "label", "label_shaped")


_FAMILIES = {"A": ["01", "02", "03", "11"], "B": ["07", "08", "35"], "DRB1": ["01", "03", "15"]}
_FAMILY_ROWS = ", ".join(f"('{k}', '{x}')" for k, v in _FAMILIES.items() for x in v)


@query(
    f"""WITH v(locus, family) AS (VALUES {_FAMILY_ROWS}), {_PARTS_SQL}
SELECT id, locus || '*' || f1 AS allele, locus IN (SELECT locus FROM v) AS covered, EXISTS (SELECT 1 FROM v WHERE v.locus = tokens.locus AND v.family = tokens.f1) AS admissible FROM tokens"""
)
def vocabulary_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a locus is covered by the vocabulary and has the family that was read."""
    families = strict.Vocabulary("synthetic", _FAMILIES).column()
    a = F.get("alleles", F.lit(0))
    read = glyphs.with_alleles(_tokens(spark, sf_dir), "token").select("id", a["locus"].alias("locus"), a["first"].alias("first"))
    return read.select("id", F.concat_ws("*", "locus", "first").alias("allele"), F.map_contains_key(families, F.col("locus")).alias("covered"), glyphs.admissible(F.col("locus"), F.col("first"), families).alias("admissible"))


@query(f"WITH {_PARTS_SQL} SELECT locus, array_to_string(list_sort(list_distinct(list(f1))), ',') AS families FROM tokens GROUP BY locus")
def vocabulary_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of each locus, from a table of allele names."""
    names = glyphs.with_alleles(_tokens(spark, sf_dir), "token").select(F.get("alleles", F.lit(0))["text"].alias("allele"))
    return strict.families_of(names).select("locus", F.array_join("families", ",").alias("families"))
