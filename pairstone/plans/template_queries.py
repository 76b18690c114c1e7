"""Forms that pages were printed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.operators import templates
from pairstone.plans.registry import query
from pairstone.sources.people import table

#: Three forms with the places of five labels.
FORMS = [(form, field, 40 * field + 30 * form, 25 * field * (form + 1) % 170 + 10 * form) for form in range(3) for field in range(5)]
LABELS = f"""
labels AS (
    SELECT o_orderkey // 5 AS page, o_orderkey % 5 AS field, 2 * p.px + o_orderkey // 5 % 7 + o_custkey % 9 AS x, 2 * p.py + o_orderkey // 5 % 11 + o_custkey % 13 * (o_orderkey // 5 % 4) AS y
    FROM orders JOIN (VALUES {", ".join(map(str, FORMS))}) AS p(form, field, px, py) ON p.form = o_orderkey // 5 % 3 AND p.field = o_orderkey % 5
),
met AS (SELECT page, form AS family, x, y, px, py FROM labels JOIN (VALUES {", ".join(map(str, FORMS))}) AS p(form, field, px, py) ON p.field = labels.field),
sums AS (SELECT page, family, count(*) AS n, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y, sum(px)::DOUBLE AS px, sum(py)::DOUBLE AS py, sum(px * px + py * py)::DOUBLE AS pp, sum(x * px + y * py)::DOUBLE AS xp, sum(x * x + y * y)::DOUBLE AS xx
         FROM met GROUP BY page, family HAVING count(*) >= 3),
parts AS (SELECT *, pp - (px * px + py * py) / n AS spread, xp - (x * px + y * py) / n AS along, xx - (x * x + y * y) / n AS total FROM sums),
fits AS (SELECT page, family, n, along / spread AS scale, sqrt(greatest(0.0, total - along * along / spread) / n) AS residual FROM parts WHERE spread > 0 AND along / spread > 0)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = spark.createDataFrame(FORMS, "form long, field long, px long, py long")
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 5).alias("page"), (k % 5).alias("field"), c.alias("c")).withColumn("form", F.col("page") % 3)
    placed = rows.join(F.broadcast(forms), ["form", "field"])
    return placed.select("page", "field", (2 * F.col("px") + F.col("page") % 7 + F.col("c") % 9).alias("x"), (2 * F.col("py") + F.col("page") % 11 + F.col("c") % 13 * (F.col("page") % 4)).alias("y"))


def prototypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMS, "family long, field long, px long, py long")


@query(f"WITH {LABELS} SELECT page, family, n, round(scale, 6) AS scale, round(residual, 4) AS residual FROM fits")
def template_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.fits(labels(spark, sf_dir), prototypes(spark))
    return found.select("page", "family", "n", F.round("scale", 6).alias("scale"), F.round("residual", 4).alias("residual"))


@query(
    f"""WITH {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY residual, family) AS nth, lead(residual) OVER (PARTITION BY page ORDER BY residual, family) AS second FROM fits)
SELECT page, family, round(residual, 4) AS residual, round(second, 4) AS runner_up FROM r WHERE nth = 1 AND residual <= 80 AND (second IS NULL OR second >= 1.5 * residual)"""
)
def template_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.assigned(templates.fits(labels(spark, sf_dir), prototypes(spark)))
