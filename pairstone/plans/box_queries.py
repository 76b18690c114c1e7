"""Box geometry over pages derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.operators import geometry as g
from pairstone.plans.registry import query
from pairstone.sources.people import table

BOXES = """WITH boxes AS (
    SELECT l_orderkey // 6 AS page, l_orderkey % 6 * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS box,
           l_partkey * 13 % 600 AS x0, l_partkey * 13 % 600 + 20 + l_suppkey % 90 AS x1, l_suppkey * 17 % 300 AS y0, l_suppkey * 17 % 300 + 12 + l_partkey % 40 AS y1, l_partkey % 3 = 0 AS is_label
    FROM lineitem
)"""
BOUND = f"""{BOXES}, bound AS (
    SELECT a.page, a.box AS label, b.box AS value, b.x0 - a.x1 AS gap FROM boxes a JOIN boxes b ON a.page = b.page AND a.is_label AND NOT b.is_label AND b.x0 >= a.x1
       AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.35 * least(a.y1 - a.y0, b.y1 - b.y0)
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order, part, supp = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    x0, y0 = part * 13 % 600, supp * 17 % 300
    return table(spark, sf_dir, "lineitem").select(F.floor(order / 6).alias("page"), (order % 6 * 1000 + number).alias("box"), x0.alias("x0"), (x0 + 20 + supp % 90).alias("x1"), y0.alias("y0"), (y0 + 12 + part % 40).alias("y1"), (part % 3 == 0).alias("is_label"))


@query(
    f"""{BOXES}, p AS (SELECT a.page, a.box AS a, b.box AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS both_areas FROM boxes a JOIN boxes b ON a.page = b.page AND a.box < b.box)
SELECT page, a, b, shared, both_areas - shared AS "union" FROM p WHERE shared > 0"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.box_pairs(boxes(spark, sf_dir))


@query(f"{BOUND} SELECT * FROM bound")
def row_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.row_bindings(boxes(spark, sf_dir))


@query(
    f"""{BOUND}, m AS (SELECT *, min(gap) OVER (PARTITION BY page, value) AS least, count(*) OVER (PARTITION BY page, value) AS claims FROM bound),
n AS (SELECT page, value, count(*) AS nearest, min(label) AS label, max(claims) AS claims FROM m WHERE gap = least GROUP BY page, value)
SELECT page, value, CASE WHEN nearest = 1 THEN label END AS owner, claims, nearest > 1 AS conflict FROM n"""
)
def label_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.ownership(g.row_bindings(boxes(spark, sf_dir)))


@query(f"{BOUND}, c AS (SELECT *, count(*) OVER (PARTITION BY page, value) AS claims FROM bound) SELECT page, label, count(*) AS bound, count(*) FILTER (claims = 1) AS kept FROM c GROUP BY page, label")
def exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.exclusive(g.row_bindings(boxes(spark, sf_dir)))


@query(
    f"""{BOXES}, m AS (SELECT page, count(*) AS n, list_sort(list(y1 - y0)) AS hs, list_sort(list(x1 - x0)) AS ws FROM boxes GROUP BY page HAVING count(*) >= 3)
SELECT b.page, b.box, b.y1 - b.y0 AS height, b.x1 - b.x0 AS width FROM boxes b JOIN m ON m.page = b.page
WHERE b.y1 - b.y0 < 0.6 * hs[n // 2 + 1] OR b.y1 - b.y0 > 1.6 * hs[n // 2 + 1] OR b.x1 - b.x0 > 2.2 * ws[n // 2 + 1]"""
)
def odd_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.odd_boxes(boxes(spark, sf_dir))


@query(f"{BOXES} SELECT page, count(*) AS n, count(*) FILTER (y1 - y0 > x1 - x0) AS tall, count(*) >= 8 AND count(*) FILTER (y1 - y0 > x1 - x0) * 10 >= count(*) * 6 AS sideways FROM boxes GROUP BY page")
def sideways_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.page_shape(boxes(spark, sf_dir))


@query(
    f"""{BOXES}, s AS (SELECT page, y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, box) AS step FROM boxes WHERE is_label),
l AS (SELECT page, list_sort(list(step)) AS s FROM s WHERE step IS NOT NULL GROUP BY page) SELECT page, s[len(s) // 2 + 1] AS pitch FROM l"""
)
def label_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.label_pitch(boxes(spark, sf_dir))


@query(
    f"""{BOUND}, j AS (SELECT *, (gap - coalesce(lag(gap) OVER w, 0) > 60)::INT AS jump FROM bound WINDOW w AS (PARTITION BY page, label ORDER BY gap, value)),
b AS (SELECT *, sum(jump) OVER (PARTITION BY page, label ORDER BY gap, value ROWS UNBOUNDED PRECEDING) AS broken FROM j)
SELECT page, label, count(*) AS cells, count(*) FILTER (broken = 0) AS reach FROM b GROUP BY page, label"""
)
def gap_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.gap_chain(g.row_bindings(boxes(spark, sf_dir)), 60)
