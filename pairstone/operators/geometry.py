"""Readers of pages as boxes: overlaps, rows, label ownership, exclusivity, guards.

Every join is within one page, and a page holds what one sheet can print, so the joins on the page
key stay small whatever the number of pages. Coordinates are whole units of the page grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_OVERLAP, ODD_HEIGHT, ODD_WIDTH = 0.35, (0.6, 1.6), 2.2


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def _sides(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return boxes.select("page", F.struct("*").alias("a")), boxes.select("page", F.struct("*").alias("b"))


def box_pairs(boxes: DataFrame) -> DataFrame:
    """page, a, b, shared, union for the pairs of a page's boxes that overlap."""
    one, two = _sides(boxes)
    a, b = F.col("a"), F.col("b")
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    shared = overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    return one.join(two, "page").where(a["box"] < b["box"]).select("page", a["box"].alias("a"), b["box"].alias("b"), shared.alias("shared"), (area(a) + area(b) - shared).alias("union")).where("shared > 0")


def _on_row(a: Column, b: Column) -> Column:
    """Whether two boxes share enough of the shorter one's height."""
    shorter = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return overlap(a["y0"], a["y1"], b["y0"], b["y1"]) >= ROW_OVERLAP * shorter


def row_bindings(boxes: DataFrame) -> DataFrame:
    """page, label, value, gap: value boxes on a label's row, right of it."""
    one, two = _sides(boxes)
    a, b = F.col("a"), F.col("b")
    met = one.where(a["is_label"]).join(two.where(~b["is_label"]), "page").where(_on_row(a, b) & (b["x0"] >= a["x1"]))
    return met.select("page", a["box"].alias("label"), b["box"].alias("value"), (b["x0"] - a["x1"]).alias("gap"))


def ownership(bindings: DataFrame) -> DataFrame:
    """page, value, owner: the label with the smallest gap; a tie is a conflict and owns nothing."""
    best = bindings.groupBy("page", "value").agg(F.min(F.struct("gap", "label")).alias("best"), F.count("*").alias("claims"))
    ties = bindings.join(best, ["page", "value"]).where(F.col("gap") == F.col("best.gap")).groupBy("page", "value").agg(F.count("*").alias("nearest"), F.min("best.label").alias("label"), F.max("claims").alias("claims"))
    return ties.select("page", "value", F.when(F.col("nearest") == 1, F.col("label")).alias("owner"), "claims", (F.col("nearest") > 1).alias("conflict"))


def exclusive(bindings: DataFrame) -> DataFrame:
    """Labels with how many of their values no other label claims; a value claimed twice is withdrawn from both."""
    claims = F.count("*").over(W.partitionBy("page", "value"))
    return bindings.withColumn("claims", claims).groupBy("page", "label").agg(F.count("*").alias("bound"), F.count_if(F.col("claims") == 1).alias("kept"))


def odd_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes whose height or width stands out from their page's upper median; a page of fewer than three has none."""
    medians = boxes.groupBy("page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("hs"), F.array_sort(F.collect_list(F.col("x1") - F.col("x0"))).alias("ws")).where("n >= 3")
    mid = (F.col("n") / 2).cast("int")
    joined = boxes.join(medians.select("page", F.get("hs", mid).alias("h"), F.get("ws", mid).alias("w")), "page")
    height, width = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    odd = (height < ODD_HEIGHT[0] * F.col("h")) | (height > ODD_HEIGHT[1] * F.col("h")) | (width > ODD_WIDTH * F.col("w"))
    return joined.where(odd).select("page", "box", height.cast("long").alias("height"), width.cast("long").alias("width"))


def page_shape(boxes: DataFrame) -> DataFrame:
    """page, n, tall, sideways: eight boxes or more, of which three in five are taller than wide."""
    tall = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))
    per = boxes.groupBy("page").agg(F.count("*").alias("n"), F.count_if(tall).alias("tall"))
    return per.select("*", ((F.col("n") >= 8) & (F.col("tall") * 10 >= F.col("n") * 6)).alias("sideways"))


def label_pitch(boxes: DataFrame) -> DataFrame:
    """page, pitch: the upper median of the steps between a page's labels, from top to bottom."""
    step = F.col("y0") - F.lag("y0").over(W.partitionBy("page").orderBy("y0", "box"))
    steps = boxes.where("is_label").withColumn("step", step).where("step IS NOT NULL").groupBy("page").agg(F.array_sort(F.collect_list("step")).alias("s"))
    return steps.select("page", F.get("s", (F.size("s") / 2).cast("int")).cast("long").alias("pitch"))


def gap_chain(bindings: DataFrame, limit: int) -> DataFrame:
    """page, label, reach: how many cells of a row follow each other before a gap above the limit."""
    order = W.partitionBy("page", "label").orderBy("gap", "value")
    jump = (F.col("gap") - F.coalesce(F.lag("gap").over(order), F.lit(0)) > limit).cast("int")
    broken = bindings.withColumn("jump", jump).withColumn("broken", F.sum("jump").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return broken.groupBy("page", "label").agg(F.count("*").alias("cells"), F.count_if(F.col("broken") == 0).alias("reach"))
