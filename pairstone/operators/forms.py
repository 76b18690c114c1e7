"""Printed forms as boxes and rulings: level frames, slopes, cells, anchors, and what a locus's row says.

All rules compare boxes of one page; pages are bounded by the paper, so a page's boxes may stand in one array. Coordinates
are numbers in any unit with y downwards; angles are in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares and factors of the rules.
ROW_OVERLAP, TALL, LEAST_OTHERS, PADDING = 0.35, 1.5, 3, 0.25
CLUSTER_DEGREES, CLUSTER_SHARE, LEAST_RULINGS, LEAST_SLOPE, MOST_DEGREES = 3.0, 0.6, 4, 0.008, 15.0
MOST_VALUES, COLUMN_SLACK = 2, 40


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def same_row(a: Column, b: Column, share: float = ROW_OVERLAP) -> Column:
    """Whether two boxes overlap vertically by a share of the lower one."""
    both = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return both >= share * F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])


def same_column(a: Column, b: Column, share: float = ROW_OVERLAP) -> Column:
    both = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    return both >= share * F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])


def rotated(x: Column, y: Column, degrees: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point turned about the page's centre."""
    angle = F.radians(degrees)
    dx, dy = x - width / 2, y - height / 2
    return width / 2 + dx * F.cos(angle) - dy * F.sin(angle), height / 2 + dx * F.sin(angle) + dy * F.cos(angle)


def slopes(rulings: DataFrame) -> DataFrame:
    """page, angle, row_slope, column_slope from rulings(page, angle, width, height): the median of the largest cluster of angles, if it is large enough.

    Rows fall by tan(angle) times the aspect, columns lean by as much against the other; slopes too small to matter are 0.
    """
    per = rulings.where(F.abs("angle") <= MOST_DEGREES).groupBy("page").agg(F.array_sort(F.collect_list("angle")).alias("angles"), F.max("width").alias("width"), F.max("height").alias("height"))
    near = lambda x: F.filter("angles", lambda y: F.abs(y - x) <= CLUSTER_DEGREES)
    best = F.array_max(F.transform("angles", lambda x: F.struct(F.size(near(x)).alias("n"), (-x).alias("first"))))
    found = per.where(F.size("angles") >= LEAST_RULINGS).withColumn("best", best).where(F.col("best.n") >= CLUSTER_SHARE * F.size("angles"))
    angle = upper_median(near(-F.col("best.first")))
    tangent = F.tan(F.radians(F.col("angle")))
    floor = lambda x: F.when(F.abs(x) >= LEAST_SLOPE, x).otherwise(0.0)
    return found.withColumn("angle", angle).select("page", "angle", floor(tangent * F.col("width") / F.col("height")).alias("row_slope"), floor(-tangent * F.col("height") / F.col("width")).alias("column_slope"))


def ruling_at(ruling: Column, x: Column, slack: float = 0.02) -> Column:
    """The height of a ruling(x0, y0, x1, y1) at x, null beyond its span and some slack."""
    span = ruling["x1"] - ruling["x0"]
    within = (x >= ruling["x0"] - slack * span) & (x <= ruling["x1"] + slack * span)
    return F.when(within, ruling["y0"] + (ruling["y1"] - ruling["y0"]) * (x - ruling["x0"]) / span)


def row_bands(boxes: DataFrame, rulings: DataFrame) -> DataFrame:
    """page, box, top, bottom: the rulings next above and below each box's centre; null where there is none."""
    lines = rulings.groupBy("page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("lines"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    heights = F.array_compact(F.transform("lines", lambda r: ruling_at(r, x)))
    joined = boxes.join(lines, "page", "left").withColumn("heights", heights)
    return joined.select("page", "box", F.array_max(F.filter("heights", lambda h: h <= y)).alias("top"), F.array_min(F.filter("heights", lambda h: h > y)).alias("bottom"))


def reading_direction(labels: DataFrame) -> DataFrame:
    """page, rows, columns, direction: labels that stand side by side mean values below them, labels above each other mean values beside them."""
    per = labels.groupBy("page").agg(F.collect_list(F.struct("box", "x0", "y0", "x1", "y1")).alias("all"))
    one = per.select("page", "all", F.explode("all").alias("a"))
    later = F.filter("all", lambda b: b["box"] > F.col("a.box"))
    counts = one.select("page", F.size(F.filter(later, lambda b: same_row(F.col("a"), b))).alias("r"), F.size(F.filter(later, lambda b: same_column(F.col("a"), b))).alias("c"))
    total = counts.groupBy("page").agg(F.sum("r").alias("rows"), F.sum("c").alias("columns"))
    return total.select("page", "rows", "columns", F.when(F.col("rows") > F.col("columns"), "VALUES_BELOW").when(F.col("columns") > F.col("rows"), "VALUES_BESIDE").otherwise("UNDECIDED").alias("direction"))


def tall(labels: DataFrame) -> DataFrame:
    """page, box, tall: whether a label is much taller than the page's others, of which there must be enough."""
    height = F.col("y1") - F.col("y0")
    per = labels.groupBy("page").agg(F.collect_list(F.struct("box", height.alias("h"))).alias("all"))
    one = per.select("page", "all", F.explode("all").alias("a"))
    others = F.transform(F.filter("all", lambda b: b["box"] != F.col("a.box")), lambda b: b["h"])
    return one.select("page", F.col("a.box").alias("box"), ((F.size(others) >= LEAST_OTHERS) & (F.col("a.h") > TALL * upper_median(others))).alias("tall"))


def spread(boxes: DataFrame) -> DataFrame:
    """page, middle, mad: the upper median of box heights and of the distances from it."""
    per = boxes.groupBy("page").agg(F.collect_list(F.col("y1") - F.col("y0")).alias("h")).withColumn("middle", upper_median(F.col("h")))
    return per.select("page", "middle", upper_median(F.transform("h", lambda x: F.abs(x - F.col("middle")))).alias("mad"))


def odd_rectangles(boxes: DataFrame) -> DataFrame:
    """page, box, wide, high: boxes of twice the page's middle width or height."""
    per = boxes.groupBy("page").agg(upper_median(F.collect_list(F.col("x1") - F.col("x0"))).alias("w"), upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"))
    return boxes.join(per, "page").select("page", "box", (F.col("x1") - F.col("x0") > 2 * F.col("w")).alias("wide"), (F.col("y1") - F.col("y0") > 2 * F.col("h")).alias("high"))


def crop(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """page, box, left, top, right, bottom: a box padded by a share of its height, within the page, in whole pixels."""
    pad = PADDING * (F.col("y1") - F.col("y0"))
    clamp = lambda x, most: F.greatest(F.lit(0), F.least(F.lit(most), x)).cast("int")
    return boxes.select("page", "box", clamp(F.floor(F.col("x0") - pad), width).alias("left"), clamp(F.floor(F.col("y0") - pad), height).alias("top"), clamp(F.ceil(F.col("x1") + pad), width).alias("right"), clamp(F.ceil(F.col("y1") + pad), height).alias("bottom"))


def lifted(pairs: DataFrame) -> DataFrame:
    """pairs(label, value boxes, row_slope) with the offset across the reading axis after the row's fall is taken off, and the gap along it."""
    middle = lambda b: (b["y0"] + b["y1"]) / 2
    a, b = F.col("a"), F.col("b")
    along = b["x0"] - a["x1"]
    return pairs.select("page", a["box"].alias("label"), b["box"].alias("value"), F.round(middle(b) - middle(a) - F.col("row_slope") * ((b["x0"] + b["x1"]) / 2 - (a["x0"] + a["x1"]) / 2), 6).alias("offset"), along.alias("gap"))


def words_share_a_row(boxes: DataFrame, one: Column, two: Column) -> DataFrame:
    """page, found: whether a box with a word of one kind stands in a row with a box of the other kind (or is both)."""
    per = boxes.select("page", F.struct("box", "x0", "y0", "x1", "y1").alias("b"), one.alias("one"), two.alias("two")).groupBy("page")
    lists = per.agg(F.collect_list(F.when(F.col("one"), F.col("b"))).alias("ones"), F.collect_list(F.when(F.col("two"), F.col("b"))).alias("twos"))
    return lists.select("page", F.exists("ones", lambda a: F.exists("twos", lambda b: (a["box"] == b["box"]) | same_row(a, b))).alias("found"))


def anchors(boxes: DataFrame, bare: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """page, locus, box and its edges: boxes whose label names a locus; a bare letter counts only in the column of at least two that do.

    boxes: page, box, x0, y0, x1, y1, label (the locus that the text names reliably), text.
    """
    sure = boxes.where("label IS NOT NULL").withColumn("locus", F.col("label"))
    columns = sure.groupBy("page").agg(F.collect_list("x0").alias("edges"))
    loose = boxes.where(F.col("label").isNull() & F.trim("text").isin(*bare)).join(columns, "page")
    aligned = F.size(F.filter("edges", lambda e: F.abs(e - F.col("x0")) <= COLUMN_SLACK)) >= 2
    found = loose.where(aligned).withColumn("locus", F.trim("text"))
    names = ["page", "locus", "box", "x0", "y0", "x1", "y1"]
    return sure.select(*names).unionByName(found.select(*names))


def resolved(found: DataFrame, values: DataFrame, families: Column) -> DataFrame:
    """page, locus, status, reason, value: what each locus's row says, by gates in a stated order; the first that fails gives the reason.

    found: anchors(); values: page, box, edges, label_shaped, alleles (of the token grammar). A value belongs to the nearest anchor on its left in its row.
    """
    edges = ["box", "x0", "y0", "x1", "y1"]
    a = found.groupBy("page").agg(F.collect_list(F.struct("locus", *edges)).alias("anchors"))
    v = values.join(a, "page").withColumn("v", F.struct(*edges))
    left = F.filter("anchors", lambda x: (x["x1"] <= F.col("x0")) & same_row(x, F.col("v")))
    nearest = F.array_max(F.transform(left, lambda x: F.struct(x["x1"].alias("x1"), (-x["box"]).alias("first"), x["locus"].alias("locus"), x["box"].alias("box"))))
    bound = v.withColumn("owner", nearest).where("owner IS NOT NULL").select("page", F.col("owner.box").alias("anchor"), "x0", "box", "label_shaped", "alleles")
    cells = bound.groupBy("page", "anchor").agg(F.array_sort(F.collect_list(F.struct("x0", "box", "label_shaped", "alleles"))).alias("cells"))
    rows = found.groupBy("page", "locus").agg(F.count("*").alias("n"), F.min("box").alias("anchor")).join(cells, ["page", "anchor"], "left")
    cell = F.coalesce("cells", F.array())
    read = F.flatten(F.transform(cell, lambda c: c["alleles"]))
    reason = (
        F.when(F.col("n") > 1, "several anchors")
        .when(F.size(cell) == 0, "no box beside the anchor")
        .when(F.size(cell) > MOST_VALUES, "too many boxes")
        .when(F.exists(cell, lambda c: c["label_shaped"]), "a label, not a value")
        .when(F.exists(cell, lambda c: F.size(c["alleles"]) == 0), "does not parse")
        .when(F.exists(read, lambda x: x["locus"].isNotNull() & (x["locus"] != F.col("locus"))), "foreign prefix")
        .when(F.exists(read, lambda x: ~F.coalesce(F.array_contains(families[F.col("locus")], x["first"]), F.lit(False))), "no family of the locus")
        .when(F.size(read) > MOST_VALUES, "too many alleles")
    )
    status = F.when(reason.isNull(), "RESOLVED").when(reason == "no box beside the anchor", "UNKNOWN").otherwise("REVIEW_REQUIRED")
    value = F.when(reason.isNull(), F.array_join(F.transform(read, lambda x: F.concat(F.col("locus"), F.lit("*"), x["first"])), " "))
    return rows.select("page", "locus", status.alias("status"), reason.alias("reason"), value.alias("value"))


def gene_slots(tokens: Column) -> Column:
    """PRESENT, ABSENT or UNKNOWN for three genes from the digits read in their common row: two different ones settle the third, one leaves the others open."""
    genes = ("3", "4", "5")
    read = F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(F.translate(t, "Ss", "55"), F.lit("(?<![0-9])([345])(?![0-9])"), F.lit(1)))))
    state = lambda g: F.when(F.size(read) > 2, "REVIEW_REQUIRED").when(F.array_contains(read, g), "PRESENT").when(F.size(read) == 2, "ABSENT").otherwise("UNKNOWN")
    return F.struct(*[state(g).alias(f"DRB{g}") for g in genes])


def printed_group(token: Column) -> Column:
    """struct(abo, rh) of a printed blood group, the sign before or behind; a zero is the letter O. Null where the token is anything else."""
    text = F.upper(F.regexp_replace(F.trim(token), r"\s+", ""))
    letter = F.coalesce(F.nullif(F.regexp_extract(text, r"^(AB|A|B|O|0)[+-]$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^[+-](AB|A|B|O|0)$", 1), F.lit("")))
    return F.when(letter.isNotNull(), F.struct(F.translate(letter, "0", "O").alias("abo"), F.when(F.contains(text, F.lit("+")), "POSITIVE").otherwise("NEGATIVE").alias("rh")))


def printed_groups(boxes: DataFrame) -> DataFrame:
    """page, status, abo, rh, source: the group beside a blood-group label; two that differ go to review, a disclaimer makes it the patient's word."""
    label = F.lower("text").rlike("^blood group")
    lists = boxes.select("page", F.struct("box", "x0", "y0", "x1", "y1").alias("b"), label.alias("is_group"), printed_group(F.col("text")).alias("g"), F.lower("text").rlike("not measured").alias("disclaimed"))
    per = lists.groupBy("page").agg(F.collect_list(F.when(F.col("is_group"), F.col("b"))).alias("labels"), F.collect_list(F.when(F.col("g").isNotNull(), F.struct("b", "g"))).alias("values"), F.bool_or("disclaimed").alias("disclaimed"))
    beside = F.filter("values", lambda v: F.exists("labels", lambda a: (a["x1"] <= v["b"]["x0"]) & same_row(a, v["b"])))
    read = F.array_distinct(F.transform(beside, lambda v: v["g"]))
    one = F.when(F.size(read) == 1, F.get(read, F.lit(0)))
    status = F.when((F.size("labels") == 0) | (F.size(read) == 0), "UNKNOWN").when(F.size(read) > 1, "REVIEW_REQUIRED").otherwise("RESOLVED")
    source = F.when(F.size(read) == 1, F.when(F.col("disclaimed"), "PATIENT_REPORTED_ON_FORM").otherwise("LABORATORY_PRINTED"))
    return per.select("page", status.alias("status"), one["abo"].alias("abo"), one["rh"].alias("rh"), source.alias("source"))
