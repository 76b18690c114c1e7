"""Queries over printed forms: boxes, words and rulings are derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.functions import glyphs
from pairstone.operators import forms
from pairstone.plans.box_queries import BOXES, boxes
from pairstone.plans.registry import query
from pairstone.sources import strict
from pairstone.sources.people import _pick, table

WORDS = ["DRB1", "HLA-A", "A", "DRB1*15", "A*02", "A*99", "B*07", "donor", "recipient", "blood group", "O+", "-AB", "not measured", "zz", "DQB1", "03"]
_WORDS = f"""{BOXES}, words AS (SELECT *, ({WORDS})[(box * 7 + x0 + y1) % {len(WORDS)} + 1] AS text FROM boxes)"""
_ROW = "least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.35 * least(a.y1 - a.y0, b.y1 - b.y0)"
_COLUMN = "least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.35 * least(a.x1 - a.x0, b.x1 - b.x0)"
_FAMILIES = {"A": ["02", "03"], "DRB1": ["15", "03"], "DQB1": ["03"]}
_MIDDLE = "list_sort(list({0}))[len(list({0})) // 2 + 1]"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).withColumn("text", _pick((F.col("box") * 7 + F.col("x0") + F.col("y1")) % len(WORDS), WORDS))


_ANGLES = """WITH rulings AS (SELECT l_orderkey // 4 AS page, CASE WHEN l_partkey % 5 = 0 THEN (l_suppkey % 29 - 14)::DOUBLE ELSE (l_orderkey // 4 % 9 - 4) + (l_partkey % 11) / 8.0 END AS angle FROM lineitem)"""


@query(
    f"""{_ANGLES}, l AS (SELECT page, list_sort(list(angle)) AS angles FROM rulings WHERE abs(angle) <= 15 GROUP BY page HAVING count(*) >= 4),
n AS (SELECT page, angles, unnest(angles) AS x FROM l), c AS (SELECT page, angles, x, list_filter(angles, lambda y: abs(y - x) <= 3) AS near FROM n),
b AS (SELECT page, len(angles) AS n, arg_max(near, (len(near), -x)) AS near FROM c GROUP BY page, angles), a AS (SELECT page, near[len(near) // 2 + 1] AS angle FROM b WHERE len(near) >= 0.6 * n),
t AS (SELECT page, angle, tan(radians(angle)) * 1000 / 1400 AS r, -tan(radians(angle)) * 1400 / 1000 AS k FROM a)
SELECT page, angle, round(CASE WHEN abs(r) >= 0.008 THEN r ELSE 0 END, 9) AS row_slope, round(CASE WHEN abs(k) >= 0.008 THEN k ELSE 0 END, 9) AS column_slope FROM t"""
)
def page_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part, supp = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    page = F.floor(order / 4)
    angle = F.when(part % 5 == 0, (supp % 29 - 14).cast("double")).otherwise((page % 9 - 4) + (part % 11) / 8.0)
    rulings = table(spark, sf_dir, "lineitem").select(page.alias("page"), angle.alias("angle"), F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    return forms.slopes(rulings).select("page", "angle", F.round("row_slope", 9).alias("row_slope"), F.round("column_slope", 9).alias("column_slope"))


_TURN = "(page % 11 - 5)"


@query(
    f"""{BOXES}, m AS (SELECT page, box, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y, radians({_TURN}) AS t FROM boxes)
SELECT page, box, round(400 + (x - 400) * cos(t) - (y - 200) * sin(t), 6) AS level_x, round(200 + (x - 400) * sin(t) + (y - 200) * cos(t), 6) AS level_y, true AS restored FROM m"""
)
def level_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box centres on the levelled page, and whether turning them back gives the stored ones."""
    x, y = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    width, height, turn = F.lit(800.0), F.lit(400.0), (F.col("page") % 11 - 5).cast("double")
    there = forms.rotated(x, y, turn, width, height)
    back = forms.rotated(*there, -turn, width, height)
    return boxes(spark, sf_dir).select("page", "box", F.round(there[0], 6).alias("level_x"), F.round(there[1], 6).alias("level_y"), ((F.abs(back[0] - x) < 1e-6) & (F.abs(back[1] - y) < 1e-6)).alias("restored"))


_LINES = f"{BOXES}, rulings AS (SELECT page, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 400)::DOUBLE AS x1, (y0 + page % 7)::DOUBLE AS y1 FROM boxes WHERE is_label)"


@query(
    f"""{_LINES}, h AS (SELECT b.page, b.box, (b.y0 + b.y1) / 2.0 AS y, r.y0 + (r.y1 - r.y0) * ((b.x0 + b.x1) / 2.0 - r.x0) / (r.x1 - r.x0) AS level
    FROM boxes b LEFT JOIN rulings r ON r.page = b.page AND (b.x0 + b.x1) / 2.0 BETWEEN r.x0 - 0.02 * (r.x1 - r.x0) AND r.x1 + 0.02 * (r.x1 - r.x0))
SELECT page, box, round(max(level) FILTER (level <= y), 6) AS top, round(min(level) FILTER (level > y), 6) AS bottom FROM h GROUP BY page, box"""
)
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    x0, y0 = F.col("x0"), F.col("y0")
    rulings = rows.where("is_label").select("page", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 400).cast("double").alias("x1"), (y0 + F.col("page") % 7).cast("double").alias("y1"))
    return forms.row_bands(rows, rulings).select("page", "box", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query(
    f"""{BOXES}, p AS (SELECT a.page, count(*) FILTER (b.box IS NOT NULL AND {_ROW}) AS rows, count(*) FILTER (b.box IS NOT NULL AND {_COLUMN}) AS columns
    FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND b.is_label AND b.box > a.box WHERE a.is_label GROUP BY a.page)
SELECT *, CASE WHEN rows > columns THEN 'VALUES_BELOW' WHEN columns > rows THEN 'VALUES_BESIDE' ELSE 'UNDECIDED' END AS direction FROM p"""
)
def reading_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.reading_direction(boxes(spark, sf_dir).where("is_label"))


@query(
    f"""{BOXES}, o AS (SELECT a.page, a.box, a.y1 - a.y0 AS h, list_sort(list(b.y1 - b.y0) FILTER (b.box IS NOT NULL)) AS others FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND b.is_label AND b.box <> a.box WHERE a.is_label GROUP BY ALL)
SELECT page, box, coalesce(len(others) >= 3 AND h > 1.5 * others[len(others) // 2 + 1], false) AS tall FROM o"""
)
def tall_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.tall(boxes(spark, sf_dir).where("is_label"))


@query(f"{BOXES}, m AS (SELECT page, {_MIDDLE.format('y1 - y0')} AS middle FROM boxes GROUP BY page) SELECT page, any_value(middle) AS middle, {_MIDDLE.format('abs(y1 - y0 - middle)')} AS mad FROM boxes JOIN m USING (page) GROUP BY page")
def height_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.spread(boxes(spark, sf_dir))


@query(f"{BOXES}, m AS (SELECT page, {_MIDDLE.format('x1 - x0')} AS w, {_MIDDLE.format('y1 - y0')} AS h FROM boxes GROUP BY page) SELECT page, box, x1 - x0 > 2 * w AS wide, y1 - y0 > 2 * h AS high FROM boxes JOIN m USING (page)")
def rectangle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.odd_rectangles(boxes(spark, sf_dir))


@query(
    f"""{BOXES} SELECT page, box, greatest(0, least(640, floor(x0 - 0.25 * (y1 - y0))))::INT AS left, greatest(0, least(320, floor(y0 - 0.25 * (y1 - y0))))::INT AS top,
       greatest(0, least(640, ceil(x1 + 0.25 * (y1 - y0))))::INT AS right, greatest(0, least(320, ceil(y1 + 0.25 * (y1 - y0))))::INT AS bottom FROM boxes"""
)
def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.crop(boxes(spark, sf_dir), 640, 320)


@query(
    f"""{BOXES} SELECT a.page, a.box AS label, b.box AS value, round((b.y0 + b.y1) / 2.0 - (a.y0 + a.y1) / 2.0 - (a.page % 5 - 2) / 50.0 * ((b.x0 + b.x1) / 2.0 - (a.x0 + a.x1) / 2.0), 6) AS "offset", b.x0 - a.x1 AS gap
FROM boxes a JOIN boxes b ON a.page = b.page AND a.is_label AND NOT b.is_label AND b.x0 >= a.x1"""
)
def lifted_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a value stands off its label's row once the row's fall is taken off."""
    rows = boxes(spark, sf_dir).select("page", "is_label", F.struct("box", "x0", "y0", "x1", "y1").alias("b"))
    pairs = rows.where("is_label").select("page", F.col("b").alias("a")).join(rows.where("NOT is_label").select("page", "b"), "page").where("b.x0 >= a.x1")
    return forms.lifted(pairs.withColumn("row_slope", (F.col("page") % 5 - 2) / 50.0))


@query(f"{_WORDS}, d AS (SELECT * FROM words WHERE text = 'donor'), r AS (SELECT * FROM words WHERE text = 'recipient') SELECT page, EXISTS (SELECT 1 FROM d a JOIN r b ON a.page = b.page AND a.page = p.page AND {_ROW}) AS found FROM (SELECT DISTINCT page FROM words) p")
def comparison_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that print both roles in one row."""
    return forms.words_share_a_row(words(spark, sf_dir), F.col("text") == "donor", F.col("text") == "recipient")


@query(f"{_WORDS}, d AS (SELECT * FROM words WHERE text = 'not measured'), r AS (SELECT * FROM words WHERE text = 'blood group') SELECT page, EXISTS (SELECT 1 FROM d a JOIN r b ON a.page = b.page AND a.page = p.page AND {_ROW}) AS found FROM (SELECT DISTINCT page FROM words) p")
def printed_disclaimers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose blood-group field is disclaimed: both words in a box, or in two boxes of a printed line."""
    return forms.words_share_a_row(words(spark, sf_dir), F.col("text").rlike("not measured"), F.col("text").rlike("blood group"))


@query(
    f"""{_WORDS}, v AS (SELECT *, CASE text WHEN 'O+' THEN 'O' ELSE 'AB' END AS abo, CASE text WHEN 'O+' THEN 'POSITIVE' ELSE 'NEGATIVE' END AS rh FROM words WHERE text IN ('O+', '-AB')),
s AS (SELECT DISTINCT b.page, b.abo, b.rh FROM words a JOIN v b ON a.page = b.page AND a.text = 'blood group' AND a.x1 <= b.x0 AND {_ROW}),
g AS (SELECT page, count(*) AS n, min(abo) AS abo, min(rh) AS rh FROM s GROUP BY page), d AS (SELECT page, bool_or(text = 'not measured') AS disclaimed FROM words GROUP BY page)
SELECT page, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n > 1 THEN 'REVIEW_REQUIRED' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN abo END AS abo, CASE WHEN n = 1 THEN rh END AS rh,
       CASE WHEN n = 1 THEN CASE WHEN disclaimed THEN 'PATIENT_REPORTED_ON_FORM' ELSE 'LABORATORY_PRINTED' END END AS source FROM d LEFT JOIN g USING (page)"""
)
def printed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.printed_groups(words(spark, sf_dir))


_ANCHORS = f"""{_WORDS}, sure AS (SELECT *, CASE text WHEN 'HLA-A' THEN 'A' ELSE text END AS locus FROM words WHERE text IN ('DRB1', 'DQB1', 'HLA-A')),
anchors AS (SELECT page, locus, box, x0, y0, x1, y1 FROM sure UNION ALL
    SELECT w.page, 'A', w.box, w.x0, w.y0, w.x1, w.y1 FROM words w WHERE w.text = 'A' AND (SELECT count(*) FROM sure s WHERE s.page = w.page AND abs(s.x0 - w.x0) <= 40) >= 2)"""


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.with_alleles(words(spark, sf_dir), "text")


@query(f"{_ANCHORS} SELECT page, locus, box FROM anchors")
def anchor_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.anchors(_read(spark, sf_dir)).select("page", "locus", "box")


_KNOWN = ", ".join(f"('{k}', '{x}')" for k, v in _FAMILIES.items() for x in v)
_NAMED = "CASE WHEN text = 'HLA-A' OR text = 'A' THEN 'A' END"


@query(
    f"""{_ANCHORS}, known(locus, family) AS (VALUES {_KNOWN}), cells AS (SELECT * FROM words WHERE text NOT IN ('donor', 'recipient', 'blood group', 'not measured', 'O+', '-AB') AND box NOT IN (SELECT a.box FROM anchors a WHERE a.page = words.page)),
owned AS (SELECT b.page, b.box, b.x0, b.text, arg_max(a.box, (a.x1, -a.box)) AS anchor FROM cells b JOIN anchors a ON a.page = b.page AND a.x1 <= b.x0 AND {_ROW} GROUP BY ALL),
parts AS (SELECT *, text IN ('A', 'DRB1', 'DQB1', 'HLA-A') AS shaped, CASE WHEN contains(text, '*') THEN split_part(text, '*', 1) END AS prefix, CASE WHEN contains(text, '*') THEN split_part(text, '*', 2) WHEN text = '03' THEN '03' END AS family FROM owned),
loci AS (SELECT page, locus, count(*) AS n, min(box) AS anchor FROM anchors GROUP BY page, locus),
rows AS (SELECT l.page, l.locus, any_value(l.n) AS n, count(p.box) AS cells, coalesce(bool_or(p.shaped), false) AS shaped, coalesce(bool_or(p.family IS NULL), false) AS unread, coalesce(bool_or(p.prefix <> l.locus), false) AS alien,
    coalesce(bool_or(NOT EXISTS (SELECT 1 FROM known k WHERE k.locus = l.locus AND k.family = p.family)), false) AS no_family, string_agg(l.locus || '*' || p.family, ' ' ORDER BY p.x0, p.box) AS value
    FROM loci l LEFT JOIN parts p ON p.page = l.page AND p.anchor = l.anchor GROUP BY l.page, l.locus),
told AS (SELECT *, CASE WHEN n > 1 THEN 'several anchors' WHEN cells = 0 THEN 'no box beside the anchor' WHEN cells > 2 THEN 'too many boxes' WHEN shaped THEN 'a label, not a value' WHEN unread THEN 'does not parse' WHEN alien THEN 'foreign prefix' WHEN no_family THEN 'no family of the locus' END AS reason FROM rows)
SELECT page, locus, CASE WHEN reason IS NULL THEN 'RESOLVED' WHEN reason = 'no box beside the anchor' THEN 'UNKNOWN' ELSE 'REVIEW_REQUIRED' END AS status, reason, CASE WHEN reason IS NULL THEN value END AS value FROM told"""
)
def locus_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page says of each locus: anchors, values by the nearest of them, and the gates in their order."""
    read = _read(spark, sf_dir)
    found = forms.anchors(read)
    prose = ["donor", "recipient", "blood group", "not measured", "O+", "-AB"]
    values = read.where(~F.col("text").isin(*prose)).join(found.select("page", "box"), ["page", "box"], "left_anti")
    return forms.resolved(found, values, strict.Vocabulary("synthetic", _FAMILIES).column())


@query(
    """WITH t AS (SELECT p_partkey AS id, p_partkey % 6 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN 'UNKNOWN' WHEN 4 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'ABSENT' WHEN 5 THEN 'UNKNOWN' ELSE 'PRESENT' END AS "DRB3",
       CASE k WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'PRESENT' WHEN 3 THEN 'PRESENT' WHEN 4 THEN 'REVIEW_REQUIRED' ELSE 'UNKNOWN' END AS "DRB4",
       CASE k WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'ABSENT' WHEN 3 THEN 'PRESENT' WHEN 4 THEN 'REVIEW_REQUIRED' ELSE 'PRESENT' END AS "DRB5" FROM t"""
)
def gene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common row of three genes: none, one, two, two with an S for a 5, all three, an S alone."""
    k = F.col("p_partkey") % 6
    made = [[], ["DRB3"], ["DRB3", "4"], ["4", "DRBS"], ["3", "4", "5"], ["S"]]
    tokens = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in made]), (k + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), forms.gene_slots(tokens).alias("g")).select("id", "g.*")


@query("WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'photos/' || p_partkey || '.jpg' END AS href, 'photos/' || p_partkey || '_thumb.jpg' AS thumb FROM part), i AS (SELECT 'photos/' || p_partkey || '.jpg' AS path FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'photos/' || p_partkey || '_thumb.jpg' FROM part WHERE p_partkey % 4 <> 0) SELECT id, CASE WHEN href IN (SELECT path FROM i) THEN href WHEN thumb IN (SELECT path FROM i) THEN thumb END AS path, CASE WHEN href IN (SELECT path FROM i) THEN 'HIGH_RES' WHEN thumb IN (SELECT path FROM i) THEN 'THUMBNAIL' ELSE 'MISSING' END AS quality FROM f")
def best_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best file that is really there for each attachment: by joins with the inventory, not by looking at paths one by one."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    name = lambda tail: F.concat(F.lit("photos/"), k.cast("string"), F.lit(tail))
    wanted = parts.select(k.alias("id"), F.when(k % 3 != 0, name(".jpg")).alias("href"), name("_thumb.jpg").alias("thumb"))
    there = parts.where(k % 5 != 0).select(name(".jpg").alias("path")).unionByName(parts.where(k % 4 != 0).select(name("_thumb.jpg").alias("path")))
    full = wanted.join(there.select(F.col("path").alias("href"), F.lit(True).alias("has_href")), "href", "left")
    both = full.join(there.select(F.col("path").alias("thumb"), F.lit(True).alias("has_thumb")), "thumb", "left")
    return both.select("id", F.when(F.col("has_href"), F.col("href")).when(F.col("has_thumb"), F.col("thumb")).alias("path"), F.when(F.col("has_href"), "HIGH_RES").when(F.col("has_thumb"), "THUMBNAIL").otherwise("MISSING").alias("quality"))
