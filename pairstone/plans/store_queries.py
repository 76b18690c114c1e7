"""Later passes, selections, draws and sinks over the facts store, each with the SQL that knows the same rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairstone.functions import alleles
from pairstone.operators import decode, matching, repasses, scoring, sinks
from pairstone.plans import matching_sql
from pairstone.plans.fact_queries import LABELS
from pairstone.plans.registry import query
from pairstone.shared import new_path, written
from pairstone.sources.facts import FACTS_SQL, facts
from pairstone.sources.messages import MESSAGES_SQL, messages
from pairstone.sources.people import _pick, table

WITH = f"WITH {FACTS_SQL}"
KEY = repasses.KEY


def p() -> Column:
    return F.col("profile")


#: The readings of two engine families for each cell, drawn from the keys.
_ENGINES = """,
readings AS (
    SELECT profile, digest, field, unnest(['north/1@cell', 'south/2@row']) AS engine,
           unnest([CASE WHEN profile % 6 <> 1 THEN field || '*0' || (profile % 3 + 1) END, CASE WHEN profile % 5 <> 2 THEN field || '*0' || (CASE WHEN profile % 4 = 0 THEN profile % 3 + 2 ELSE profile % 3 + 1 END) END]) AS reading FROM facts
),
agreed AS (
    SELECT profile, digest, field, min(reading) AS reading, count(DISTINCT split_part(engine, '/', 1)) AS families FROM readings WHERE reading IS NOT NULL
    GROUP BY ALL HAVING min(reading) = max(reading) AND count(DISTINCT split_part(engine, '/', 1)) >= 2
)"""
_OUT = "profile, digest, field, status, value, second_allele, source, reason"
_COLUMNS = _OUT.split(", ")


def _number(n: Column) -> Column:
    return F.concat("field", F.lit("*0"), n.cast("string"))


def _readings(rows: DataFrame) -> DataFrame:
    north = F.when(p() % 6 != 1, _number(p() % 3 + 1))
    south = F.when(p() % 5 != 2, _number(F.when(p() % 4 == 0, p() % 3 + 2).otherwise(p() % 3 + 1)))
    both = F.explode(F.array(F.struct(F.lit("north/1@cell").alias("engine"), north.alias("reading")), F.struct(F.lit("south/2@row").alias("engine"), south.alias("reading")))).alias("x")
    return rows.select(*KEY, both).select(*KEY, "x.engine", "x.reading")


_WITHDRAWN = ", base AS (SELECT * REPLACE (CASE WHEN profile % 3 = 0 AND status = 'REVIEW_REQUIRED' THEN CASE WHEN source = '' THEN 'gate1' ELSE source || '|gate1' END ELSE source END AS source) FROM facts)"


def _withdrawn(rows: DataFrame) -> DataFrame:
    hit = (p() % 3 == 0) & (F.col("status") == "REVIEW_REQUIRED")
    return rows.withColumn("source", F.when(hit, repasses.tagged(F.col("source"), "gate1")).otherwise(F.col("source")))


@query(
    f"""{WITH} {_ENGINES} {_WITHDRAWN}, j AS (SELECT b.*, a.reading, a.families, b.status = 'REVIEW_REQUIRED' AND list_contains(string_split(b.source, '|'), 'gate1') AND a.reading IS NOT NULL AS hit
    FROM base b LEFT JOIN agreed a ON a.profile = b.profile AND a.digest = b.digest AND a.field = b.field)
SELECT profile, digest, field, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status, CASE WHEN hit THEN reading ELSE value END AS value, second_allele,
       CASE WHEN hit THEN array_to_string(list_concat(list_filter(string_split(source, '|'), lambda x: x <> 'gate1'), ['gate1-agreed']), '|') ELSE source END AS source,
       CASE WHEN hit THEN 'agreed by ' || families || ' families' ELSE reason END AS reason FROM j"""
)
def gate1_repromotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return repasses.repromoted(_withdrawn(rows), _readings(rows), "gate1", "gate1-agreed").select(*_COLUMNS)


@query(
    f"""{WITH}, v AS (SELECT *, profile % 4 = 1 AS contradicted, profile % 2 = 1 AS repaired FROM facts)
SELECT profile, digest, field, CASE WHEN status = 'RESOLVED' AND contradicted AND repaired THEN 'REVIEW_REQUIRED' ELSE status END AS status, value, second_allele,
       CASE WHEN status = 'RESOLVED' AND contradicted AND repaired THEN CASE WHEN source = '' THEN 'contradicted' ELSE source || '|contradicted' END ELSE source END AS source, reason FROM v"""
)
def contradicted_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run three times: with the verdicts, with none of them (all come back), and with them again."""
    rows = facts(spark, sf_dir)
    verdicts = rows.select(*KEY, F.when(p() % 4 == 1, "CONTRADICTED").otherwise("CONFIRMED").alias("verdict"), (p() % 2 == 1).alias("repaired"))
    none = verdicts.withColumn("verdict", F.lit("CONFIRMED"))
    once = repasses.demoted(rows, verdicts, "contradicted")
    return repasses.demoted(repasses.demoted(once, none, "contradicted"), verdicts, "contradicted").select(*_COLUMNS)


_INK = "CASE profile % 3 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'INKED' END"


def _ink(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.when(p() % 3 == 0, "BLANK").when(p() % 3 == 1, "INKED").alias("ink"), ((p() % 100).cast("double") / 1000).alias("fraction"))


@query(
    f"""{WITH}, d AS (SELECT *, status = 'REVIEW_REQUIRED' AND {_INK} = 'BLANK' AS hit FROM facts)
SELECT profile, digest, field, CASE WHEN hit THEN 'NOT_TESTED' ELSE status END AS status, value, second_allele, CASE WHEN hit THEN CASE WHEN source = '' THEN 'ink' ELSE source || '|ink' END ELSE source END AS source,
       CASE WHEN hit THEN 'printed label, blank cell (' || printf('%.3f', (profile % 100) / 1000.0) || ') | was: ' || reason ELSE reason END AS reason FROM d"""
)
def ink_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return repasses.drained(rows, _ink(rows), "ink").select(*_COLUMNS)


@query(f"{WITH} SELECT {_OUT} FROM facts")
def ink_drain_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drain and its undo give the base rows."""
    rows = facts(spark, sf_dir)
    return repasses.refilled(repasses.drained(rows, _ink(rows), "ink"), "ink").select(*_COLUMNS)


@query(
    f"""{WITH} SELECT profile, digest, field, CASE WHEN status = 'UNKNOWN' AND {_INK} = 'BLANK' THEN 'ABSENT' WHEN status = 'UNKNOWN' AND {_INK} = 'INKED' THEN 'REVIEW_REQUIRED' ELSE status END AS status, value, second_allele, source,
       CASE WHEN status = 'UNKNOWN' AND {_INK} = 'BLANK' THEN 'empty slot' WHEN status = 'UNKNOWN' AND {_INK} = 'INKED' THEN 'slot holds ink' ELSE reason END AS reason FROM facts"""
)
def slot_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return repasses.certified(rows, _ink(rows)).select(*_COLUMNS)


@query(
    f"""{WITH} {_ENGINES}, two AS (SELECT n.profile, n.digest, n.field, n.reading FROM readings n JOIN readings s USING (profile, digest, field) WHERE n.engine LIKE 'north%' AND s.engine LIKE 'south%' AND n.reading = s.reading AND split_part(n.reading, '*', 2) IN ('01', '03') AND n.field IN ('A', 'B', 'DRB1')),
j AS (SELECT f.*, t.reading, f.status = 'REVIEW_REQUIRED' AND t.reading IS NOT NULL AND coalesce(f.field || '*03' <> t.reading OR f.profile % 7 <> 0, true) AS hit FROM facts f LEFT JOIN two t ON t.profile = f.profile AND t.digest = f.digest AND t.field = f.field)
SELECT profile, digest, field, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status, CASE WHEN hit THEN reading ELSE value END AS value, second_allele, CASE WHEN hit THEN CASE WHEN source = '' THEN 'reread' ELSE source || '|reread' END ELSE source END AS source, reason FROM j"""
)
def refused_rereads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognisers agree on an admissible family that isn't the refused one."""
    rows = facts(spark, sf_dir)
    read = _readings(rows)
    of = lambda family: read.where(repasses.family_of(F.col("engine")) == family).select(*KEY, "reading")
    vocabulary = spark.createDataFrame([(g, x) for g in ("A", "B", "DRB1") for x in ("01", "03")], "field string, family string")
    refused = rows.withColumn("refused", F.when(p() % 7 == 0, F.concat("field", F.lit("*03"))))
    return repasses.reread(refused, of("north"), of("south"), F.broadcast(vocabulary), "reread").select(*_COLUMNS)


@query(
    f"""{WITH} {_ENGINES}, j AS (SELECT f.*, a.reading, coalesce(f.status = 'RESOLVED' AND f.second_allele = 'UNREAD' AND a.reading IS NOT NULL AND a.reading <> f.value, false) AS hit FROM facts f LEFT JOIN agreed a ON a.profile = f.profile AND a.digest = f.digest AND a.field = f.field)
SELECT profile, digest, field, status, CASE WHEN hit THEN value || ' ' || reading ELSE value END AS value, CASE WHEN hit THEN 'READ' ELSE second_allele END AS second_allele, CASE WHEN hit THEN CASE WHEN source = '' THEN 'second' ELSE source || '|second' END ELSE source END AS source, reason FROM j"""
)
def second_allele_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return repasses.completed(rows, _readings(rows), "second").select(*_COLUMNS)


@query(
    f"""{WITH}, b AS (SELECT * REPLACE (CASE WHEN profile % 2 = 0 THEN CASE WHEN source = '' THEN 'proposal' ELSE source || '|proposal' END ELSE source END AS source), (['low', 'mid', 'high'])[profile % 3 + 1] AS engine, (['low', 'mid', 'high'])[profile // 3 % 3 + 1] AS licensed, profile % 5 = 1 AS against FROM facts),
j AS (SELECT *, profile % 2 = 0 AND against AND list_position(['low', 'mid', 'high'], engine) >= list_position(['low', 'mid', 'high'], licensed) AS hit FROM b)
SELECT profile, digest, field, CASE WHEN hit THEN 'REVIEW_REQUIRED' ELSE status END AS status, value, second_allele, CASE WHEN hit THEN array_to_string(list_filter(string_split(source, '|'), lambda x: x <> 'proposal'), '|') ELSE source END AS source, reason FROM j"""
)
def proposal_withdrawal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    names = ["low", "mid", "high"]
    promoted = rows.withColumn("source", F.when(p() % 2 == 0, repasses.tagged(F.col("source"), "proposal")).otherwise(F.col("source")))
    verdicts = rows.select(*KEY, F.concat(_pick(p() % 3, names), F.lit("/1")).alias("engine"), _pick(F.floor(p() / 3) % 3, names).alias("licensed_by"), F.when(p() % 5 == 1, "CONTRADICTED").otherwise("CONFIRMED").alias("verdict"))
    ranks = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "family string, rank int")
    return repasses.licensed_withdrawal(promoted, verdicts, ranks, "proposal").select(*_COLUMNS)


@query(
    f"""{WITH}, c AS (SELECT profile, digest, field, unnest([field || '*0' || (profile % 3 + 1), CASE WHEN profile % 4 = 0 THEN field || '*09' ELSE field || '*0' || (profile % 3 + 1) END]) AS claim FROM facts WHERE profile % 2 = 1 OR profile % 4 = 0),
one AS (SELECT profile, digest, field, min(claim) AS claim FROM c GROUP BY ALL HAVING min(claim) = max(claim)),
j AS (SELECT f.*, o.claim, f.status <> 'RESOLVED' AND o.claim IS NOT NULL AND f.profile % 9 <> 5 AS hit FROM facts f LEFT JOIN one o ON o.profile = f.profile AND o.digest = f.digest AND o.field = f.field)
SELECT profile, digest, field, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status, CASE WHEN hit THEN claim ELSE value END AS value, second_allele, CASE WHEN hit THEN CASE WHEN source = '' THEN 'prefix' ELSE source || '|prefix' END ELSE source END AS source, reason FROM j"""
)
def prefix_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of tokens that name their locus fill open cells; two different claims, or a comparison sheet, fill none."""
    rows = facts(spark, sf_dir)
    two = F.explode(F.array(_number(p() % 3 + 1), F.when(p() % 4 == 0, F.concat("field", F.lit("*09"))).otherwise(_number(p() % 3 + 1)))).alias("claim")
    claims = rows.where((p() % 2 == 1) | (p() % 4 == 0)).select(*KEY, two)
    return repasses.bound(rows, claims, "prefix", rows.where(p() % 9 == 5).select("digest").distinct()).select(*_COLUMNS)


@query(
    f"""{WITH} {LABELS} SELECT profile, digest, field, CASE WHEN outcome IN ('CORRECT', 'CORRECT_ABSTENTION') THEN NULL WHEN profile % 13 = 4 THEN '1 orientation' WHEN outcome = 'FALSE_ACCEPTANCE' THEN '5 recognition'
       WHEN reason = 'label owned by another' THEN '3 label' WHEN reason = 'empty cell' THEN '4 cell empty' WHEN reason = 'too many boxes' THEN '4 cell owner' WHEN reason = 'foreign prefix' THEN '5 recognition' ELSE '? unclassified' END AS checkpoint FROM outcomes"""
)
def checkpoint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.labelled(facts(spark, sf_dir)).withColumn("outcome", scoring.outcome())
    return rows.select(*KEY, repasses.checkpoint(F.col("outcome"), F.col("status"), F.col("reason"), p() % 13 == 4).alias("checkpoint"))


@query(
    """WITH r AS (SELECT p_partkey AS id, p_partkey % 5 AS k, 'A*' || p_partkey % 9 AS t FROM part)
SELECT id, CASE k WHEN 0 THEN 'NOT_AN_ALLELE' WHEN 1 THEN 'NO_FAMILY' WHEN 2 THEN 'FOREIGN' END AS kind, CASE WHEN k <= 2 THEN t END AS refused FROM r"""
)
def refusal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    token = F.concat(F.lit("A*"), (k % 9).cast("string"))
    quoted = F.concat(F.lit("'"), token, F.lit("'"))
    reason = F.when(k % 5 == 0, F.concat(quoted, F.lit(" does not parse as an allele"))).when(k % 5 == 1, F.concat(quoted, F.lit(" is no family of A"))).when(k % 5 == 2, F.concat(F.lit("foreign prefix "), quoted)).when(k % 5 == 3, "empty cell")
    return table(spark, sf_dir, "part").select(k.alias("id"), repasses.refusal(reason).alias("r")).select("id", "r.kind", "r.refused")


@query(
    f"""{WITH}, a AS (SELECT DISTINCT profile AS cell, profile % 5 AS answer FROM facts WHERE profile % 3 <> 0), b AS (SELECT DISTINCT profile AS cell, CASE WHEN profile % 7 = 0 THEN 9 ELSE profile % 5 END AS answer FROM facts WHERE profile % 4 <> 1),
c AS (SELECT DISTINCT profile AS cell, 7 AS answer FROM facts WHERE profile % 10 = 0), x AS (SELECT cell FROM a UNION SELECT cell FROM b UNION SELECT cell FROM c)
SELECT cell, CASE WHEN c.cell IS NOT NULL THEN 'SETTLED' WHEN a.answer = b.answer THEN 'AGREED' ELSE 'DISPUTED' END AS state, CASE WHEN c.cell IS NOT NULL THEN c.answer WHEN a.answer = b.answer THEN a.answer END AS answer
FROM x LEFT JOIN a USING (cell) LEFT JOIN b USING (cell) LEFT JOIN c USING (cell)"""
)
def two_labellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = facts(spark, sf_dir).select(p().alias("cell")).distinct()
    cell = F.col("cell")
    first = cells.where(cell % 3 != 0).select("cell", (cell % 5).alias("answer"))
    second = cells.where(cell % 4 != 1).select("cell", F.when(cell % 7 == 0, 9).otherwise(cell % 5).alias("answer"))
    return repasses.adjudicated(first, second, cells.where(cell % 10 == 0).select("cell", F.lit(7).cast("long").alias("answer")))


@query(f"{WITH} {LABELS} SELECT profile, digest, field FROM outcomes WHERE profile % 2 = 0 AND outcome IN ('MISSED', 'FALSE_ACCEPTANCE')")
def review_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose present reading disagrees with an earlier answer; a cell without one disagrees with nothing."""
    rows = scoring.labelled(facts(spark, sf_dir)).withColumn("outcome", scoring.outcome())
    prior = rows.where(p() % 2 == 0).select(*KEY)
    return rows.join(prior, KEY, "left_semi").where(F.col("outcome").isin("MISSED", "FALSE_ACCEPTANCE")).select(*KEY)


@query(f"{WITH} SELECT profile, digest, field FROM facts WHERE status IN ('UNKNOWN', 'REVIEW_REQUIRED') AND starts_with(reason, 'empty') AND profile % 6 <> 0")
def unanswered_empty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cells with an empty box, but those that a person answered already."""
    rows = facts(spark, sf_dir)
    answered = rows.where(p() % 6 == 0).select(*KEY)
    return rows.where(F.col("status").isin("UNKNOWN", "REVIEW_REQUIRED") & F.col("reason").startswith("empty")).join(answered, KEY, "left_anti").select(*KEY)


_MARK = "sha256(profile || '|' || digest || '|' || field || '|' || value)"


@query(f"{WITH} SELECT count(*) AS rows, sum(('0x' || substr({_MARK}, 1, 12))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr({_MARK}, 13, 12))::BIGINT)::VARCHAR AS mark FROM facts WHERE status = 'RESOLVED'")
def store_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repasses.fingerprint(facts(spark, sf_dir))


@query(f"{WITH}, r AS (SELECT split_part(rule_id, '/', 2) AS family, avg((split_part(value, '*', 1) = field AND profile % 50 <> 1)::INT) AS share FROM facts WHERE status = 'RESOLVED' GROUP BY ALL) SELECT family, round(share, 6) AS share, share >= 0.95 AS prints_locus FROM r")
def prefix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a family's values name their locus, and whether that is its habit."""
    named = (F.split_part("value", F.lit("*"), F.lit(1)) == F.col("field")) & (p() % 50 != 1)
    share = F.avg(named.cast("int"))
    rows = facts(spark, sf_dir).where("status = 'RESOLVED'").groupBy(F.split_part("rule_id", F.lit("/"), F.lit(2)).alias("family")).agg(share.alias("s"))
    return rows.select("family", F.round("s", 6).alias("share"), (F.col("s") >= 0.95).alias("prints_locus"))


@query("SELECT l_orderkey, max(n)::INT AS longest FROM (SELECT l_orderkey, CASE WHEN l_quantity < 30 THEN 0 ELSE count(*) FILTER (l_quantity >= 30) OVER (PARTITION BY l_orderkey, island) END AS n FROM (SELECT *, count(*) FILTER (l_quantity < 30) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM lineitem)) GROUP BY l_orderkey")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of neighbouring lines of an order that hold much."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") >= 30).alias("much")))).alias("lines"))
    return lines.select("l_orderkey", repasses.longest_run(F.transform("lines", lambda x: x["much"])).alias("longest"))


@query(f"{WITH} SELECT profile, digest, value AS caption FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY digest, field) AS nth FROM facts WHERE split_part(source, '|', 1) = 'caption') WHERE nth = 1")
def first_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption row of each profile, in a stated order."""
    rows = facts(spark, sf_dir).where(F.split_part("source", F.lit("|"), F.lit(1)) == "caption")
    first = rows.groupBy("profile").agg(F.min(F.struct("digest", "field", "value")).alias("f"))
    return first.select("profile", "f.digest", F.col("f.value").alias("caption"))


@query(matching_sql.with_(matching_sql.PEOPLE, matching_sql.PARSED) + "SELECT side, key FROM parsed WHERE locus IN ('A', 'B', 'DRB1') GROUP BY side, key HAVING count(*) FILTER (typing = 'BOTH') = 3")
def fully_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with both alleles at the three loci that a level needs."""
    return matching.profiles(spark, sf_dir).where(" AND ".join(f"{x}.typing = '{alleles.BOTH}'" for x in ("A", "B", "DRB1"))).select("side", "key")


@query(f"{WITH} SELECT DISTINCT profile FROM facts WHERE status = 'RESOLVED' AND field IN ('A', 'B') UNION SELECT profile FROM facts WHERE field = 'ROLE' AND status = 'RESOLVED' UNION SELECT profile FROM facts WHERE field = 'ABO' AND status = 'RESOLVED'")
def union_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).where("status = 'RESOLVED'")
    parts = [rows.where(F.col("field").isin(*x)).select("profile") for x in (("A", "B"), ("ROLE",), ("ABO",))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(f"{WITH} SELECT profile, array_to_string(list_sort(list_distinct(list(field || '=' || value))), ';') AS resolved FROM facts WHERE status = 'RESOLVED' GROUP BY profile")
def resolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each profile has resolved."""
    rows = facts(spark, sf_dir).where("status = 'RESOLVED'")
    return rows.groupBy("profile").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "field", "value"))), ";").alias("resolved"))


@query(f"{WITH} SELECT DISTINCT digest FROM facts f WHERE profile % 9 = 5 OR (SELECT count(DISTINCT value) FROM facts g WHERE g.digest = f.digest AND g.field = 'ROLE') > 1 OR NOT EXISTS (SELECT 1 FROM facts g WHERE g.digest = f.digest AND g.reason IS NOT NULL AND g.profile % 4 <> 3)")
def two_person_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may show two persons; a page about which too little is known is one of them (fail closed)."""
    per = facts(spark, sf_dir).groupBy("digest").agg(F.bool_or(p() % 9 == 5).alias("sheet"), F.count_distinct(F.when(F.col("field") == "ROLE", F.col("value"))).alias("roles"), F.bool_or(F.col("reason").isNotNull() & (p() % 4 != 3)).alias("known"))
    return per.where(F.col("sheet") | (F.col("roles") > 1) | ~F.col("known")).select("digest")


_TAGS = "CASE WHEN reason = 'foreign prefix' AND status <> 'RESOLVED' THEN 'foreign' WHEN status = 'UNKNOWN' THEN 'silent' WHEN status = 'REVIEW_REQUIRED' THEN 'review' WHEN second_allele = 'UNREAD' THEN 'half' ELSE 'plain' END"


@query(
    f"""{WITH}, t AS (SELECT DISTINCT profile, {_TAGS} AS tag, profile % 5 AS family FROM facts), n AS (SELECT tag, count(*) AS size FROM t GROUP BY tag),
rare AS (SELECT profile, arg_min(tag, (size, tag)) AS tag, min(family) AS family FROM t JOIN n USING (tag) GROUP BY profile),
turn AS (SELECT *, row_number() OVER (PARTITION BY tag, family ORDER BY sha256(profile::VARCHAR), profile) AS turn FROM rare),
place AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY turn, family) AS place FROM turn)
SELECT profile, tag, family, place FROM place WHERE place <= CASE tag WHEN 'foreign' THEN 12 WHEN 'silent' THEN 8 WHEN 'review' THEN 6 ELSE 4 END"""
)
def quota_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile stands in its rarest stratum; a stratum's quota goes round its families, in an order without favour."""
    tag = F.when((F.col("reason") == "foreign prefix") & (F.col("status") != "RESOLVED"), "foreign").when(F.col("status") == "UNKNOWN", "silent").when(F.col("status") == "REVIEW_REQUIRED", "review").when(F.col("second_allele") == "UNREAD", "half").otherwise("plain")
    tags = written(facts(spark, sf_dir).select("profile", tag.alias("tag")).distinct())
    sizes = tags.groupBy("tag").agg(F.count("*").alias("size"))  # one row for each stratum
    rare = tags.join(F.broadcast(sizes), "tag").groupBy("profile").agg(F.min(F.struct("size", "tag")).alias("r")).select("profile", "r.tag", (p() % 5).alias("family"))
    quota = F.when(F.col("tag") == "foreign", 12).when(F.col("tag") == "silent", 8).when(F.col("tag") == "review", 6).otherwise(4)
    order = W.partitionBy("tag", "family").orderBy(F.sha2(p().cast("string"), 256), "profile")
    turns = rare.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= 12)  # no family gives more than the largest quota
    placed = turns.withColumn("place", F.row_number().over(W.partitionBy("tag").orderBy("turn", "family")))
    return placed.where(F.col("place") <= quota).select("profile", "tag", "family", "place")


@query(f"{WITH} {_ENGINES} SELECT split_part(engine, '/', 1) AS family, split_part(engine, '@', 2) AS target, count(reading) AS readings FROM readings GROUP BY ALL")
def engine_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by the family and the target that an engine's name tells."""
    read = _readings(facts(spark, sf_dir))
    return read.groupBy(repasses.family_of(F.col("engine")).alias("family"), repasses.target_of(F.col("engine")).alias("target")).agg(F.count("reading").alias("readings"))


@query(
    f"""{WITH} {_ENGINES}, n AS (SELECT profile, digest, field, reading AS north FROM readings WHERE engine LIKE 'north%'), s AS (SELECT profile, digest, field, reading AS south FROM readings WHERE engine LIKE 'south%')
SELECT field, count(*) FILTER (north = south) AS same, count(*) FILTER (north <> south) AS different, count(*) FILTER (north IS NOT NULL AND south IS NULL) AS first_only, count(*) FILTER (north IS NULL AND south IS NOT NULL) AS second_only, count(*) FILTER (north IS NULL AND south IS NULL) AS neither
FROM n JOIN s USING (profile, digest, field) GROUP BY field"""
)
def engine_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines under one rule, side by side: one pass with a column for each."""
    read = _readings(facts(spark, sf_dir))
    of = lambda x: F.max(F.when(repasses.family_of(F.col("engine")) == x, F.col("reading"))).alias(x)
    cells = read.groupBy(*KEY).agg(of("north"), of("south"))
    a, b = F.col("north"), F.col("south")
    tests = {"same": a == b, "different": a != b, "first_only": a.isNotNull() & b.isNull(), "second_only": a.isNull() & b.isNotNull(), "neither": a.isNull() & b.isNull()}
    return cells.groupBy("field").agg(*[F.count_if(x).alias(n) for n, x in tests.items()])


@query("SELECT p_partkey AS id, p_partkey % 4 AS n_media, CASE WHEN p_partkey % 4 > 0 THEN 'm0' END AS first_media, CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE p_size END AS votes FROM part")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and maps that are stored as JSON: how long a list is, its first member, a vote; broken text counts as none."""
    k = F.col("p_partkey")
    media = F.to_json(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 4), lambda i: F.concat(F.lit("m"), i.cast("string"))))
    votes = F.when(k % 6 == 5, '{"yes": ').otherwise(F.to_json(F.create_map(F.lit("yes"), F.col("p_size").cast("int"))))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), media.alias("media"), votes.alias("votes"))
    return rows.select("id", F.json_array_length("media").alias("n_media"), F.get(F.from_json("media", "array<string>"), F.lit(0)).alias("first_media"), F.coalesce(F.from_json("votes", "map<string, int>")["yes"], F.lit(0)).alias("votes"))


@query(f"WITH {MESSAGES_SQL} SELECT page, count(*) AS rows, sum(CASE WHEN page % 2 = 1 THEN message_id + 1 ELSE message_id END)::BIGINT AS total FROM messages GROUP BY page")
def partition_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by page, of which the odd pages are rebuilt; the others keep their files."""
    path = new_path(spark, "rebuilt")
    rows = messages(spark, sf_dir).select("page", "message_id")
    sinks.rebuild_partitions(rows, path, "page")
    sinks.rebuild_partitions(rows.where("page % 2 = 1").withColumn("message_id", F.col("message_id") + 1), path, "page")
    return spark.read.parquet(path).groupBy(F.col("page").cast("long").alias("page")).agg(F.count("*").alias("rows"), F.sum("message_id").alias("total"))


@query(f"{WITH}, n AS (SELECT count(*) AS n FROM facts), h AS (SELECT count(*) AS h FROM facts WHERE profile % 2 = 0) SELECT n AS rows, h AS rows_before, true AS swapped, false AS swapped_bad FROM n, h")
def build_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, check and swap: a first build, a second over it, and a third that its check refuses."""
    path, rows = new_path(spark, "swap"), facts(spark, sf_dir).select("profile", "digest", "field")
    sinks.build_and_swap(rows.where("profile % 2 = 0"), path, lambda _: True)
    done = sinks.build_and_swap(rows, path, lambda df: not df.isEmpty())
    bad = sinks.build_and_swap(rows.limit(0), path, lambda df: not df.isEmpty())
    now, before = spark.read.parquet(path).agg(F.count("*").alias("rows")), spark.read.parquet(f"{path}.before").agg(F.count("*").alias("rows_before"))
    return now.join(before, F.lit(1) == F.lit(1)).select("rows", "rows_before", F.lit(done).alias("swapped"), F.lit(bad).alias("swapped_bad"))


@query(f"WITH {MESSAGES_SQL} SELECT page, count(*) AS rows, 0 AS new_again FROM messages GROUP BY page")
def batched_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended in two runs, the second of which finds some done; a third finds nothing to do."""
    path, rows = new_path(spark, "batches"), messages(spark, sf_dir).select("page", "message_id")
    sinks.append_batches(rows.where("page % 3 = 0"), path, "page")
    sinks.append_batches(rows, path, "page")
    again = sinks.append_batches(rows, path, "page")
    return spark.read.parquet(path).groupBy(F.col("page").cast("long").alias("page")).agg(F.count("*").alias("rows")).withColumn("new_again", F.lit(again))


@query(f"{WITH} SELECT field, count(*) AS rows, count(CASE WHEN profile % 2 = 1 THEN status END) AS with_status, count(CASE WHEN profile % 2 = 0 THEN value END) AS with_value FROM facts GROUP BY field")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends with different columns: the table has them all, null where a batch lacked one."""
    path, rows = new_path(spark, "evolving"), facts(spark, sf_dir)
    sinks.append_evolving(rows.where("profile % 2 = 0").select("profile", "field", "value"), path)
    sinks.append_evolving(rows.where("profile % 2 = 1").select("profile", "field", "status"), path)
    return spark.read.option("mergeSchema", True).parquet(path).groupBy("field").agg(F.count("*").alias("rows"), F.count("status").alias("with_status"), F.count("value").alias("with_value"))


@query(f"{WITH}, o AS (SELECT digest, list_sort(list_distinct(list(field) FILTER (status <> 'RESOLVED' AND reason IN ('empty cell', 'too many boxes')))) AS open FROM facts GROUP BY digest) SELECT digest, array_to_string(open, ',') AS open_fields FROM o WHERE len(open) > 0")
def unresolved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still open on each document, for reasons that a further pass could mend."""
    wanted = (F.col("status") != "RESOLVED") & F.col("reason").isin("empty cell", "too many boxes")
    return repasses.open_fields(facts(spark, sf_dir).where(wanted))


_TASKS = "sha256('pairstone|' || digest || '|' || field)"


@query(f"{WITH}, t AS (SELECT left({_TASKS}, 16) AS cell, field, value, status FROM facts) SELECT cell, field, false AS shows_value FROM t UNION ALL SELECT cell, coalesce(value, status), true FROM t")
def blind_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one draw: tasks without what was read, and what was read under the same cell ids."""
    rows = facts(spark, sf_dir).withColumn("cell", F.left(F.sha2(F.concat_ws("|", F.lit("pairstone"), "digest", "field"), 256), F.lit(16)))
    tasks, hidden = new_path(spark, "tasks"), new_path(spark, "hidden")
    repasses.blind(rows, tasks, hidden)
    shown, kept = spark.read.parquet(tasks), spark.read.parquet(hidden)
    assert shown.columns == ["cell", "field"]
    return shown.select("cell", "field", F.lit(False).alias("shows_value")).unionByName(kept.select("cell", F.coalesce("value", "status").alias("field"), F.lit(True).alias("shows_value")))


@query(
    f"""{WITH}, p AS (SELECT DISTINCT digest, profile FROM facts) SELECT digest, CASE WHEN profile % 3 = 0 THEN 'level' WHEN profile % 4 = 0 THEN 'raw' ELSE 'none' END AS frame,
       CASE WHEN profile % 3 = 0 THEN profile % 7 WHEN profile % 4 = 0 THEN profile % 5 ELSE 0 END AS tilt, profile % 13 = 4 AS sideways FROM p"""
)
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each page, from the first of several passes that measured it; pages that none measured are level."""
    pages = facts(spark, sf_dir).select("digest", "profile").distinct()
    level = pages.where("profile % 3 = 0").select("digest", F.lit("level").alias("frame"), (p() % 7).alias("tilt"))
    raw = pages.where("profile % 4 = 0").select("digest", F.lit("raw").alias("frame"), (p() % 5).alias("tilt"))
    sideways = pages.where("profile % 13 = 4").select("digest", F.lit(True).alias("sideways"))
    found = repasses.by_priority(pages.select("digest"), [level, raw], "digest", {"frame": "none", "tilt": 0})
    return found.join(sideways, "digest", "left").select("digest", "frame", "tilt", F.coalesce("sideways", F.lit(False)).alias("sideways"))


@query(f"{WITH}, h AS (SELECT digest, bool_or(field = 'ROLE' AND regexp_matches(coalesce(value, ''), '^ROLE[*]0[12]$')) AS clean FROM facts GROUP BY digest) SELECT f.profile, f.digest, f.field FROM facts f JOIN h USING (digest) WHERE clean")
def clean_header_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pages whose header reads exactly as printed."""
    rows = facts(spark, sf_dir)
    clean = rows.where((F.col("field") == "ROLE") & F.col("value").rlike(r"^ROLE\*0[12]$")).select("digest").distinct()
    return rows.join(clean, "digest", "left_semi").select(*KEY)


@query(f"{WITH} {_ENGINES}, t AS (SELECT f.field, f.status, f.value, a.reading FROM facts f LEFT JOIN agreed a ON a.profile = f.profile AND a.digest = f.digest AND a.field = f.field WHERE f.digest IN (SELECT digest FROM facts WHERE field = 'ROLE' AND status = 'RESOLVED')) SELECT field, count(*) AS cells, count(*) FILTER (status = 'RESOLVED') AS accepted, count(*) FILTER (status = 'RESOLVED' AND value = reading) AS right, round(count(*) FILTER (status = 'RESOLVED' AND value = reading) / nullif(count(*) FILTER (status = 'RESOLVED' AND reading IS NOT NULL), 0), 6) AS share FROM t GROUP BY field")
def gate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gate accepts on trusted pages, and how much of it two families read alike."""
    rows = facts(spark, sf_dir)
    trusted = rows.where("field = 'ROLE' AND status = 'RESOLVED'").select("digest").distinct()
    joined = rows.join(trusted, "digest", "left_semi").join(repasses.agreed(_readings(rows)).drop("families"), KEY, "left")
    accepted = F.col("status") == "RESOLVED"
    right, known = F.count_if(accepted & (F.col("value") == F.col("reading"))), F.count_if(accepted & F.col("reading").isNotNull())
    return joined.groupBy("field").agg(F.count("*").alias("cells"), F.count_if(accepted).alias("accepted"), right.alias("right"), F.round(F.try_divide(right, known), 6).alias("share"))


@query(f"{WITH}, s AS (SELECT *, (profile * 7 + length(field)) % 5 AS cost FROM facts) SELECT profile, digest, field, CASE WHEN value IS NULL THEN 'NONE' WHEN cost <= 1 THEN 'CONFIRMED' WHEN cost <= 3 THEN 'UNCONFIRMED' ELSE 'CONTRADICTED' END AS verdict FROM s")
def rescored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored readings under another comparison rule, without reading anything again."""
    cost = (p() * 7 + F.length("field")) % 5
    return repasses.rescored(facts(spark, sf_dir).withColumn("cost", cost), 1, 3).select(*KEY, "verdict")


_SYMBOLS, _FAMILIES = "0123456789:", {"02", "24", "68"}


@query(
    """WITH w AS (SELECT p_partkey AS id, (['02', '24:02', '68', '60', '24:101'])[p_partkey % 5 + 1] AS word, p_partkey % 3 = 1 AS blurred FROM part)
SELECT id, CASE WHEN word = '60' THEN '68' ELSE word END AS text, CASE WHEN word = '60' THEN 9.0 ELSE 0.0 END + CASE WHEN blurred THEN 0.25 ELSE 0.0 END AS cost, CASE WHEN blurred THEN '7' || word[2:] ELSE word END AS free FROM w"""
)
def constrained_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made from a text, of which the first symbol is sometimes read better as another: the grammar brings the text back, at a cost."""
    k = F.col("p_partkey")
    word = _pick(k % 5, ["02", "24:02", "68", "60", "24:101"])
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    # Log scores: the printed symbol 0, all others -9; a frame of blanks between symbols. A blurred first frame prefers a 7.
    score = lambda c, i: F.transform(F.array(*map(F.lit, _SYMBOLS)), lambda s: F.when((i == 0) & (k % 3 == 1), F.when(s == "7", 0.0).when(s == c, -0.25).otherwise(-9.0)).otherwise(F.when(s == c, 0.0).otherwise(-9.0)))
    blank = F.array(F.lit(0.0), *[F.lit(-9.0)] * len(_SYMBOLS))
    frames = F.flatten(F.transform(letters, lambda c, i: F.array(F.concat(F.array(F.lit(-9.0)), score(c, i)), blank)))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), frames.alias("frames"))
    return decode.decoded(rows, _SYMBOLS, _FAMILIES).select("id", "text", F.round("cost", 6).alias("cost"), "free")


@query(
    """WITH i AS (SELECT p_partkey AS id, 3 + p_partkey % 3 AS gene, (['DRB3', '4', 'drb 5', 'S', '34', NULL])[p_partkey % 6 + 1] AS reading FROM part)
SELECT id, CASE WHEN reading IS NULL OR reading IN ('S', '34') THEN 'UNCONFIRMED' WHEN right(reading, 1) = gene::VARCHAR THEN 'CONFIRMED' ELSE 'CONTRADICTED' END AS verdict FROM i"""
)
def gene_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second reading names the gene: digits that stand alone count, an S alone has no opinion."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (3 + k % 3).cast("string").alias("gene"), _pick(k % 6, ["DRB3", "4", "drb 5", "S", "34", None]).alias("reading"))
    return rows.select("id", repasses.gene_verdict(F.col("gene"), F.col("reading")).alias("verdict"))


@query(
    """WITH i AS (SELECT p_partkey AS id, (['02', '02 24', '02 24 68', '99', '02 99', ''])[p_partkey % 6 + 1] AS reading FROM part)
SELECT id, CASE reading WHEN '02' THEN 'A*02' WHEN '02 24' THEN 'A*02 A*24' END AS proposal FROM i"""
)
def proposal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading as a value to propose: one or two families of the locus, named by it; anything else proposes nothing."""
    reading = _pick(F.col("p_partkey") % 6, ["02", "02 24", "02 24 68", "99", "02 99", ""])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), repasses.proposal(F.lit("A"), reading, F.array(*map(F.lit, sorted(_FAMILIES)))).alias("proposal"))


@query("WITH s AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_partkey AS k, p_size + 1 AS v FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(s.k, i.k) AS k, coalesce(s.v, i.v) AS ignored, coalesce(i.v, s.v) AS replaced FROM s FULL JOIN i ON s.k = i.k")
def insert_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch inserted where its keys are new (the stored row stays), and inserted over what was there."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    stored, batch = rows.where("k % 2 = 0"), rows.where("k % 3 = 0").withColumn("v", F.col("v") + 1)
    ignored, replaced = sinks.insert_or_ignore(stored, batch, ["k"]), sinks.insert_or_replace(stored, batch, ["k"])
    return ignored.withColumnRenamed("v", "ignored").join(replaced.withColumnRenamed("v", "replaced"), "k")


_ROLES = "(['DONOR', 'RECIPIENT', 'UNKNOWN'])[key % 3 + 1]"


@query(f"WITH p AS (SELECT c_custkey AS key, {_ROLES.replace('key', 'c_custkey')} AS role, c_nationkey AS place FROM customer) SELECT r.place, count(*) AS pairs FROM p d JOIN p r ON d.place = r.place AND d.key <> r.key WHERE d.role IN ('DONOR', 'UNKNOWN') AND r.role IN ('RECIPIENT', 'UNKNOWN') GROUP BY r.place")
def eligible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one pool whose roles allow them, nobody with themselves: counted by roles, no pair is made."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(_pick(key % 3, ["DONOR", "RECIPIENT", "UNKNOWN"]).alias("role"), F.col("c_nationkey").alias("place"))
    n = lambda *roles: F.count_if(F.col("role").isin(*roles))
    per = rows.groupBy("place").agg((n("DONOR", "UNKNOWN") * n("RECIPIENT", "UNKNOWN") - n("UNKNOWN")).alias("pairs"))
    return per.where("pairs > 0")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 3 THEN sha256('file ' || (p_partkey % 100)) END AS digest FROM part")
def path_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each attachment's file, by its path; files that aren't there have none."""
    k = F.col("p_partkey")
    path = lambda n: F.concat(F.lit("photos/"), n.cast("string"), F.lit(".jpg"))
    files = table(spark, sf_dir, "part").where("p_partkey % 4 <> 3").select(path(k).alias("path"), F.sha2(F.concat(F.lit("file "), (k % 100).cast("string")), 256).alias("digest"))
    return table(spark, sf_dir, "part").select(k.alias("id"), path(k).alias("path")).join(files, "path", "left").select("id", "digest")


@query(f"{WITH}, v AS (SELECT profile, field, value, count(*) AS n FROM facts WHERE status = 'RESOLVED' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile, field ORDER BY n DESC, value) AS nth, count(*) OVER (PARTITION BY profile, field) AS kinds FROM v) SELECT profile, field, max(value) FILTER (nth = 1) AS first, max(value) FILTER (nth = 2) AS second, any_value(kinds) = 2 AS two_way FROM r GROUP BY profile, field HAVING any_value(kinds) >= 2")
def two_way_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose answers split, with the two commonest, and whether there are just two."""
    votes = facts(spark, sf_dir).where("status = 'RESOLVED'").groupBy("profile", "field", "value").agg(F.count("*").alias("n"))
    kinds = votes.groupBy("profile", "field").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("v")).where(F.size("v") >= 2)
    return kinds.select("profile", "field", F.col("v")[0]["value"].alias("first"), F.col("v")[1]["value"].alias("second"), (F.size("v") == 2).alias("two_way"))


@query(f"{WITH} {LABELS} SELECT field, count(*) FILTER (outcome = 'CORRECT') AS correct, count(*) FILTER (outcome = 'FALSE_ACCEPTANCE') AS wrong, count(*) FILTER (outcome IN ('MISSED', 'CORRECT_ABSTENTION')) AS silent FROM outcomes WHERE field IN ('ABO', 'RH', 'ROLE') GROUP BY field")
def document_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, sign and role of documents against their labels."""
    rows = scoring.labelled(facts(spark, sf_dir)).where(F.col("field").isin("ABO", "RH", "ROLE")).withColumn("outcome", scoring.outcome())
    of = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return rows.groupBy("field").agg(of("CORRECT").alias("correct"), of("FALSE_ACCEPTANCE").alias("wrong"), of("MISSED", "CORRECT_ABSTENTION").alias("silent"))
