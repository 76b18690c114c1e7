"""Later passes over a facts store. Each is a pure layer: it reads base rows and evidence and gives the rows as they stand after it.

Sources are tags joined by '|'; a pass adds its own tag, so that it can be undone and applies once. Evidence tables
are joined on the cell's key; nothing but a cell's own status, value, reason and source changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["profile", "digest", "field"]
#: Reasons by the checkpoint at which a reading failed, first match wins, and refusals with the text that was refused.
CHECKPOINTS = (("3 label", "^no label|label owned by another"), ("4 cell empty", "^empty cell|held nothing"), ("4 cell owner", "too many boxes|straddles"), ("5 recognition", "does not parse|foreign prefix"))
REFUSALS = (("NOT_AN_ALLELE", r"^'([^']*)' does not parse"), ("NO_FAMILY", r"^'([^']*)' is no family"), ("FOREIGN", r"^foreign prefix '([^']*)'"))


def family_of(engine: Column) -> Column:
    """The family of an engine's name: what stands before the version."""
    return F.split_part(F.split_part(engine, F.lit("@"), F.lit(1)), F.lit("/"), F.lit(1))


def target_of(engine: Column) -> Column:
    """What an engine was applied to: behind the '@', if there is one."""
    return F.nullif(F.split_part(engine, F.lit("@"), F.lit(2)), F.lit(""))


def has_tag(source: Column, tag: str) -> Column:
    return F.array_contains(F.split(source, r"\|"), tag)


def tagged(source: Column, tag: str) -> Column:
    return F.when(source == "", tag).otherwise(F.concat_ws("|", source, F.lit(tag)))


def untagged(source: Column, tag: str) -> Column:
    return F.array_join(F.array_remove(F.split(source, r"\|"), tag), "|")


def _changed(rows: DataFrame, like: DataFrame, hit: Column, **new: Column) -> DataFrame:
    made = {k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}
    return rows.withColumns(made).select(*like.columns)


def agreed(readings: DataFrame) -> DataFrame:
    """KEY, reading, families: cells that two engine families read alike and none otherwise. readings: KEY, engine, reading."""
    per = readings.where("reading IS NOT NULL").groupBy(*KEY).agg(F.min("reading").alias("reading"), F.max("reading").alias("other"), F.count_distinct(family_of(F.col("engine"))).alias("families"))
    return per.where("reading = other AND families >= 2").drop("other")


def repromoted(facts: DataFrame, readings: DataFrame, withdrawn: str, tag: str) -> DataFrame:
    """What a gate withdrew resolves again where two families agree; the tag of the pass takes the gate's place."""
    rows = facts.join(agreed(readings), KEY, "left")
    hit = (F.col("status") == "REVIEW_REQUIRED") & has_tag(F.col("source"), withdrawn) & F.col("reading").isNotNull()
    reason = F.concat(F.lit("agreed by "), F.col("families").cast("string"), F.lit(" families"))
    return _changed(rows, facts, hit, status=F.lit("RESOLVED"), value=F.col("reading"), reason=reason, source=tagged(untagged(F.col("source"), withdrawn), tag))


def demoted(facts: DataFrame, verdicts: DataFrame, tag: str) -> DataFrame:
    """Repaired values that a second reading contradicts go to review; those that it no longer contradicts come back. Both ways from the base rows, so once or twice is the same."""
    rows = facts.join(verdicts, KEY, "left")
    contradicted = F.coalesce(F.col("verdict") == "CONTRADICTED", F.lit(False)) & F.col("repaired")
    down = (F.col("status") == "RESOLVED") & contradicted
    back = (F.col("status") == "REVIEW_REQUIRED") & has_tag(F.col("source"), tag) & ~contradicted
    gone = _changed(rows, rows, down, status=F.lit("REVIEW_REQUIRED"), source=tagged(F.col("source"), tag))
    return _changed(gone, facts, back, status=F.lit("RESOLVED"), source=untagged(F.col("source"), tag))


def drained(facts: DataFrame, ink: DataFrame, tag: str) -> DataFrame:
    """Cells in review whose paper is blank are not tested; the reason keeps the old one behind ' | was: '."""
    rows = facts.join(ink, KEY, "left")
    hit = (F.col("status") == "REVIEW_REQUIRED") & (F.col("ink") == "BLANK") & ~has_tag(F.col("source"), tag)
    reason = F.concat(F.lit("printed label, blank cell ("), F.format_number("fraction", 3), F.lit(") | was: "), F.coalesce("reason", F.lit("")))
    return _changed(rows, facts, hit, status=F.lit("NOT_TESTED"), reason=reason, source=tagged(F.col("source"), tag))


def refilled(facts: DataFrame, tag: str) -> DataFrame:
    """Undo drained()."""
    hit = has_tag(F.col("source"), tag)
    return _changed(facts, facts, hit, status=F.lit("REVIEW_REQUIRED"), reason=F.substring_index("reason", " | was: ", -1), source=untagged(F.col("source"), tag))


def certified(facts: DataFrame, slots: DataFrame) -> DataFrame:
    """A gene without a reading is ABSENT where its slot is empty, and goes to review where the slot holds ink."""
    rows = facts.join(slots, KEY, "left")
    open_ = F.col("status") == "UNKNOWN"
    gone = _changed(rows, rows, open_ & (F.col("ink") == "BLANK"), status=F.lit("ABSENT"), reason=F.lit("empty slot"))
    return _changed(gone, facts, open_ & (F.col("ink") == "INKED"), status=F.lit("REVIEW_REQUIRED"), reason=F.lit("slot holds ink"))


def reread(facts: DataFrame, one: DataFrame, two: DataFrame, vocabulary: DataFrame, tag: str) -> DataFrame:
    """Refused cells resolve with what two recognisers both read, if its family is admissible and isn't what was refused. one, two: KEY, reading; vocabulary: field, family."""
    both = one.join(two.withColumnRenamed("reading", "second"), KEY).where("reading = second").drop("second")
    known = both.withColumn("family", F.split_part("reading", F.lit("*"), F.lit(2))).join(vocabulary, ["field", "family"], "left_semi").drop("family")
    rows = facts.join(known, KEY, "left")
    hit = (F.col("status") == "REVIEW_REQUIRED") & F.col("reading").isNotNull() & ~F.coalesce(F.col("refused") == F.col("reading"), F.lit(False))
    return _changed(rows, facts, hit, status=F.lit("RESOLVED"), value=F.col("reading"), source=tagged(F.col("source"), tag))


def completed(facts: DataFrame, readings: DataFrame, tag: str) -> DataFrame:
    """A resolved single allele takes the second one that two families read alike in the rest of its row; its flag becomes READ."""
    rows = facts.join(agreed(readings), KEY, "left")
    hit = (F.col("status") == "RESOLVED") & (F.col("second_allele") == "UNREAD") & F.col("reading").isNotNull() & (F.col("reading") != F.col("value"))
    return _changed(rows, facts, hit, value=F.concat_ws(" ", "value", "reading"), second_allele=F.lit("READ"), source=tagged(F.col("source"), tag))


def licensed_withdrawal(facts: DataFrame, verdicts: DataFrame, ranks: DataFrame, tag: str) -> DataFrame:
    """Promoted values go back to review where an engine of at least the licensing one's rank contradicts them. verdicts: KEY, engine, licensed_by, verdict; ranks: family, rank."""
    rank = lambda name, column: ranks.select(F.col("family").alias(name), F.col("rank").alias(column))
    ranked = verdicts.where("verdict = 'CONTRADICTED'").withColumn("f", family_of(F.col("engine"))).join(F.broadcast(rank("f", "by")), "f").join(F.broadcast(rank("licensed_by", "floor")), "licensed_by")  # one row for each engine family
    against = ranked.where("by >= floor").select(*KEY, F.lit(True).alias("against")).distinct()
    rows = facts.join(against, KEY, "left")
    return _changed(rows, facts, has_tag(F.col("source"), tag) & F.coalesce("against", F.lit(False)), status=F.lit("REVIEW_REQUIRED"), source=untagged(F.col("source"), tag))


def bound(facts: DataFrame, claims: DataFrame, tag: str, sheets: DataFrame) -> DataFrame:
    """Claims (KEY, claim) fill cells that nothing resolved, but not on comparison sheets, nor where a cell has two claims."""
    one = claims.groupBy(*KEY).agg(F.min("claim").alias("claim"), F.max("claim").alias("other")).where("claim = other").drop("other").join(sheets, "digest", "left_anti")
    rows = facts.join(one, KEY, "left")
    return _changed(rows, facts, (F.col("status") != "RESOLVED") & F.col("claim").isNotNull(), status=F.lit("RESOLVED"), value=F.col("claim"), source=tagged(F.col("source"), tag))


def checkpoint(outcome: Column, status: Column, reason: Column, sideways: Column) -> Column:
    """The first checkpoint at which a cell that isn't right failed: the page first, then policy, then the reason."""
    first = F.when(outcome.isin("CORRECT", "CORRECT_ABSTENTION"), None).when(sideways, "1 orientation").when(status == "NOT_TESTED", "8 policy").when(outcome == "FALSE_ACCEPTANCE", "5 recognition")
    for name, pattern in CHECKPOINTS:
        first = first.when(F.coalesce(reason, F.lit("")).rlike(pattern), name)
    return first.otherwise("? unclassified")


def refusal(reason: Column) -> Column:
    """struct(kind, refused) of a reason that names what it refused, else null."""
    hits = [F.when(reason.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(reason, p, 1).alias("refused"))) for k, p in REFUSALS]
    return F.coalesce(*hits)


def adjudicated(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """cell, state, answer: a third reader's answer stands; else two equal ones; else the cell is disputed, also where only one reader came."""
    a, b, c = (x.select("cell", F.col("answer").alias(n), F.lit(True).alias(f"has_{n}")) for x, n in ((first, "a"), (second, "b"), (third, "c")))
    rows = a.join(b, "cell", "full").join(c, "cell", "full")
    both = F.coalesce(F.col("has_a") & F.col("has_b") & F.col("a").eqNullSafe(F.col("b")), F.lit(False))
    settled = F.coalesce("has_c", F.lit(False))
    return rows.select("cell", F.when(settled, "SETTLED").when(both, "AGREED").otherwise("DISPUTED").alias("state"), F.when(settled, F.col("c")).when(both, F.col("a")).alias("answer"))


def fingerprint(facts: DataFrame) -> DataFrame:
    """rows, mark: an order-free mark of the resolved rows. Equal stores have equal marks; a changed row changes it."""
    row = F.sha2(F.concat_ws("|", *KEY, "value"), 256)
    part = lambda at: F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")
    return facts.where("status = 'RESOLVED'").agg(F.count("*").alias("rows"), F.concat_ws("-", F.sum(part(1)).cast("string"), F.sum(part(13)).cast("string")).alias("mark"))


def longest_run(flags: Column) -> Column:
    """The longest run of trues in an array."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, flag: Column) -> Column:
        run = F.when(flag, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(flags, start, step, lambda acc: acc["most"])


def open_fields(cells: DataFrame) -> DataFrame:
    """digest, open_fields: the fields of each document among the given cells."""
    return cells.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("open_fields"))


def blind(rows: DataFrame, tasks: str, hidden: str) -> None:
    """Write a draw as tasks that lack what was read, and what was read in a table of its own."""
    rows.select("cell", "field").write.parquet(tasks)
    rows.select("cell", "value", "status").write.parquet(hidden)


def by_priority(keys: DataFrame, sources: list[DataFrame], key: str, otherwise: dict) -> DataFrame:
    """keys with the columns of the first source that has the key; sources have the key once."""
    named = [s.select(key, F.struct(*otherwise).alias(f"s{i}")) for i, s in enumerate(sources)]
    joined = reduce(lambda a, b: a.join(b, key, "left"), named, keys)
    first = F.coalesce(*[F.col(f"s{i}") for i in range(len(sources))])
    return joined.select(key, *[F.coalesce(first[c], F.lit(v)).alias(c) for c, v in otherwise.items()])


def rescored(rows: DataFrame, confirmed: int, unconfirmed: int) -> DataFrame:
    """Adds the verdict that a comparison's cost gives under these bounds; a cell without a reading has none."""
    cost = F.col("cost")
    verdict = F.when(F.col("value").isNull(), "NONE").when(cost <= confirmed, "CONFIRMED").when(cost <= unconfirmed, "UNCONFIRMED").otherwise("CONTRADICTED")
    return rows.withColumn("verdict", verdict)


def gene_verdict(gene: Column, reading: Column) -> Column:
    """CONFIRMED or CONTRADICTED by the digits 3 to 5 that stand alone in a reading; UNCONFIRMED where it has none."""
    found = F.regexp_extract_all(F.coalesce(reading, F.lit("")), F.lit("(?<![0-9])([345])(?![0-9])"), F.lit(1))
    return F.when(F.size(found) == 0, "UNCONFIRMED").when(F.array_contains(found, gene), "CONFIRMED").otherwise("CONTRADICTED")


def proposal(locus: Column, reading: Column, families: Column) -> Column:
    """One or two admissible families of a reading under their locus's name, else null."""
    parts = F.filter(F.split(F.coalesce(reading, F.lit("")), r"\s+"), lambda x: x != "")
    fit = F.size(parts).between(1, 2) & F.forall(parts, lambda x: F.array_contains(families, x))
    return F.when(fit, F.array_join(F.transform(parts, lambda x: F.concat(locus, F.lit("*"), x)), " "))
