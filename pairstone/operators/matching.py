"""Directed pair ranking: mismatch vectors, gate buckets, levels, integer penalties, total order.

Everything is a column expression over a row that holds both sides, so a plan with any pair join
beneath stays inside generated code. The recipient is always the host: the count is of donor alleles that
the recipient lacks. Unknown is never zero, and losing information never improves a place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairstone.functions import alleles
from pairstone.shared import written
from pairstone.sources import people as source

LOCI, PRESENCE = source.LOCI, source.PRESENCE
#: Fixed values of the policy: weights of a first and a second mismatch, in the order of scoring.
SCORED = ("DRB1", "DQB1", "B", "A", "C")
FIRST = {"DRB1": 60, "DQB1": 40, "B": 20, "A": 10, "C": 10}
SECOND = {"DRB1": 20, "DQB1": 10, "B": 10, "A": 0, "C": 0}
PRESENCE_CHARGE, GATE_FULL, GATE_HALF, UNKNOWN_AS = 10, 10, 5, 2
TIER_COST, UNKNOWN_COST = {"A": 0, "B": 1, "C": 3}, 6
NO_LEVEL = 99
BUCKETS = ("RANKED", "PROVISIONAL_ABO", "INSUFFICIENT_HLA", "INSUFFICIENT_ABO", "ABO_INCOMPATIBLE", "BLOCKED_DSA_OR_LAB_REVIEW", "BLOCKED_POSITIVE_CROSSMATCH", "EXCLUDED_NON_CLINICAL")
DONATES_TO = {"O": ("O", "A", "B", "AB"), "A": ("A", "AB"), "B": ("B", "AB"), "AB": ("AB",)}
POLICY = "PAIR_SCREEN_2"
#: Donors of one part of a group in a join of pairs, and parts that there are at least.
PART, LEAST_PARTS = 4096, 8


def profiles(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """One row for each person: traits, and a struct(typing, alleles, tier) for each locus. only: a condition on side and key, applied before anything is parsed."""
    kept = F.lit(True) if only is None else only
    rows = source.typings(spark, sf_dir).where(kept)
    # Many people share a stored value; it is parsed once.
    stored = rows.select("locus", "value", "second_allele").distinct().select("*", alleles.locus_value(F.col("value"), F.col("second_allele"), F.col("locus")).alias("v"))
    read = stored.select("locus", "value", "second_allele", F.struct("v.typing", "v.alleles", alleles.prepared(F.col("v.alleles")).alias("cut")).alias("v"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("locus", "value", "second_allele")]
    parsed = rows.alias("x").join(read.alias("y"), same).select("x.side", "x.key", "x.locus", "x.tier", "y.v")
    cell = F.struct("v.typing", "v.alleles", "tier", "v.cut.least", "v.cut.at")
    wide = parsed.groupBy("side", "key").agg(*[F.max(F.when(F.col("locus") == name, cell)).alias(name) for name in LOCI])
    return source.traits(spark, sf_dir).where(kept).join(wide, ["side", "key"])


def of_side(rows: DataFrame, side: str) -> DataFrame:
    """rows, all of which must be of a side: a ranking around an anchor of the other one would answer another question."""
    name = {"R": "recipient", "D": "donor"}[side]
    wrong = F.raise_error(F.concat(F.lit(f"profile is no {name}: "), F.col("key").cast("string")))
    return rows.where(F.when(F.col("side") == side, True).otherwise(wrong.cast("boolean")))


def mismatch(donor: Column, recipient: Column) -> Column:
    """struct(status, lower, upper, depth): KNOWN, RANGE or UNKNOWN; UNKNOWN carries no numbers."""
    to = F.least(donor["least"], recipient["least"])
    given, had = F.get(donor["at"], to - 1), F.get(recipient["at"], to - 1)
    # A person has at most two distinct alleles; two look-ups build no array for the pair.
    lacking = sum(((F.size(given) > i).cast("int") * (~F.coalesce(F.array_contains(had, F.get(given, F.lit(i))), F.lit(False))).cast("int") for i in range(2)), F.lit(0))
    usable = typed(donor) & typed(recipient)
    known = (donor["typing"] == alleles.BOTH) & (recipient["typing"] == alleles.BOTH)
    upper = F.least(F.lit(2), lacking + (donor["typing"] == alleles.ONE).cast("int"))
    lower = F.least(upper, F.greatest(F.lit(0), lacking - (recipient["typing"] == alleles.ONE).cast("int")))
    lower, upper = F.when(known, lacking).otherwise(lower), F.when(known, lacking).otherwise(upper)
    return F.struct(F.when(~usable, "UNKNOWN").when(known, "KNOWN").otherwise("RANGE").alias("status"), F.when(usable, lower).alias("lower"), F.when(usable, upper).alias("upper"), F.when(usable, to).alias("depth"))


def typed(cell: Column) -> Column:
    return cell["typing"].isin(alleles.ONE, alleles.BOTH)


def presence(donor: Column, recipient: Column) -> Column:
    """-1 where either side is unknown or under review, 1 for a present gene against an absent one, else 0."""
    settled = donor.isin("PRESENT", "ABSENT") & recipient.isin("PRESENT", "ABSENT")
    return F.when(~settled, -1).otherwise(((donor == "PRESENT") & (recipient == "ABSENT")).cast("int"))


def abo_gate(donor: Column, recipient: Column, donor_lab: Column, recipient_lab: Column) -> Column:
    d, r = F.upper(F.trim(donor)), F.upper(F.trim(recipient))
    readable = F.coalesce(d.isin(*DONATES_TO) & r.isin(*DONATES_TO), F.lit(False))
    fits = reduce(lambda x, y: x | y, [(d == group) & r.isin(*to) for group, to in DONATES_TO.items()])
    return F.when(~readable, "UNKNOWN").when(~fits, "INCOMPATIBLE").when(~(donor_lab & recipient_lab), "UNKNOWN").otherwise("COMPATIBLE")


def level(dr: Column, b: Column, a: Column) -> Column:
    """The level for counts at three loci; a null A can't reach the first level, null DR or B reaches none."""
    step = F.when(b <= 1, 0).otherwise(1)
    return F.when(dr.isNull() | b.isNull(), NO_LEVEL).when((dr == 0) & (b == 0) & F.coalesce(a == 0, F.lit(False)), 1).otherwise(2 + 2 * dr + step)


def charge(locus: str, count: Column, dr_matched: Column) -> Column:
    gate = F.lit(GATE_FULL) if locus == "DRB1" else F.when(dr_matched, GATE_FULL).otherwise(GATE_HALF)
    due = F.when(count >= 1, FIRST[locus]).otherwise(0) + F.when(count >= 2, SECOND[locus]).otherwise(0)
    return F.floor(gate * due / 10).cast("int")


def dealt(donors: DataFrame, recipients: DataFrame, parts: int) -> DataFrame:
    """Every donor with every recipient, as rows (r, d): donors are dealt over parts, and recipients meet every part. An equi-join, no nested loop."""
    d = donors.select(F.pmod(F.xxhash64("*"), F.lit(parts)).cast("int").alias("part"), F.struct("*").alias("d"))
    r = recipients.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.struct("*").alias("r"))
    return r.join(d, "part").drop("part")


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every donor with every recipient: for reports on small pools, whose rows are pairs."""
    donors, recipients = (profiles(spark, sf_dir, F.col("side") == side) for side in "DR")
    return dealt(donors, recipients, parts_of(source.table(spark, sf_dir, "supplier").count()))


def parts_of(donors: int) -> int:
    return max(LEAST_PARTS, -(-donors // PART))


def possible_pairs(spark: SparkSession, sf_dir: str, recipient: int | None = None) -> DataFrame:
    """Only pairs whose groups fit: an equi-join on the groups that a donor may give to, no nested loop.

    There are four groups, so the donors of each are dealt over parts of about PART of them, as many as the pool
    needs, and the recipients meet every part. With a recipient's key only that one is read.
    """
    group = F.upper(F.trim("abo"))
    parts = parts_of(source.table(spark, sf_dir, "supplier").count())
    donors = profiles(spark, sf_dir, F.col("side") == "D").withColumn("group", group)
    wanted = (F.col("side") == "R") if recipient is None else (F.col("side") == "R") & (F.col("key") == recipient)
    return fitting(donors, profiles(spark, sf_dir, wanted).withColumn("group", group), parts)


def fitting(donors: DataFrame, recipients: DataFrame, parts: int) -> DataFrame:
    """Rows (r, d) of the donors and recipients whose `group`s fit; donors are dealt over parts by `key`, and recipients meet every part."""
    to = F.create_map(*[x for g, t in DONATES_TO.items() for x in (F.lit(g), F.array(*map(F.lit, t)))])
    donors = donors.where(F.col("group").isin(*DONATES_TO))
    donors = donors.select(F.explode(to[F.col("group")]).alias("target"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.struct("*").alias("d"))
    recipients = recipients.select(F.col("group").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.struct("*").alias("r"))
    recipients = recipients.repartition(4 * parts, "target", "part")  # few rows make many pairs: AQE must not put them together
    return recipients.join(donors, ["target", "part"]).drop("target", "part")


def bucket(eligible: Column, positive: Column, dsa: Column, gate: Column, readable: Column, typed_enough: Column) -> Column:
    """The number in BUCKETS: the first reason that holds, from the strongest."""
    return F.when(~eligible, 7).when(positive, 6).when(dsa, 5).when(gate == "INCOMPATIBLE", 4).when(~readable, 3).when(~typed_enough, 2).when(gate == "UNKNOWN", 1).otherwise(0)


def readable_groups(donor: Column, recipient: Column) -> Column:
    return F.coalesce(F.upper(F.trim(donor)).isin(*DONATES_TO) & F.upper(F.trim(recipient)).isin(*DONATES_TO), F.lit(False))


GATE_TRAITS = ("abo", "lab", "eligible", "positive", "dsa", "sufficient")


def gate_classes(spark: SparkSession, sf_dir: str, side: str, *more: str) -> DataFrame:
    """How many persons of a side share what the gates look at (GATE_TRAITS): a few hundred classes, whatever the pool."""
    everyone = profiles(spark, sf_dir, F.col("side") == side)
    traits = everyone.select("key", "abo", "lab", "eligible", (F.col("crossmatch") == "POSITIVE").alias("positive"), "dsa", (typed(F.col("DRB1")) & typed(F.col("B"))).alias("sufficient"))
    return traits.groupBy(*GATE_TRAITS, *more).agg(F.count("*").alias("n"))


def gated_classes(donors: DataFrame, recipients: DataFrame) -> DataFrame:
    """abo_gate and bucket of each class of donors with each class of recipients, and the pairs that they stand for."""
    d, r = F.col("d"), F.col("r")
    met = dealt(donors, recipients, LEAST_PARTS)
    gate = abo_gate(d["abo"], r["abo"], d["lab"], r["lab"])
    found = bucket(d["eligible"] & r["eligible"], d["positive"] | r["positive"], r["dsa"], gate, readable_groups(d["abo"], r["abo"]), d["sufficient"] & r["sufficient"])
    return met.select("d", "r", gate.alias("abo_gate"), found.alias("bucket"), (d["n"] * r["n"]).alias("pairs"))


def scored(pairs: DataFrame, compared: Callable[[str], Column] | None = None) -> DataFrame:
    """Vectors, bucket, level, penalties and the sort key's columns (but the tiebreak) for rows of (d, r). compared: the mismatch at a locus, if it is known already."""
    d, r = F.col("d"), F.col("r")
    vector = pairs.select("d", "r", *[(compared(x) if compared else mismatch(d[x], r[x])).alias(f"mm_{x}") for x in LOCI], *[presence(d[g], r[g]).alias(f"pr_{g}") for g in PRESENCE], abo_gate(d["abo"], r["abo"], d["lab"], r["lab"]).alias("abo_gate"))
    up = {x: F.col(f"mm_{x}.upper") for x in LOCI}
    low = {x: F.col(f"mm_{x}.lower") for x in LOCI}
    dr_matched = F.coalesce(up["DRB1"] == 0, F.lit(False))
    found = bucket(
        d["eligible"] & r["eligible"],
        (d["crossmatch"] == "POSITIVE") | (r["crossmatch"] == "POSITIVE"),
        r["dsa"],
        F.col("abo_gate"),
        readable_groups(d["abo"], r["abo"]),
        up["DRB1"].isNotNull() & up["B"].isNotNull(),
    )
    open_genes = sum(((F.col(f"pr_{g}") != 0).cast("int") for g in PRESENCE), F.lit(0))
    gate = F.when(dr_matched, GATE_FULL).otherwise(GATE_HALF)
    penalty = sum((charge(x, F.coalesce(up[x], F.lit(UNKNOWN_AS)), dr_matched) for x in SCORED), F.lit(0)) + F.floor(gate * PRESENCE_CHARGE * open_genes / 10).cast("int")
    cost = lambda cell: F.when(cell["tier"] == "A", TIER_COST["A"]).when(cell["tier"] == "B", TIER_COST["B"]).otherwise(TIER_COST["C"])
    evidence = sum((F.when(up[x].isNull(), UNKNOWN_COST).otherwise(cost(d[x]) + cost(r[x])) for x in SCORED), F.lit(0))
    unknown = sum((up[x].isNull().cast("int") for x in LOCI), F.lit(0)) + sum(((F.col(f"pr_{g}") == -1).cast("int") for g in PRESENCE), F.lit(0))
    partial = sum(((F.col(f"mm_{x}.status") == "RANGE").cast("int") for x in LOCI), F.lit(0))
    return vector.select(
        "*",
        found.alias("bucket"),
        level(up["DRB1"], up["B"], up["A"]).alias("level"),
        level(low["DRB1"], low["B"], low["A"]).alias("best_level"),
        F.when(F.coalesce(up["DQB1"] == 0, F.lit(False)), 0).otherwise(1).alias("dq"),
        penalty.alias("penalty"),
        evidence.alias("evidence"),
        unknown.alias("unknown"),
        partial.alias("partial"),
    )


#: Candidates that an anchor takes at a time.
CHUNK = 1024
SORT_KEY = ("bucket", "level", "dq", "penalty", "evidence", "unknown", "partial", "tiebreak")


def ranked(pairs: DataFrame, k: int, anchor: str = "r") -> DataFrame:
    """The first k candidates of each anchor among the ranked buckets; blocked pairs never appear.

    The hash that breaks ties is made only for pairs that are among the first k without it.
    """
    candidate = "d" if anchor == "r" else "r"
    keep = scored(pairs).where(F.col("bucket") <= 1).select(F.col(anchor)["key"].alias("anchor"), F.col(candidate)["key"].alias("candidate"), *SORT_KEY[:-1])
    near = keep.withColumn("near", F.rank().over(W.partitionBy("anchor").orderBy(*SORT_KEY[:-1]))).where(F.col("near") <= k).drop("near")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(*SORT_KEY))
    return near.withColumn("tiebreak", tiebreak(F.col("anchor"), F.col("candidate"))).withColumn("place", place).where(F.col("place") <= k)


#: What a ranked pair's level looks at, what its penalty looks at besides, and what its place looks at besides.
LEVEL_CLASS = ("group", "DRB1", "B", "A")
PENALTY_CLASS = (*LEVEL_CLASS, "C", "DQB1", *PRESENCE)
PLACE_CLASS = (*PENALTY_CLASS, "lab")


def rankable(spark: SparkSession, sf_dir: str, side: str, evidence: bool = True) -> DataFrame:
    """The persons of a side who may stand in a ranked bucket, with what differs without a difference made equal: key, the columns of PLACE_CLASS, `same_alleles`.

    What two persons cannot be told apart by is dropped: the order of alleles, why a cell or a gene is unknown, its tier then, and without evidence every tier.
    """
    rows = profiles(spark, sf_dir, F.col("side") == side)

    def plain(x: str) -> Column:
        known = typed(F.col(x))
        tier = F.when(known & F.col(x)["tier"].isin("A", "B"), F.col(x)["tier"]).otherwise("C") if evidence else F.lit("C")
        at = F.when(known, F.transform(F.col(x)["at"], lambda cut: F.array_sort(cut))).otherwise(F.array().cast("array<array<string>>"))
        return F.struct(F.when(known, F.col(x)["typing"]).otherwise(alleles.ABSENT).alias("typing"), tier.alias("tier"), F.when(known, F.col(x)["least"]).alias("least"), at.alias("at"), F.array().cast("array<string>").alias("alleles"))

    # A trait that is null bars nobody, as in bucket().
    barred = ~F.coalesce("eligible", F.lit(True)) | F.coalesce(F.col("crossmatch") == "POSITIVE", F.lit(False))
    if side == "R":
        barred = barred | F.coalesce("dsa", F.lit(False))
    group = F.upper(F.trim("abo"))
    genes = [F.when(F.col(g).isin("PRESENT", "ABSENT"), F.col(g)).otherwise("UNKNOWN").alias(g) for g in PRESENCE]
    rows = rows.where(~barred & F.coalesce(group.isin(*DONATES_TO), F.lit(False)) & typed(F.col("DRB1")) & typed(F.col("B")))
    return rows.select("key", group.alias("group"), F.coalesce("lab", F.lit(True)).alias("lab"), *genes, *[plain(x).alias(x) for x in LOCI], same_alleles(F.struct(*LOCI)).alias("same_alleles"))


def classes(people: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """Persons of rankable() by the columns `of`: the least key and the number n of each class; the other columns hold what tells nothing."""
    unknown = F.struct(F.lit(alleles.ABSENT).alias("typing"), F.lit("C").alias("tier"), F.lit(None).cast("int").alias("least"), F.array().cast("array<array<string>>").alias("at"), F.array().cast("array<string>").alias("alleles"))
    fill = {"lab": F.lit(True)} | {g: F.lit("UNKNOWN") for g in PRESENCE} | {x: unknown for x in LOCI}
    rows = people.groupBy(*of).agg(F.min("key").alias("key"), F.count("*").alias("n"))
    rows = rows.withColumns({c: v for c, v in fill.items() if c not in of})
    return rows.withColumns({"abo": F.col("group"), "eligible": F.lit(True), "crossmatch": F.lit("NOT_PERFORMED"), "dsa": F.lit(False)})


def scored_classes(donors: DataFrame, recipients: DataFrame, parts: int) -> DataFrame:
    """scored() rows in ranked buckets for classes() of donors and of recipients; d and r hold key, n, traits and tiers.

    There are far fewer cells than classes. The cells of a locus meet once; a recipient's class carries what comes of it for
    each of the donors' cells, by number, and a pair of classes looks up one byte for each locus.
    """
    cell = lambda x: F.struct(*[F.col(x)[f] for f in ("typing", "least", "at")])
    cells = lambda rows, name: rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("locus"), cell(x).alias(name)) for x in LOCI])).alias("c")).select("c.*").distinct()
    numbered = written(cells(donors, "dc").withColumn("i", F.row_number().over(W.partitionBy("locus").orderBy("dc")) - 1))
    found = cells(recipients, "rc").join(numbered, "locus").select("locus", "rc", "i", mismatch(F.col("dc"), F.col("rc")).alias("m"))
    packed = F.when(F.col("m.status") == "UNKNOWN", 0).otherwise(1 + F.col("m.upper") + 4 * F.col("m.lower") + F.when(F.col("m.status") == "RANGE", 16).otherwise(0)).cast("byte")
    row = F.transform(F.array_sort(F.collect_list(F.struct("i", packed.alias("p")))), lambda x: x["p"])
    looked = written(found.groupBy("locus", "rc").agg(row.alias("to")))

    def slim(rows: DataFrame, known: DataFrame, name: str, value: str) -> DataFrame:
        for x in LOCI:
            at = known.where(F.col("locus") == x).select(F.col(name).alias("cell"), F.col(value).alias(f"{value}_{x}"))
            rows = rows.withColumn("cell", cell(x)).join(at, "cell").drop("cell").withColumn(x, F.struct(F.col(x)["tier"].alias("tier")))
        return rows

    met = fitting(slim(donors, numbered, "dc", "i"), slim(recipients, looked, "rc", "to"), 4 * parts)
    met = met.select("d", "r", *[F.get(F.col("r")[f"to_{x}"], F.col("d")[f"i_{x}"]).cast("int").alias(f"at_{x}") for x in LOCI])

    def unpacked(x: str) -> Column:
        p = F.col(f"at_{x}")
        number = lambda low: F.when(p > 0, F.call_function("shiftright", p - 1, F.lit(low)).bitwiseAND(F.lit(3)))
        return F.struct(F.when(p == 0, "UNKNOWN").when(p <= 16, "KNOWN").otherwise("RANGE").alias("status"), number(2).alias("lower"), number(0).alias("upper"))

    return scored(met, unpacked).where("bucket <= 1")


def ranked_classes(spark: SparkSession, sf_dir: str, of: tuple[str, ...]) -> DataFrame:
    """scored_classes() of the whole pool by the columns `of`, without evidence: pairs are d.n * r.n."""
    donors, recipients = (written(classes(rankable(spark, sf_dir, side, evidence=False), of)) for side in "DR")
    return scored_classes(donors, recipients, parts_of(donors.count()))


def ranked_by_class(spark: SparkSession, sf_dir: str, k: int, anchor: str = "r") -> tuple[DataFrame, DataFrame]:
    """ranked() of the whole pool without a row for every pair: classes of persons meet, and only the first of them become persons again.

    A class of candidates stays if fewer than k persons stand before it, so the first k are among those that stay, with
    all that tie. Second, an explained() row for each pair of classes that stays, under the columns `anchor_class`,
    `candidate_class`, which the first has, too. Ties are all hashed: a class that is most of the pool costs a hash for each of its pairs.
    """
    kinds, members = {}, {}
    for name, side in (("d", "D"), ("r", "R")):
        people = written(rankable(spark, sf_dir, side))
        kinds[name] = written(classes(people, PLACE_CLASS))
        members[name] = people.join(kinds[name].select(*PLACE_CLASS, F.col("key").alias("class")), [*PLACE_CLASS]).select("key", "class", "same_alleles")
    candidate = "d" if anchor == "r" else "r"
    order = SORT_KEY[:-1]
    pairs = scored_classes(kinds["d"], kinds["r"], parts_of(kinds["d"].count())).select(F.col(anchor)["key"].alias("anchor_class"), F.col(candidate)["key"].alias("candidate_class"), F.col(candidate)["n"].alias("n"), *order)
    # Every class has a person, so at most k classes, with ties, hold the first k.
    near = pairs.withColumn("near", F.rank().over(W.partitionBy("anchor_class").orderBy(*order))).where(F.col("near") <= k).drop("near")
    before = F.sum("n").over(W.partitionBy("anchor_class").orderBy(*order)) - F.sum("n").over(W.partitionBy("anchor_class", *order))
    near = written(near.withColumn("before", before).where(F.col("before") < k).drop("before"))
    # An anchor takes its candidates in lists of some CHUNK, hashes them and keeps k of each; only those travel.
    lists = F.ceil(F.sum("n").over(W.partitionBy("anchor_class")) / CHUNK)
    listed = near.withColumn("lists", lists).join(members[candidate].select(F.col("class").alias("candidate_class"), F.col("key").alias("candidate")), "candidate_class")
    listed = listed.groupBy("anchor_class", F.pmod(F.xxhash64("candidate"), "lists").alias("list")).agg(F.collect_list(F.struct(*order, "candidate", "candidate_class")).alias("c"))
    anchors = members[anchor].select(F.col("class").alias("anchor_class"), F.col("key").alias("anchor"), *(["same_alleles"] if anchor == "r" else []))
    met = anchors.join(listed, "anchor_class")
    tied = F.transform("c", lambda x: F.struct(*[x[c].alias(c) for c in order], tiebreak(F.col("anchor"), x["candidate"]).alias("tiebreak"), x["candidate"].alias("candidate"), x["candidate_class"].alias("candidate_class")))
    best = met.select(*anchors.columns, F.explode(F.slice(F.sort_array(tied), 1, k)).alias("c")).select(*anchors.columns, "c.*")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(*SORT_KEY))
    first = best.withColumn("place", place).where(F.col("place") <= k)
    ids = {anchor: "anchor_class", candidate: "candidate_class"}
    both = near.select("anchor_class", "candidate_class")
    for name in "dr":
        both = both.join(kinds[name].select(F.col("key").alias(ids[name]), F.struct("*").alias(name)), ids[name])
    told = explained(scored(both.select("d", "r"))).withColumnsRenamed({"donor": ids["d"], "recipient": ids["r"]})
    return first, told.drop("same_alleles")


def tiebreak(anchor: Column, candidate: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(POLICY), anchor.cast("string"), candidate.cast("string")), 256)

#: What comes next for each bucket, in their order.
NEXT_ACTION = ("proceed to clinical evaluation", "obtain a laboratory blood group", "obtain HLA typing", "obtain a laboratory blood group", "not a candidate on the direct pathway", "laboratory review", "direct pathway blocked", "none")


def same_alleles(person: Column) -> Column:
    """The loci, comma-joined, of which a person has one allele twice."""
    return F.concat_ws(",", *[F.when((person[x]["typing"] == alleles.BOTH) & (F.size(F.array_distinct(person[x]["alleles"])) == 1), x) for x in ("DRB1", "DQB1", "A", "B")])


def explained(rows: DataFrame) -> DataFrame:
    """An explanation for each scored pair, from the columns that the order uses and nothing else."""
    d, r = F.col("d"), F.col("r")
    cell = lambda x: F.concat(F.lit(f"{x}="), F.col(f"mm_{x}.status"), F.coalesce(F.concat(F.lit("["), F.col(f"mm_{x}.lower").cast("string"), F.lit("-"), F.col(f"mm_{x}.upper").cast("string"), F.lit("]")), F.lit("")))
    blockers = F.concat_ws(
        ",",
        F.when(~(d["eligible"] & r["eligible"]), "eligibility"),
        F.when((d["crossmatch"] == "POSITIVE") | (r["crossmatch"] == "POSITIVE"), "crossmatch"),
        F.when(r["dsa"], "dsa"),
        F.when(F.col("abo_gate") == "INCOMPATIBLE", "abo"),
    )
    action = F.element_at(F.array(*map(F.lit, NEXT_ACTION)), F.col("bucket") + 1)
    unreachable = F.when((F.col("level") != 1) & (F.col("mm_DRB1.upper") == 0) & (F.col("mm_B.upper") == 0), F.coalesce(F.concat(F.col("mm_A.upper").cast("string"), F.lit(" mismatches at A")), F.lit("A unknown")))
    return rows.select(
        d["key"].alias("donor"),
        r["key"].alias("recipient"),
        "bucket",
        F.concat_ws(";", *[cell(x) for x in LOCI]).alias("mismatches"),
        F.when(F.col("bucket") >= 4, blockers).otherwise("").alias("blockers"),
        F.coalesce(unreachable, F.lit("")).alias("first_level_unreachable"),
        same_alleles(r).alias("same_alleles"),
        action.alias("next_action"),
        F.concat_ws(",", *[F.when(F.col(f"mm_{x}.upper").isNull(), x) for x in LOCI], *[F.when(F.col(f"pr_{g}") == -1, g) for g in PRESENCE]).alias("unknown_loci"),
        F.concat_ws(",", *[F.when(F.col(f"mm_{x}.status") == "RANGE", x) for x in LOCI]).alias("partial_loci"),
    )
