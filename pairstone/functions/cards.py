"""Decision cards as ordered conditions: the first line that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gene that goes with each DRB1 family; families without an entry go with none.
GENE_OF_FAMILY = {"03": "DRB3", "11": "DRB3", "12": "DRB3", "13": "DRB3", "14": "DRB3", "04": "DRB4", "07": "DRB4", "09": "DRB4", "15": "DRB5", "16": "DRB5"}
GROUPS = ("O", "A", "B", "AB")


def drb_consistency(families: Column, present: Column, absent: Column) -> Column:
    """CONSISTENT, FORBIDDEN_GENE_PRESENT, EXPECTED_GENE_ABSENT or NOT_CHECKABLE.

    families: the first fields read at DRB1 (one or two); present and absent: genes called so.
    One family leaves room for the other allele's gene, two leave none.
    """
    gene = F.create_map(*[F.lit(x) for pair in GENE_OF_FAMILY.items() for x in pair])
    expected = F.array_compact(F.array_distinct(F.transform(families, lambda f: gene[f])))
    extra = F.size(F.array_except(present, expected)) > 0
    missing = F.arrays_overlap(expected, absent)
    one = F.size(families) == 1
    return (
        F.when((F.size(families) == 0) | (F.size(F.concat(present, absent)) == 0), "NOT_CHECKABLE")
        .when(one & (F.size(present) >= 2) & ~F.arrays_overlap(present, expected), "FORBIDDEN_GENE_PRESENT")
        .when(~one & extra, "FORBIDDEN_GENE_PRESENT")
        .when(missing, "EXPECTED_GENE_ABSENT")
        .otherwise("CONSISTENT")
    )


def reconcile_group(image: Column, image_sign: Column, captions: Column, sign: Column, rescued: Column, boxes: Column, disclaimed: Column) -> Column:
    """struct(state, value, agreed, independent): a printed blood group against what the messages say.

    captions: the distinct groups that they state. A printed group that they contradict is a conflict, never a choice.
    """
    said = F.when(F.size(captions) == 1, F.get(captions, F.lit(0)))
    clash = said.isNotNull() & ((said != image) | ((said == image) & F.coalesce(sign != image_sign, F.lit(False))))
    agreed = image.isNotNull() & F.coalesce(said == image, F.lit(False)) & ~F.coalesce(sign != image_sign, F.lit(False))
    state = (
        F.when(image.isNotNull() & clash, "CONFLICT")
        .when(image.isNotNull() & rescued & (boxes < 2) & said.isNull(), "REVIEW_REQUIRED")
        .when(image.isNotNull(), "RESOLVED")
        .when(said.isNotNull(), "CAPTION_CLAIM")
        .otherwise("UNKNOWN")
    )
    value = F.when(state == "RESOLVED", image).when(state == "CAPTION_CLAIM", said)
    return F.struct(state.alias("state"), value.alias("value"), agreed.alias("agreed"), (agreed & ~disclaimed).alias("independent"))


def role_decision(in_review: Column, form: Column, tier: Column, recipient_test: Column, caption: Column, sender: Column) -> Column:
    """struct(state, role, rule): the printed form first, then tests, captions and the sender as proposals only."""
    known = form.isNotNull()
    agrees = F.coalesce(caption == form, F.lit(False))
    return F.struct(
        F.when(in_review, "review").when(known & (form == "DONOR") & recipient_test, "review").when(known & caption.isNotNull() & ~agrees, "review").when(known, "finding").when(recipient_test | caption.isNotNull() | sender.isNotNull(), "proposal").otherwise("none").alias("state"),
        F.when(in_review, None).when(known, form).when(recipient_test, "RECIPIENT").otherwise(F.coalesce(caption, sender)).alias("role"),
        F.when(in_review, "FORM_REVIEW").when(known & (form == "DONOR") & recipient_test, "TEST").when(known & caption.isNotNull() & ~agrees, "CAPTION_VETO").when(known & (tier == "STRONG"), "FORM").when(known & agrees, "FORM+CAPTION").when(known, "BARE").when(recipient_test, "TEST").when(caption.isNotNull(), "CAPTION").when(sender.isNotNull(), "SENDER").otherwise("NONE").alias("rule"),
    )


def confirmation(accepted: Column, reading: Column, locus: Column, covered: Column) -> Column:
    """CONFIRMED, CONTRADICTED or UNCONFIRMED from an independent reading: comma-joined first fields, perhaps with genes."""
    tokens = F.filter(F.split(F.coalesce(reading, F.lit("")), r"[,;/+\s]+"), lambda t: t != "")
    other = F.exists(tokens, lambda t: (F.instr(t, "*") > 0) & (F.substring_index(t, "*", 1) != locus))
    first = lambda a: F.array_sort(F.transform(a, lambda t: F.substring_index(F.substring_index(t, "*", -1), ":", 1)))
    usable = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"^(?:[A-Z0-9]+\*)?[0-9]{2}")))
    own = first(F.split(accepted, ","))
    return F.when(~covered, "UNCONFIRMED").when(other, "CONTRADICTED").when(F.size(usable) == 0, "UNCONFIRMED").when(own == first(usable), "CONFIRMED").otherwise("CONTRADICTED")


def stability(votes: Column) -> Column:
    """UNANIMOUS, SPLIT, DIGITS_LOST or ILLEGIBLE from the readings of one box under small shifts; nulls are unread shifts."""
    read = F.array_compact(votes)
    kinds = F.array_distinct(read)
    digits = F.array_distinct(F.transform(kinds, lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))))
    return F.when(F.size(read) == 0, "ILLEGIBLE").when(F.size(digits) > 1, "DIGITS_LOST").when(F.size(kinds) == 1, "UNANIMOUS").otherwise("SPLIT")


def page_tilt(horizontals: Column, verticals: Column, mad: Column, agreement: Column, rulings: Column, sweep: Column, ratio: Column) -> Column:
    """STRAIGHT, ROTATE or UNCERTAIN: two estimators have to be sure and agree before a page is turned."""
    doubt = (horizontals < 6) | (mad > 1.5) | (agreement < 0.7) | ((verticals >= 3 * horizontals) & (verticals >= 12)) | sweep.isNull() | (ratio < 3) | (F.abs(sweep - rulings) > 2)
    return F.when(F.coalesce(doubt, F.lit(True)), "UNCERTAIN").when(F.abs(rulings) < 0.5, "STRAIGHT").otherwise("ROTATE")


def crossmatch_worst(states: Column) -> Column:
    """The gravest of several crossmatch states."""
    order = ["NEGATIVE", "NOT_PERFORMED", "EXPIRED", "INDETERMINATE", "POSITIVE"]
    rank = lambda s: F.array_position(F.array(*map(F.lit, order)), s)
    return F.when(F.size(states) == 0, "NOT_PERFORMED").otherwise(F.element_at(F.array(*map(F.lit, order)), F.array_max(F.transform(states, rank)).cast("int")))


def provenance_class(source: Column) -> Column:
    return F.when(source == "LABORATORY_PRINTED", "LABORATORY_MEASURED").when(source.isin("PATIENT_REPORTED_ON_FORM", "CAPTION_CLAIM"), source).otherwise("UNKNOWN")


def toman(rial: Column) -> Column:
    """A sum in rial as toman; negative sums are errors, not data."""
    return F.when(rial < 0, F.raise_error(F.lit("a sum can't be negative"))).otherwise((rial / 10).cast("long"))
