"""Column expressions over stored locus values: tokens, typing, canonical alleles, depth, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT, ONE, BOTH, REVIEW = "ABSENT", "ONE", "BOTH", "REVIEW_REQUIRED"


def tokens(value: Column) -> Column:
    """Allele tokens: what stands between commas, semicolons, slashes, pluses and white space."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"[,;/+\s]+"), lambda t: t != "")


def _starred(token: Column) -> Column:
    return F.instr(token, "*") > 0


def locus_value(value: Column, flag: Column, locus: Column) -> Column:
    """struct(typing, alleles): how far a stored value types its locus.

    First matching line: nothing read -> ABSENT; more than two tokens, another locus's prefix, or a
    flag that the token count contradicts -> REVIEW_REQUIRED; two tokens -> BOTH; else ONE. One
    allele never stands for two.
    """
    found = tokens(value)
    n = F.size(found)
    mark = F.upper(F.trim(F.coalesce(flag, F.lit(""))))
    foreign = F.exists(found, lambda t: _starred(t) & (F.upper(F.substring_index(t, "*", 1)) != F.upper(locus)))
    typing = (
        F.when(n == 0, ABSENT)
        .when(n > 2, REVIEW)
        .when((locus != "") & foreign, REVIEW)
        .when((mark == "READ") & (n != 2), REVIEW)
        .when((mark == "UNREAD") & (n == 2), REVIEW)
        .when(n == 2, BOTH)
        .otherwise(ONE)
    )
    named = F.transform(found, lambda t: F.when(locus == "", t).when(_starred(t), F.concat(F.upper(locus), F.substring(t, F.instr(t, "*"), F.length(t)))).otherwise(F.concat(F.upper(locus), F.lit("*"), t)))
    return F.struct(typing.alias("typing"), F.when(typing.isin(ONE, BOTH), named).otherwise(F.array().cast("array<string>")).alias("alleles"))


def _body(allele: Column) -> Column:
    return F.when(_starred(allele), F.substring(allele, F.instr(allele, "*") + 1, F.length(allele))).otherwise(allele)


def depth(allele: Column) -> Column:
    """Fields of an allele name: the non-empty parts between colons."""
    return F.regexp_count(_body(allele), F.lit("[^:]+"))


def truncate(allele: Column, to: int) -> Column:
    """The first `to` fields; what is cut to a single field loses its expression suffix."""
    head = F.regexp_extract(_body(allele), f"^:*([^:]+(?::+[^:]+){{0,{to - 1}}})", 1)
    short = F.when(depth(allele) > to, F.regexp_replace(head, "[NQLSCA]$", "")).otherwise(head) if to == 1 else head
    return F.when(_starred(allele), F.concat(F.substring_index(allele, "*", 1), F.lit("*"), short)).otherwise(short)


#: No allele name has more fields.
MOST_FIELDS = 4


def prepared(alleles: Column) -> Column:
    """struct(least, at): the least depth of the alleles, and the distinct alleles cut to 1, 2, ... fields.

    Made once for each person, so that a pair only picks and compares two arrays.
    """

    def cut(to: int) -> Column:
        return F.array_distinct(F.transform(alleles, lambda a: truncate(a, to)))

    cuts = [cut(n) for n in range(1, MOST_FIELDS + 1)]
    return F.struct(F.array_min(F.transform(alleles, depth)).alias("least"), F.array(*cuts).alias("at"))


def normalise_reported(value: Column, locus: Column) -> Column:
    """A reported allele in canonical form, or null where the strict grammar refuses it (it goes to review)."""
    text = F.regexp_replace(F.upper(F.trim(value)), r"\s+", "")
    named = F.when(text.startswith("*"), F.concat(F.upper(locus), text)).otherwise(text)
    return F.when(named.rlike(r"^[A-Z]+[0-9]*\*[0-9]{2,3}(:[0-9]{2,3}){0,3}[NQLSCA]?$"), named)
