"""Text readers as column expressions: captions, identifiers, contacts, stamps, masks, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a donor, a recipient, a request, and a blood group.
DONOR_WORDS, RECIPIENT_WORDS = "اهدا|فروش|donor", "گیرنده|بیمار|recipient"
REQUEST_WORDS, BLOOD_WORDS = "نیازمند|میخواهم|wanted", "گروه خونی|blood"
#: Characters after a blood word within which a bare group counts.
REACH = 24


def script_normal(text: Column) -> Column:
    """Arabic letters as Persian ones, without joiners, elongation and vowel marks."""
    return F.regexp_replace(F.translate(text, "يكى", "یکی"), "[‌ـً-ْ]", "")


def caption_role(text: Column) -> Column:
    """struct(tier, role): blank -> NONE; both words -> REFUSED; neither -> NONE; a request -> REFUSED; else STATEMENT."""
    t = F.lower(script_normal(F.coalesce(text, F.lit(""))))
    donor, recipient = t.rlike(DONOR_WORDS), t.rlike(RECIPIENT_WORDS)
    tier = F.when(F.trim(t) == "", "NONE").when(donor & recipient, "REFUSED").when(~donor & ~recipient, "NONE").when(t.rlike(REQUEST_WORDS), "REFUSED").otherwise("STATEMENT")
    return F.struct(tier.alias("tier"), F.when(tier == "STATEMENT", F.when(donor, "DONOR").otherwise("RECIPIENT")).alias("role"))


def caption_group(text: Column) -> Column:
    """struct(tier, blood_group, rh): signed groups anywhere, bare ones close behind a blood word; more than one group or sign refuses."""
    t = script_normal(F.coalesce(text, F.lit("")))
    signed = F.regexp_extract_all(t, F.lit(r"(?:^|[^A-Za-z])((?:AB|A|B|O)[+-])"), F.lit(1))
    bare = F.regexp_extract_all(t, F.lit(rf"(?:{BLOOD_WORDS})[^+-]{{0,{REACH - 2}}}?(?:[^A-Za-z])(AB|A|B|O)(?:[^A-Za-z+-]|$)"), F.lit(1))
    groups = F.array_sort(F.array_distinct(F.concat(F.transform(signed, lambda x: F.regexp_replace(x, "[+-]", "")), bare)))
    signs = F.array_distinct(F.transform(signed, lambda x: F.right(x, F.lit(1))))
    tier = F.when(F.size(groups) == 0, "NONE").when((F.size(groups) > 1) | (F.size(signs) > 1), "REFUSED").when(t.rlike(REQUEST_WORDS), "REFUSED").otherwise("STATEMENT")
    return F.struct(tier.alias("tier"), F.when(tier == "STATEMENT", F.get(groups, F.lit(0))).alias("blood_group"), F.when(tier == "STATEMENT", F.get(signs, F.lit(0))).alias("rh"))


def valid_id(digits: Column) -> Column:
    """A ten-digit identifier whose last digit checks by weights modulo 11; placeholders of few distinct digits don't count."""
    places = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (11 - i))
    rest = F.aggregate(places, F.lit(0), lambda a, b: a + b) % 11
    check = F.substring(digits, 10, 1).cast("int")
    variety = F.size(F.array_distinct(F.split(digits, "")))
    return (F.length(digits) == 10) & (variety >= 3) & F.when(rest < 2, check == rest).otherwise(check == 11 - rest)


def shape_mask(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[A-Za-z]", "L"), "[0-9]", "d")


def redacted(text: Column) -> Column:
    """Two characters kept at either end, the middle starred; short strings are starred whole."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))


def stamp(text: Column) -> Column:
    """struct(at, offset_minutes): a day-first stamp with an optional UTC offset; without one the time is naive."""
    part = F.regexp_extract(text, r"^(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2})", 1)
    sign, hours, minutes = (F.regexp_extract(text, r"UTC([+-])(\d{2}):(\d{2})$", i) for i in (1, 2, 3))
    offset = F.when(sign != "", F.when(sign == "-", -1).otherwise(1) * (F.try_to_number(F.when(hours != "", hours).otherwise("00"), F.lit("99")) * 60 + F.try_to_number(F.when(minutes != "", minutes).otherwise("00"), F.lit("99"))))
    return F.struct(F.try_to_timestamp(F.when(part != "", part), F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz").alias("at"), offset.cast("int").alias("offset_minutes"))


def fingerprint(text: Column, least: int = 4) -> Column:
    """The sorted distinct allele tokens of a text, if there are enough of them."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"((?:A|B|C|DRB1|DQB1)\*[0-9]{2})"), F.lit(1))))
    return F.when(F.size(found) >= least, F.array_join(found, "|"))


def salted_hash(text: Column, salt: str) -> Column:
    """A salted digest of a name, blanks and case apart; an empty salt is an error."""
    if not salt:
        raise ValueError("the salt is empty")
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))), 256), 1, 32)


def links(html: Column) -> Column:
    """Distinct targets of links in a page."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="((?:https?://|tel:|/)[^"]*)"'), F.lit(1))))
