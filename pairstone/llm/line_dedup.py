"""Line dedup by overlapping windows of three lines.

Each window of three consecutive lines is hashed to 128 bits. A window that occurs more than once
in the whole table, in whichever documents, is kept where it occurs first, by doc_id and then by
place; at all later occurrences its three positions are covered. Positions that are covered by any
window go, so a long repeated passage goes in one piece. Windows without any word are no windows.

Lines are what stands between line feeds, compared as they are. Documents of fewer than three
lines are left alone, empty ones, too; null counts as the empty text. Of occurrences in rows of one doc_id (a tie) the
one in the text with the smaller hash, then the earlier one stays; all null doc_ids are one id, after all others. Rows
repeated with one doc_id and text stand or fall together. An empty table gives no rows. Other columns, whatever their names,
are carried along. A text is held whole by one task, with three small values for each of its lines. No text is gathered anywhere: only
windows are exchanged, and a window's first occurrence is found by a pre-aggregated minimum, so a
passage that a third of the documents share meets in one place as partial minima only. The join
back to the occurrences has a plain exchange on either side, which AQE splits where it is skewed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.llm.runtime import own_name, prepare

WINDOW = 3
_LAST_ID = (1 << 63) - 1


@dataclass
class Names:
    """The operator's own columns, under names that the table doesn't have."""

    id: str
    text: str
    lines: str
    gone: str

    @staticmethod
    def beside(docs: DataFrame) -> Names:
        return Names(*(own_name(docs, f"_ps_{x}") for x in ("id", "text", "lines", "gone")))


def _rows(docs: DataFrame, own: Names) -> DataFrame:
    """Every column of docs, then the operator's own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias(own.id), F.xxhash64(text).alias(own.text), F.split(text, "\n").alias(own.lines))


def _windows(hashes: str) -> Column:
    """(place, 128-bit hash) of each window of hashed lines that has a word."""
    line = F.col(hashes)
    at = F.sequence(F.lit(0), F.size(line) - WINDOW)

    def window(i: Column) -> Column:
        part = [line[i + k] for k in range(WINDOW)]
        return F.struct(
            i.alias("place"),
            F.struct(F.xxhash64(*[x["h1"] for x in part]).alias("h1"), F.xxhash64(*[x["h2"] for x in part]).alias("h2")).alias("window"),
            (part[0]["word"] | part[1]["word"] | part[2]["word"]).alias("word"),
        )

    return F.filter(F.transform(at, window), lambda x: x["word"])


def covered_places(docs: DataFrame) -> DataFrame:
    """(id, text, places): the first lines of windows that occurred before, for documents that have any."""
    rows = _rows(docs.select("doc_id", "text"), Names("id", "key", "lines", ""))
    hashes = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(WINDOW)).alias("h2"), F.rlike(x, F.lit(r"\S")).alias("word")))
    found = (
        rows.where(F.size("lines") >= WINDOW)
        .select("id", "key", hashes.alias("hashes"))
        .select("id", "key", F.explode(_windows("hashes")).alias("w"))
        .select("id", "key", F.col("w.place").alias("place"), F.col("w.window").alias("window"))
    )
    here = F.struct("id", "key", "place")
    first = (
        found.groupBy(F.col("window.h1").alias("h1"), F.col("window.h2").alias("h2"))
        .agg(F.min(here).alias("first"), F.max(here).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select(F.struct("h1", "h2").alias("window"), "first")
    )
    again = found.join(first.hint("merge"), "window").where(here != F.col("first"))
    return again.groupBy("id", "key").agg(F.collect_set("place").alias("places"))


def mark_lines(docs: DataFrame, own: Names) -> DataFrame:
    """docs with the lines of each text, and the sorted numbers of the lines that go."""
    prepare(docs.sparkSession)
    places = covered_places(docs).select(F.col("id").alias(own.id), F.col("key").alias(own.text), F.col("places").alias(own.gone))
    around = F.flatten(F.transform(own.gone, lambda p: F.array(*[p + k for k in range(WINDOW)])))
    gone = F.coalesce(F.array_sort(F.array_distinct(around)), F.array().cast("array<int>"))
    return _rows(docs, own).join(places, [own.id, own.text], "left").withColumn(own.gone, gone)


def kept_text(own: Names) -> Column:
    """The text of a row of mark_lines without the lines that go."""
    every = F.sequence(F.lit(0), F.size(own.lines) - 1)
    lines = F.col(own.lines)
    return F.when(F.size(own.gone) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(F.array_except(every, own.gone), lambda i: lines[i]), "\n"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, the numbers of the removed lines, and the digest of what is left."""
    own = Names.beside(docs)
    return mark_lines(docs.select("doc_id", "text"), own).select(
        "doc_id",
        F.size(own.lines).cast("long").alias("n_lines"),
        F.size(own.gone).cast("long").alias("n_removed"),
        F.array_join(F.col(own.gone).cast("array<string>"), ",").alias("removed"),
        F.sha2(kept_text(own), 256).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs without the lines that go, with n_chars to match where docs has it; documents that lose all lines go."""
    own = Names.beside(docs)
    marked = mark_lines(docs, own).where((F.size(own.gone) == 0) | (F.size(own.gone) < F.size(own.lines)))
    touched = F.size(own.gone) > 0
    new = {"text": F.when(touched, kept_text(own)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length(kept_text(own))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
