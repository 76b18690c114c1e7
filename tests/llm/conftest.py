import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text), with columns whose names clash with the operators' own words."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x", 1.0, "y") for i, t in rows]
        return spark.createDataFrame(full, f"{DOCS}, digest string, score double, share string")

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty and very long texts, repeated rows, odd characters."""
    long_text = "lorem ipsum dolor sit amet " * 4000 + "a" * 5000
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (4, long_text), (5, long_text), (6, "\n\n\n"), (7, "é😀\x1c\x00 <|endoftext|>’s ß İ"), (8, "one\ntwo\nthree\nfour"), (9, "zero\none\ntwo\nthree")]
    return docs_of(rows)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns that have the names of the operators' own."""
    from pyspark.sql import functions as F

    names = ["_ps_id", "_PS_ID_", "_ps_text", "_ps_lines", "_ps_gone", "_ps_key", "_ps_added", "_ps_digest", "node", "key", "a.b", "id", "base", "found", "task", "nth", "rank", "_1"]
    return awkward.select("*", *[F.lit("x").alias(n) for n in names])
