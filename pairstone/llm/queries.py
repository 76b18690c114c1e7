"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.llm import bpe, cuckoo, icws, line_dedup, ogg, packing, pii, quality, token_fst, toxicity
from pairstone.llm.runtime import crc_bucket, read_table


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_report(read_table(spark, sf_dir, "documents"))


def op3_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.copies(read_table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fst.count_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def with_fold(scored: DataFrame, modulus: int, held: int, *more: str) -> DataFrame:
    """A scorer's rows with the mark of held-out ids; a null id is never held out."""
    mark = F.coalesce(crc_bucket(F.col("doc_id"), modulus) == held, F.lit(False))
    return scored.select("doc_id", mark.alias("held_out"), "score", "predicted", *more)


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return with_fold(quality.score_documents(docs, quality.fit(docs, labels, crc_bucket(F.col("doc_id"), 5) != 0)), 5, 0)


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return with_fold(toxicity.score_documents(docs, toxicity.fit(docs, labels, crc_bucket(F.col("doc_id"), 4) != 2)), 4, 2, "offending")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS place FROM docs WHERE len(lines) >= 3),
windows AS (
    SELECT doc_id, place, lines[place + 1 : place + 3] AS w
    FROM places WHERE regexp_matches(concat(lines[place + 1], lines[place + 2], lines[place + 3]), '[^\s]')
),
ranked AS (SELECT doc_id, place, row_number() OVER (PARTITION BY w ORDER BY doc_id, place) AS nth FROM windows),
gone AS (
    SELECT doc_id, list_sort(list_distinct(list(line))) AS lines_gone
    FROM (SELECT doc_id, unnest(range(place, place + 3)) AS line FROM ranked WHERE nth > 1) GROUP BY doc_id
)
SELECT d.doc_id, len(d.lines) AS n_lines, coalesce(len(g.lines_gone), 0) AS n_removed,
       coalesce(array_to_string(g.lines_gone, ','), '') AS removed,
       sha256(coalesce(array_to_string(list_filter(d.lines, lambda x, i: NOT coalesce(list_contains(g.lines_gone, i - 1), false)), chr(10)), '')) AS kept_sha256
FROM docs d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_icws_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_groups(read_table(spark, sf_dir, "documents"))


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_ogg_media": op2_ogg_media,
    "op3_cuckoo_dedup": op3_cuckoo_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_quality_knn": op5_quality_knn,
    "op6_toxicity_mil": op6_toxicity_mil,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii_bootstrap": op9_pii_bootstrap,
    "op10_icws_minhash": op10_icws_minhash,
}

ORACLE_SQL: dict[str, str] = {"op3_cuckoo_dedup": OP3_SQL, "op7_line_dedup": OP7_SQL}
