"""The matching queries in DuckDB SQL, built from one chain of common table expressions."""

from __future__ import annotations

PEOPLE = """
people AS (
    SELECT 'R' AS side, c_custkey AS key, 0 AS s FROM customer
    UNION ALL SELECT 'D', s_suppkey, 1 FROM supplier
),
loci(j, locus, n) AS (VALUES (0, 'A', 7), (1, 'B', 9), (2, 'C', 6), (3, 'DRB1', 5), (4, 'DQB1', 4)),
typing_keys AS (
    SELECT side, key, s, j, locus,
           lpad(((key * 7 + s + j) % n + 1)::VARCHAR, 2, '0') AS a1,
           lpad(((key * 11 + s + 3 * j) % n + 1)::VARCHAR, 2, '0') AS a2,
           (key * 13 + j + s) % 11 AS shape
    FROM people CROSS JOIN loci
),
typings AS (
    SELECT side, key, locus,
           CASE shape WHEN 0 THEN NULL WHEN 1 THEN a1 WHEN 2 THEN locus || '*' || a1
                WHEN 3 THEN a1 || ',' || a2 || ',' || a1 WHEN 4 THEN 'X*' || a1 || ',' || a2
                WHEN 5 THEN locus || '*' || a1 || ':01,' || locus || '*' || a2 || ':02'
                WHEN 6 THEN a1 || '/' || a2 WHEN 7 THEN locus || '*' || a1 || ' ' || a2
                ELSE locus || '*' || a1 || ',' || locus || '*' || a2 END AS value,
           CASE WHEN shape = 2 THEN 'UNREAD' WHEN shape = 9 THEN 'READ' WHEN shape = 10 AND key % 5 = 0 THEN 'UNREAD' END AS second_allele,
           CASE (key + j) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS tier
    FROM typing_keys
),
traits AS (
    SELECT side, key,
           CASE WHEN key % 17 = 5 THEN NULL WHEN key % 19 = 7 THEN 'O+?'
                ELSE (['O', 'A', 'B', 'AB'])[(key + s) % 4 + 1] END AS abo,
           key % 3 <> 0 AS lab, key % 23 <> 11 AS eligible,
           CASE WHEN key % 29 = 13 THEN 'POSITIVE' ELSE 'NOT_PERFORMED' END AS crossmatch,
           key % 31 = 17 AS dsa,
           (['PRESENT', 'ABSENT', 'UNKNOWN', 'REVIEW_REQUIRED', 'PRESENT'])[(key * 3 + s) % 5 + 1] AS drb3,
           (['PRESENT', 'ABSENT', 'UNKNOWN', 'REVIEW_REQUIRED', 'PRESENT'])[(key * 3 + s + 1) % 5 + 1] AS drb4,
           (['PRESENT', 'ABSENT', 'UNKNOWN', 'REVIEW_REQUIRED', 'PRESENT'])[(key * 3 + s + 2) % 5 + 1] AS drb5
    FROM people
)"""

PARSED = """
tokenised AS (
    SELECT *, list_filter(regexp_split_to_array(coalesce(value, ''), '[,;/+\\s]+'), lambda t: t <> '') AS tokens,
           upper(trim(coalesce(second_allele, ''))) AS mark
    FROM typings
),
typed AS (
    SELECT side, key, locus, tier, tokens,
           CASE WHEN len(tokens) = 0 THEN 'ABSENT' WHEN len(tokens) > 2 THEN 'REVIEW_REQUIRED'
                WHEN len(list_filter(tokens, lambda t: contains(t, '*') AND upper(split_part(t, '*', 1)) <> locus)) > 0 THEN 'REVIEW_REQUIRED'
                WHEN mark = 'READ' AND len(tokens) <> 2 THEN 'REVIEW_REQUIRED'
                WHEN mark = 'UNREAD' AND len(tokens) = 2 THEN 'REVIEW_REQUIRED'
                WHEN len(tokens) = 2 THEN 'BOTH' ELSE 'ONE' END AS typing
    FROM tokenised
),
parsed AS (
    SELECT side, key, locus, tier, typing,
           CASE WHEN typing IN ('ONE', 'BOTH')
                THEN list_transform(tokens, lambda t: CASE WHEN contains(t, '*') THEN locus || '*' || split_part(t, '*', 2) ELSE locus || '*' || t END)
                ELSE [] END AS alleles
    FROM typed
)"""


def _cell(side: str) -> str:
    return f"""
cells_{side} AS (
    SELECT key, locus, tier, typing, alleles,
           list_min(list_transform(alleles, lambda a: len(list_filter(string_split(split_part(a, '*', 2), ':'), lambda p: p <> '')))) AS least
    FROM parsed WHERE side = '{side.upper()}'
)"""


#: One row for each pair and locus: status, lower, upper, depth.
MISMATCHES = f"""{_cell("d")},{_cell("r")},
compared AS (
    SELECT d.key AS donor, r.key AS recipient, d.locus, d.typing AS dt, r.typing AS rt, d.tier AS d_tier, r.tier AS r_tier,
           d.alleles AS da, r.alleles AS ra, least(d.least, r.least) AS depth,
           d.typing IN ('ONE', 'BOTH') AND r.typing IN ('ONE', 'BOTH') AS usable
    FROM cells_d d JOIN cells_r r ON d.locus = r.locus
),
counted AS (
    SELECT *, len(list_filter(list_distinct(list_transform(da, lambda a: array_to_string(string_split(a, ':')[1:depth], ':'))),
                  lambda x: NOT list_contains(list_transform(ra, lambda a: array_to_string(string_split(a, ':')[1:depth], ':')), x))) AS lacking
    FROM compared
),
mismatches AS (
    SELECT donor, recipient, locus, d_tier, r_tier,
           CASE WHEN NOT usable THEN 'UNKNOWN' WHEN dt = 'BOTH' AND rt = 'BOTH' THEN 'KNOWN' ELSE 'RANGE' END AS status,
           CASE WHEN usable THEN CASE WHEN dt = 'BOTH' AND rt = 'BOTH' THEN lacking
                ELSE least(least(2, lacking + (dt = 'ONE')::INT), greatest(0, lacking - (rt = 'ONE')::INT)) END END AS lower,
           CASE WHEN usable THEN CASE WHEN dt = 'BOTH' AND rt = 'BOTH' THEN lacking ELSE least(2, lacking + (dt = 'ONE')::INT) END END AS upper,
           CASE WHEN usable THEN depth END AS depth
    FROM counted
)"""

_FITS = "((d.abo = 'O') OR (d.abo = 'A' AND r.abo IN ('A', 'AB')) OR (d.abo = 'B' AND r.abo IN ('B', 'AB')) OR (d.abo = 'AB' AND r.abo = 'AB'))"
_READABLE = "coalesce(d.abo IN ('O', 'A', 'B', 'AB') AND r.abo IN ('O', 'A', 'B', 'AB'), false)"


def _gene(name: str) -> str:
    settled = f"d.{name} IN ('PRESENT', 'ABSENT') AND r.{name} IN ('PRESENT', 'ABSENT')"
    return f"CASE WHEN NOT ({settled}) THEN -1 WHEN d.{name} = 'PRESENT' AND r.{name} = 'ABSENT' THEN 1 ELSE 0 END"


def _level(dr: str, b: str, a: str) -> str:
    return f"CASE WHEN {dr} IS NULL OR {b} IS NULL THEN 99 WHEN {dr} = 0 AND {b} = 0 AND coalesce({a} = 0, false) THEN 1 ELSE 2 + 2 * {dr} + CASE WHEN {b} <= 1 THEN 0 ELSE 1 END END"


def _charge(locus: str, first: int, second: int) -> str:
    up = f"coalesce(u_{locus}, 2)"
    gate = "10" if locus == "DRB1" else "CASE WHEN matched THEN 10 ELSE 5 END"
    return f"({gate} * (CASE WHEN {up} >= 1 THEN {first} ELSE 0 END + CASE WHEN {up} >= 2 THEN {second} ELSE 0 END) // 10)"


_LOCI = ("A", "B", "C", "DRB1", "DQB1")
_PIVOT = ", ".join(f"max(CASE WHEN locus = '{x}' THEN {v} END) AS {c}_{x}" for x in _LOCI for c, v in (("u", "upper"), ("l", "lower"), ("s", "status")))
_COST = "CASE {0} WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 3 END"

SCORED = f"""
vectors AS (
    SELECT donor, recipient, {_PIVOT},
           sum(CASE WHEN upper IS NULL THEN 6 ELSE {_COST.format("coalesce(d_tier, 'C')")} + {_COST.format("coalesce(r_tier, 'C')")} END)::INT AS evidence,
           sum((upper IS NULL)::INT)::INT AS unknown_loci, sum((status = 'RANGE')::INT)::INT AS partial
    FROM mismatches GROUP BY donor, recipient
),
gated AS (
    SELECT v.*, d.abo AS d_abo, coalesce(u_DRB1 = 0, false) AS matched,
           {_gene("drb3")} AS p3, {_gene("drb4")} AS p4, {_gene("drb5")} AS p5,
           CASE WHEN NOT {_READABLE} THEN 'UNKNOWN' WHEN NOT {_FITS} THEN 'INCOMPATIBLE' WHEN NOT (d.lab AND r.lab) THEN 'UNKNOWN' ELSE 'COMPATIBLE' END AS abo_gate,
           d.eligible AND r.eligible AS eligible, d.crossmatch = 'POSITIVE' OR r.crossmatch = 'POSITIVE' AS positive, r.dsa AS dsa, {_READABLE} AS readable
    FROM vectors v JOIN traits d ON d.side = 'D' AND d.key = v.donor JOIN traits r ON r.side = 'R' AND r.key = v.recipient
),
scored AS (
    SELECT *, CASE WHEN NOT eligible THEN 7 WHEN positive THEN 6 WHEN dsa THEN 5 WHEN abo_gate = 'INCOMPATIBLE' THEN 4 WHEN NOT readable THEN 3
                   WHEN u_DRB1 IS NULL OR u_B IS NULL THEN 2 WHEN abo_gate = 'UNKNOWN' THEN 1 ELSE 0 END AS bucket,
           {_level("u_DRB1", "u_B", "u_A")} AS level, {_level("l_DRB1", "l_B", "l_A")} AS best_level,
           CASE WHEN coalesce(u_DQB1 = 0, false) THEN 0 ELSE 1 END AS dq,
           {_charge("DRB1", 60, 20)} + {_charge("DQB1", 40, 10)} + {_charge("B", 20, 10)} + {_charge("A", 10, 0)} + {_charge("C", 10, 0)}
             + (CASE WHEN matched THEN 10 ELSE 5 END * 10 * ((p3 <> 0)::INT + (p4 <> 0)::INT + (p5 <> 0)::INT) // 10) AS penalty,
           unknown_loci + (p3 = -1)::INT + (p4 = -1)::INT + (p5 = -1)::INT AS unknown
    FROM gated
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def ranking(anchor: str, candidate: str, k: int, where: str = "true") -> str:
    key = "bucket, level, dq, penalty, evidence, unknown, partial, tiebreak"
    return (
        with_(PEOPLE, PARSED, MISMATCHES, SCORED)
        + f"""SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY {key}) AS place FROM (
        SELECT {anchor} AS anchor, {candidate} AS candidate, bucket, level, dq, penalty, evidence, unknown, partial,
               sha256('PAIR_SCREEN_2|' || {anchor} || '|' || {candidate}) AS tiebreak
        FROM scored WHERE bucket <= 1 AND {where}))
WHERE place <= {k}"""
    )
