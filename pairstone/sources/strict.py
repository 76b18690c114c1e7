"""Tables of policy and vocabulary, read strictly: what is missing or of another shape is an error, never a default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableUnavailable(RuntimeError):
    """A table that a decision rests on can't be read as it must be."""


def read_json(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """One row of a JSON document whose `schema` member is version and whose members of `schema` are all there."""
    wanted = T.StructType.fromDDL(schema)
    try:
        row = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(T.StructType([T.StructField("schema", T.StringType()), *wanted.fields])).json(path)
        first = row.first()
    except Exception as error:
        raise TableUnavailable(f"{path} can't be read as {version}") from error
    if first is None or first["schema"] != version:
        raise TableUnavailable(f"{path} is not {version}")
    missing = [f.name for f in wanted.fields if first[f.name] is None]
    if missing:
        raise TableUnavailable(f"{path} has no {', '.join(missing)}")
    return row


@dataclass(frozen=True)
class Vocabulary:
    """Families of each locus, and the release that they come from."""

    release: str
    families: dict[str, list[str]]

    def column(self) -> Column:
        """A map of locus to its families: a literal, a few hundred strings."""
        return F.create_map(*[x for k, v in sorted(self.families.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])


def vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    row = read_json(spark, path, "release string, families map<string, array<string>>", "families/v1").first()
    if not row.release or not row.families or any(not v for v in row.families.values()):
        raise TableUnavailable(f"{path} has no release or no families")
    return Vocabulary(row.release, {k: [*v] for k, v in row.families.items()})


@dataclass(frozen=True)
class Policy:
    policy_id: str
    first: dict[str, int]
    second: dict[str, int]
    gate_full: int
    gate_half: int
    scored: list[str]
    buckets: list[str]


def policy(spark: SparkSession, path: str) -> Policy:
    """The weights of a ranking; each scored locus must have its charges."""
    row = read_json(spark, path, "policy_id string, first map<string, int>, second map<string, int>, gate_full int, gate_half int, scored array<string>, buckets array<string>", "policy/v1").first()
    lacking = [x for x in row.scored if x not in row.first or x not in row.second]
    if lacking or not row.scored or row.gate_half > row.gate_full:
        raise TableUnavailable(f"{path}: no charge for {', '.join(lacking) or 'any locus'}, or a gate that adds")
    return Policy(row.policy_id, dict(row.first), dict(row.second), row.gate_full, row.gate_half, [*row.scored], [*row.buckets])


def rows_of(spark: SparkSession, path: str, schema: str, version: str, list_name: str) -> DataFrame:
    """The rows of a strict table (frequencies, testing rates): members of a list, none of them with a null."""
    members = ",".join(x.replace(" ", ":") for x in schema.split(", "))
    rows = read_json(spark, path, f"{list_name} array<struct<{members}>>", version)
    out = rows.select(F.explode(list_name).alias("r")).select("r.*")
    if out.where(" OR ".join(f"`{c}` IS NULL" for c in out.columns)).limit(1).count() or out.limit(1).count() == 0:
        raise TableUnavailable(f"{path} has no rows or rows with gaps")
    return out


def families_of(alleles: DataFrame) -> DataFrame:
    """(locus, families) from a table of allele names: the vocabulary's own source."""
    parts = F.regexp_extract("allele", r"^([A-Z0-9]+)\*([0-9]{2,3})", 1), F.regexp_extract("allele", r"^([A-Z0-9]+)\*([0-9]{2,3})", 2)
    named = alleles.select(parts[0].alias("locus"), parts[1].alias("family")).where("family <> ''")
    return named.groupBy("locus").agg(F.array_sort(F.collect_set("family")).alias("families"))
