"""What the operators of this subpackage share: input projection, worker set-up, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairstone.shared import written
from pairstone.workers import importable

#: Rows and bytes of one Arrow batch: tens of MB however long the texts are (a batch ends with the row that exceeds it).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches by rows and bytes."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones; other columns never reach the operators."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_column(docs: DataFrame, fn: Callable[[pa.Array], dict], schema: str) -> DataFrame:
    """Apply fn to the texts of each Arrow batch, as a column; fn returns the columns of schema that follow doc_id."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) if isinstance(v, list) else v for v in out.values())], names=["doc_id", *out])

    return texts(docs).mapInArrow(run, f"doc_id long, {schema}")


def map_rows(docs: DataFrame, fn: Callable[[list], dict], schema: str) -> DataFrame:
    """Apply fn to the texts of each Arrow batch, as a list."""
    return map_column(docs, lambda column: fn(column.to_pylist()), schema)


def map_all(docs: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], like: DataFrame) -> DataFrame:
    """mapInArrow with columns by place, as mapInArrow itself takes no names with dots; the result has the columns of like."""
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(like.schema)])
    by_place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return by_place.mapInArrow(fn, schema).toDF(*like.columns)


checkpointed = written


#: Rows of ids that a broadcast may hold: a few MB.
BROADCAST_ROWS = 200_000


def own_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(df: DataFrame, width: Column | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows; otherwise the join shuffles. df should be checkpointed.

    width: the size of what a row holds besides, in rows, where that isn't bounded.
    """
    if width is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    else:
        rows = df.agg(F.sum(1 + width)).first()[0] or 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def apart(*columns: str) -> Column:
    """A join key that no earlier exchange knows, so that both sides get plain exchanges, which AQE can split where a key is hot."""
    return F.struct(*columns)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a labelled row."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
