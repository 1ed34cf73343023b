"""Small helpers the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.session import shared_folder

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table of its own, and read from there.

    Later jobs read it instead of computing it again, also after an executor is lost.
    """
    return write_to(df, f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}")


def write_to(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``; tasks in Python are handed a thousand rows at once at most."""
    spark = df.sparkSession
    before = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, min(before, 1000) if before > 0 else 1000)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out() -> Column:
    """The third of documents no label is learned from; a missing id is not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that no name of theirs can clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The texts of a batch, one Python string at a time."""
    return (x.as_py() for x in batch.column(column))


def by_size(values: Iterator[str | None], most: int) -> Iterator[list[str | None]]:
    """Lists of consecutive texts of up to ``most`` characters; a longer text has its own."""
    held, size = [], 0
    for value in values:
        n = len(value or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(value)
        size += n
    if held:
        yield held
