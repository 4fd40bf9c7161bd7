"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, written  # noqa: F401

MAX_BROADCAST = 16 << 20  # bytes of rows that a table may have to be broadcast
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, *also: str, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, and those to be carried along under theirs; extra columns, whatever their names, stay behind.

    Arrow batches of the session are bounded to 4 MB unless it sets a bound of its own: a task then holds a few
    documents more than the longest one, however many rows a file has.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in ("64MB", "67108864b"):  # the default
        conf.set(_BATCH, "4m")
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()], *[df[f"`{c}`"] for c in also])


def held_out(column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def row_key(doc: Column, text: Column) -> list[Column]:
    """128 bits that tell rows of different id or text apart, nulls included: ids repeat, so decisions are kept by row."""
    parts = [F.coalesce(doc.cast("long"), F.lit(0).cast("long")), doc.isNull(), F.coalesce(text, F.lit("")), text.isNull()]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def near(df: DataFrame, row_bytes: int | Column, limit: int = MAX_BROADCAST) -> DataFrame:
    """df, marked for broadcast if its rows (of that many bytes each) are at most limit bytes together; a table of written() is meant."""
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0] if isinstance(row_bytes, Column) else row_bytes * df.count()
    return F.broadcast(df) if size <= limit else df
