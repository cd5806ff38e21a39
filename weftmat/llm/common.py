"""Shared helpers: tables, size-checked broadcasts, words. Tables between rounds come from weftmat.plans.scratch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmat.plans.scratch import materialize

__all__ = ["BROADCAST_BYTES", "materialize", "row_of", "sized", "table", "text_or_empty", "word_array"]

#: Largest table, in bytes of the hash table made of it as counted before planning, that is sent to every executor.
BROADCAST_BYTES = 8 << 20

#: ASCII white space, the complement of the word class of the corpus contracts.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, nbytes: int | None) -> DataFrame:
    """Mark df for broadcasting if its size is counted and within BROADCAST_BYTES; otherwise leave the join to Spark."""
    return F.broadcast(df) if nbytes is not None and nbytes <= BROADCAST_BYTES else df


def row_of(df: DataFrame, *without: str) -> Column:
    """All columns of df, but for those named, as one struct: beside it, working columns clash with no name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without], *([] if set(df.columns) - set(without) else [F.lit(None).alias("__none")])).alias("row")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a non-null string."""
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))
