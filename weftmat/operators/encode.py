"""Entries, dictionary, code sequences. A matrix is a DataFrame of entries (i, j, v), zeros left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmat.plans.scratch import materialize, small


def number_rows(df: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) plus name = 0, 1, ... in the order of the columns, nulls first; a written table, so numbers are given once.

    Rows are dealt into ranges of all order columns, whose bounds Spark samples, so one frequent leading value does not gather in a
    task; each range is sorted and numbered by itself and shifted by the counts of the ranges before it.
    """
    at = F.monotonically_increasing_id()  # range << 33 | place in it
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(keep or df.columns), at.alias("__at"))
    dealt = materialize(dealt, "numbered", compression="lz4")
    parts = dealt.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    parts = parts.select("__range", (before - F.col("first")).alias("__shift"))
    joined = dealt.withColumn("__range", F.shiftright("__at", 33)).join(F.broadcast(parts), "__range")
    return joined.withColumn(name, F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")


def entries(dense: DataFrame, columns: list[str | Column], row_id: str = "i") -> DataFrame:
    """(i, j, v) of the nonzero cells; column k of the list is j = k. NaN counts as nonzero, -0.0 as zero."""
    cells = dense.select(F.col(row_id).alias("i"), F.posexplode(F.array(*columns)).alias("j", "v"))
    return cells.filter("v <> 0")


def cells(dense: DataFrame, columns: list[str | Column], row_id: str = "i") -> DataFrame:
    """(i, j, v) of all cells, zeros too."""
    return dense.select(F.col(row_id).alias("i"), F.posexplode(F.array(*columns)).alias("j", "v"))


def dictionary(e: DataFrame, cols: int) -> DataFrame:
    """(v, val_id): distinct values in order of their first appearance, row by row; a written table, so e is read once for it."""
    first = e.groupBy("v").agg(F.min(F.col("i") * cols + F.col("j")).alias("__pos"))
    return number_rows(first, ["__pos"], "val_id", ["v"])


def csrv(e: DataFrame, values: DataFrame, cols: int) -> DataFrame:
    """(i, j, code) with code = val_id * cols + j + 1. A counted, small dictionary is broadcast, so frequent values do not gather in a task."""
    return e.join(small(values), "v").select("i", "j", (F.col("val_id") * cols + F.col("j") + 1).alias("code"))


def csrv_decode(codes: DataFrame, values: DataFrame, cols: int) -> DataFrame:
    """(i, j, v) from (i, code)."""
    back = codes.select("i", F.pmod(F.col("code") - 1, F.lit(cols)).cast("int").alias("j"), F.expr(f"(code - 1) div {cols}").alias("val_id"))
    return back.join(small(values), "val_id").select("i", "j", "v")


def drv(all_cells: DataFrame, cols: int) -> DataFrame:
    """(i, j, code) with code = val_id + 1 for every cell, zeros included."""
    return all_cells.join(small(dictionary(all_cells, cols)), "v").select("i", "j", (F.col("val_id") + 1).alias("code"))


def bad_codes(codes: DataFrame, values: int, cols: int) -> DataFrame:
    """The codes that stand for no value or column: below 1 or with a val_id beyond the dictionary."""
    return codes.filter(F.col("code").isNull() | (F.col("code") < 1) | (F.col("code") > values * cols))


def checked_codes(codes: DataFrame, values: int, cols: int) -> DataFrame:
    """codes; reading one that bad_codes would find fails."""
    bad = F.col("code").isNull() | (F.col("code") < 1) | (F.col("code") > values * cols)
    return codes.withColumn("code", F.when(bad, F.raise_error(F.lit("code out of range"))).otherwise(F.col("code")))


def block_of(rows: int, blocks: int, row: str = "i") -> Column:
    """Row block of ceil(rows / blocks) rows; unlike file blocks, the last may be empty."""
    size = -(-rows // blocks)
    return F.expr(f"{row} div {size}").alias("block")


def sequences(codes: DataFrame, code: str = "code") -> DataFrame:
    """(i, seq): each row's codes in column order, at most `cols` of them."""
    return codes.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", code))), lambda x: x[code]).alias("seq"))


def stats(e: DataFrame, rows: int, cols: int) -> DataFrame:
    """nnz, n_distinct, density, max_code, code_bits."""
    s = e.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("v").alias("n_distinct"))
    top = F.col("n_distinct") * cols
    return s.select("nnz", "n_distinct", (F.col("nnz") / F.lit(rows * cols)).alias("density"), top.alias("max_code"), F.length(F.bin(top)).cast("bigint").alias("code_bits"))


def token_hash(token: Column) -> Column:
    """32 bits of a token's digest, for cells that are no numbers; the token 0 stays 0, so that zeros stay zeros."""
    return F.when(F.trim(token) == "0", F.lit(0).cast("bigint")).otherwise(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint"))
