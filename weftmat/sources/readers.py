"""Readers for the matrix file formats. All give DataFrames with explicit row numbers, since Spark rows have no order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DTYPES = {"f64": ("<f8", "double"), "f32": ("<f4", "float"), "i32": ("<i4", "int"), "u32": ("<u4", "bigint"), "u8": ("u1", "int"), "c128": ("<f8", "double")}


def numbered_lines(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """(i, value): lines of text in file order. Files are numbered by name; a file's lines are numbered by its partitions.

    One pass counts the lines of each partition, a second adds the counts before it; no line moves to another task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = lines.filter(F.trim("value") != "") if skip_blank else lines
    lines = lines.withColumn("k", F.monotonically_increasing_id())
    # a split's rows have consecutive ids, so the first id of a split gives the place of each of its rows
    parts = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a file split
    return lines.join(F.broadcast(parts), ["f", "b"]).select((F.col("before") + F.col("k") - F.col("first")).alias("i"), "value")


def dense_csv(spark: SparkSession, path: str, cols: int, rows: int | None = None, sep: str = ",", skip_rows: int = 0, skip_cols: int = 0) -> DataFrame:
    """(i, vals ARRAY<DOUBLE>) of a headerless file, gzip files too. Blank lines are not rows and leave no gap in i.

    A row with too few or many cells, a cell that is no number, or another number of rows than declared fails.
    """
    parts = F.split("value", F.lit(sep if len(sep) == 1 and sep not in "|.^$*+?()[{\\" else f"\\{sep}"))
    df = numbered_lines(spark, path, skip_blank=True).withColumn("p", parts)
    if skip_rows:
        df = df.filter(F.col("i") >= skip_rows).withColumn("i", F.col("i") - skip_rows)
    if skip_cols:
        df = df.withColumn("p", F.expr(f"slice(p, {skip_cols + 1}, greatest(size(p) - {skip_cols}, 0))"))
    if rows is not None and df.count() != rows:
        raise ValueError(f"{df.count()} rows of cells; {rows} were declared")
    vals = F.when(F.size("p") != cols, F.raise_error(F.concat(F.lit("cells in row "), F.col("i"), F.lit(": "), F.size("p")))).otherwise(F.transform("p", lambda c: F.trim(c).cast("double")))
    return df.select("i", vals.alias("vals"))


def complex_csv(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """(i, vals ARRAY<STRUCT<re, im>>) of cells such as (1.0+2.0j). Blank lines are not rows; a row of another width, or another cell, fails."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    form = rf"^\s*\(\s*({number})({number})j\s*\)\s*$"
    part = lambda c, k, n: F.regexp_extract(c, form, k).cast("double").alias(n)
    cell = lambda c: F.when(c.rlike(form), F.struct(part(c, 1, "re"), part(c, 2, "im"))).otherwise(F.raise_error(F.concat(F.lit("no complex number: "), c)))
    df = numbered_lines(spark, path, skip_blank=True).withColumn("p", F.split("value", ","))
    wrong = F.raise_error(F.concat(F.lit("cells in row "), F.col("i"), F.lit(": "), F.size("p")))
    return df.select("i", F.when(F.size("p") != cols, wrong).otherwise(F.transform("p", cell)).alias("vals"))


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(i, data): a binary file's records of a fixed size, numbered in order. The file is split between records; no row passes through Python."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if length % size:
        raise ValueError(f"{length} bytes are no whole number of records of {size}")
    rdd = spark.sparkContext._jsc.binaryRecords(path, size).rdd()
    encoder = spark._jvm.org.apache.spark.sql.Encoders.BINARY()
    df = DataFrame(spark._jsparkSession.createDataset(rdd, encoder).toDF(), spark).toDF("data").withColumn("k", F.monotonically_increasing_id())
    parts = df.groupBy(F.shiftright("k", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    parts = parts.select("part", (before - F.col("first")).alias("shift"))
    return df.withColumn("part", F.shiftright("k", 33)).join(F.broadcast(parts), "part").select((F.col("k") + F.col("shift")).alias("i"), "data")


def dense_binary(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "f64") -> DataFrame:
    """(i, vals) of a row-major file, whose size must be exact. dtype c128 reads interleaved re, im.

    The file is split at row boundaries, so its size is not bounded by a task; a batch of rows is decoded as one array.
    """
    np_type, sql = DTYPES[dtype]
    n = cols * (2 if dtype == "c128" else 1)
    per = n * np.dtype(np_type).itemsize
    data = records(spark, path, per)
    found = data.count()
    if found != rows:
        raise ValueError(f"{found * per} bytes; {rows} x {cols} {dtype} needs {rows * per}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.from_numpy_dtype(np.int64 if dtype == "u32" else np.int32 if dtype == "u8" else np.dtype(np_type))
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np_type)
            vals = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, n), pa.int32()), pa.array(x).cast(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), vals], ["i", "vals"])

    flat = data.mapInArrow(run, f"i bigint, vals array<{sql}>")
    if dtype != "c128":
        return flat
    return flat.select("i", F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda k: F.struct(F.get("vals", 2 * k).alias("re"), F.get("vals", 2 * k + 1).alias("im"))).alias("vals"))


def int_stream(spark: SparkSession, path: str, dtype: str = "i32") -> DataFrame:
    """(pos, sym) of a raw file of integers: code sequences with 0 after each row, rules, compressed sequences, lists."""
    np_type, sql = DTYPES[dtype]
    rows = records(spark, path, np.dtype(np_type).itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np_type).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x)], ["pos", "sym"])

    return rows.mapInArrow(run, "pos bigint, sym bigint")


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sym) of a text file with one integer a line."""
    return numbered_lines(spark, path, skip_blank=True).select(F.col("i").alias("pos"), F.trim("value").cast("bigint").alias("sym"))


def triplets(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """Entries (i, j, v) of "row col value" lines, 0-based; an index out of range fails. Duplicates stay and add up in products."""
    df = spark.read.csv(path, sep=" ", schema="i bigint, j int, v double", ignoreLeadingWhiteSpace=True)
    return _checked(df, rows, cols).filter("v <> 0")


def boolean(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """Entries (i, j, 1.0) of "row col" lines."""
    df = spark.read.csv(path, sep=" ", schema="i bigint, j int", ignoreLeadingWhiteSpace=True)
    return _checked(df, rows, cols).withColumn("v", F.lit(1.0))


def _checked(df: DataFrame, rows: int, cols: int) -> DataFrame:
    bad = (F.col("i") < 0) | (F.col("i") >= rows) | (F.col("j") < 0) | (F.col("j") >= cols) | F.col("i").isNull() | F.col("j").isNull()
    return df.withColumn("i", F.when(bad, F.raise_error(F.lit("index out of range"))).otherwise(F.col("i")))


def boolean_dense(e: DataFrame, cols: int, rows: int | None = None) -> DataFrame:
    """(i, vals) of 0/1 cells of a boolean matrix; a repeated cell fails. With rows given, rows without ones are there too."""
    g = e.groupBy("i").agg(F.collect_list("j").alias("js"))
    if rows is not None:
        g = e.sparkSession.range(rows).withColumnRenamed("id", "i").join(g, "i", "left").withColumn("js", F.coalesce("js", F.array().cast("array<int>")))
    cells = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.array_contains("js", c).cast("double"))
    return g.select("i", F.when(F.size(F.array_distinct("js")) < F.size("js"), F.raise_error(F.lit("repeated cell"))).otherwise(cells).alias("vals"))


def edge_list(spark: SparkSession, path: str, header: bool = True, shift: int = 0) -> DataFrame:
    """(src, dst) of a Matrix-Market or plain edge file: comments (% or #) and lines of other than two tokens are left out, so is the header line."""
    df = numbered_lines(spark, path).filter(~F.col("value").rlike(r"^\s*[%#]"))
    parts = F.split(F.trim("value"), r"\s+")
    if header:
        first = df.agg(F.min("i")).first()[0]
        df = df.filter(F.col("i") > F.lit(first if first is not None else -1))
    df = df.withColumn("p", parts).filter(F.size("p") == 2)
    return df.select((F.get("p", F.lit(0)).cast("bigint") + shift).alias("src"), (F.get("p", F.lit(1)).cast("bigint") + shift).alias("dst"))


def vector(spark: SparkSession, path: str, dtype: str = "f64") -> DataFrame:
    """(idx, x) of a raw binary vector file of less than 2 GB; keep longer ones as tables."""
    np_type, sql = DTYPES[dtype]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                x = np.frombuffer(content, np_type)
                yield pd.DataFrame({"idx": np.arange(len(x)), "x": x})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"idx bigint, x {sql}")


def tour(spark: SparkSession, path: str) -> DataFrame:
    """(pos, col), 0-based, of a 1-based tour that ends with -1."""
    df = numbered_lines(spark, path).filter(F.col("value").rlike(r"^\s*-?\d+\s*$")).select("i", F.trim("value").cast("int").alias("c"))
    stop = df.filter("c = -1").agg(F.min("i")).first()[0]
    first = df.agg(F.min("i")).first()[0]
    df = df if stop is None else df.filter(F.col("i") < stop)
    return df.select((F.col("i") - F.lit(first or 0)).cast("int").alias("pos"), (F.col("c") - 1).alias("col"))


def first_cells(e: DataFrame, cols: int, n: int) -> DataFrame:
    """Entries among the first n cells in row order: the memory-capped loader's view."""
    return e.filter(F.col("i") * cols + F.col("j") < n)


def fill_missing(cells: Column, value: str) -> Column:
    """Cells of a split CSV row, with empty and NA ones replaced."""
    return F.transform(cells, lambda c: F.when(F.trim(c).isin("", "NA"), F.lit(value)).otherwise(c))
