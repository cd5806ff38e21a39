"""Writers for the matrix file formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmat.sources.readers import DTYPES


def lossy_values(values: DataFrame, kind: str = "int") -> DataFrame:
    """Dictionary values that change when they are stored as kind."""
    return values.filter(F.col("v").cast(kind).cast("double") != F.col("v"))


def write_dictionary(values: DataFrame, path: str, kind: str = "double") -> int:
    """Writes (val_id, v) and returns how many values kind changes."""
    values.select("val_id", F.col("v").cast(kind).alias("v")).write.mode("overwrite").parquet(path)
    return lossy_values(values, kind).count() if kind != "double" else 0


def write_codes(codes: DataFrame, path: str) -> None:
    """A code sequence with a column block, one folder a block."""
    codes.repartition("block").write.mode("overwrite").partitionBy("block").parquet(path)


def write_csv(dense: DataFrame, path: str, skip_rows: int = 0, skip_left: int = 0, skip_right: int = 0, compression: str = "none") -> None:
    """(i, vals) as lines of text in row order, compressed if asked for; rows and outer columns can be left out."""
    vals = F.slice("vals", skip_left + 1, F.size("vals") - skip_left - skip_right)
    lines = dense.filter(F.col("i") >= skip_rows).repartitionByRange("i").sortWithinPartitions("i").select(F.array_join(F.transform(vals, lambda v: v.cast("string")), ",").alias("value"))
    lines.write.mode("overwrite").text(path, compression=compression)


def binary_blocks(dense: DataFrame, rows: int, blocks: int, dtype: str = "f64", skip_rows: int = 0, skip_left: int = 0, skip_right: int = 0) -> DataFrame:
    """(block, chunk, data): row-major bytes of row ranges; a block's chunks, in order, are its file. Rows and outer columns can be left out.

    rows is the number of rows that stay.
    """
    if skip_rows or skip_left or skip_right:
        vals = F.slice("vals", skip_left + 1, F.size("vals") - skip_left - skip_right)
        dense = dense.filter(F.col("i") >= skip_rows).select((F.col("i") - skip_rows).alias("i"), vals.alias("vals"))
    np_type, _ = DTYPES[dtype]
    size = -(-rows // blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, part in pdf.groupby("block", sort=True):
                yield pd.DataFrame({"block": [block], "chunk": [int(part["i"].iloc[0])], "data": [np.stack(part["vals"].to_numpy()).astype(np_type).tobytes()]})

    ordered = dense.withColumn("block", F.expr(f"i div {size}")).repartitionByRange("i").sortWithinPartitions("i").select("block", "i", "vals")
    return ordered.mapInPandas(run, "block bigint, chunk bigint, data binary")


def write_edges(edges: DataFrame, path: str, header: bool = True) -> None:
    """Sorted, distinct "src dst" lines; with header an extra file of "rows cols arcs" beside them."""
    e = edges.select("src", "dst").distinct()
    e.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)
    if header:
        e.agg(F.concat_ws(" ", F.max("src") + 1, F.max("dst") + 1, F.count(F.lit(1))).alias("value")).write.mode("overwrite").text(path.rstrip("/") + ".header")


def tour_lines(order: list[int]) -> str:
    return "".join(f"{c + 1}\n" for c in order) + "-1\nEOF\n"


def similarity_lines(sim: DataFrame, cols: int) -> DataFrame:
    """One line a column: the weights of its later columns."""
    g = sim.groupBy("c1").agg(F.array_sort(F.collect_list(F.struct("c2", "w"))).alias("r"))
    return g.select("c1", F.array_join(F.transform("r", lambda x: x["w"].cast("string")), " ").alias("value"))


def vector_bytes(v: DataFrame, dtype: str = "f64", limit: int = 1 << 24) -> bytes:
    """A vector (idx, x) as raw bytes on the driver; longer ones than limit are refused: write them as a table."""
    rows = v.orderBy("idx").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("vector too long for the driver; write it as a table")
    return np.array([r.x for r in rows], DTYPES[dtype][0]).tobytes()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file through Spark's file systems. For what fits the driver: vectors, blocks, headers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def write_vector(v: DataFrame, path: str) -> None:
    """A vector (idx, x) of any length, in order, as parquet files."""
    v.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def write_list(symbols: DataFrame, path: str) -> None:
    """(pos, sym) as text, one integer a line, in order."""
    symbols.repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("sym").cast("string").alias("value")).write.mode("overwrite").text(path)


def edge_counts(edges: DataFrame) -> DataFrame:
    """(side, node, degree): arcs of every row and of every column that has any."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.lit("row").alias("side"), F.col("src").alias("node")).union(e.select(F.lit("col"), "dst"))
    return both.groupBy("side", "node").agg(F.count(F.lit(1)).alias("degree"))
