"""Tables written between the rounds of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as counted before planning, that is sent to every executor.
BROADCAST_BYTES = 16 << 20

#: Rows of a file of a table whose size is known to be small, and what counts as small.
ROWS_A_FILE, FEW_ROWS = 10_000, 1_000_000

#: Share of the driver's largest heap from which its garbage is collected after a table, and the least seconds between two collections.
HEAP_SHARE, GC_SECONDS = 0.3, 5
_collected = 0.0


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def release(spark: SparkSession) -> bool:
    """Collect the garbage of a driver of its own, once its heap has grown; whether it was collected.

    Many short rounds leave plans, task records and broadcasts behind, on which the heap grows up to its bound. A full collection
    shrinks it again, and lets Spark delete the shuffle files and broadcasts of ended rounds.
    """
    global _collected
    run = spark._jvm.java.lang.Runtime.getRuntime()
    if _local(spark) or time.monotonic() - _collected < GC_SECONDS or run.totalMemory() < HEAP_SHARE * run.maxMemory():
        return False
    spark._jvm.java.lang.System.gc()
    _collected = time.monotonic()
    return True


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.gettempdir() if _local(spark) else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/weftmat-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write df and read it back: cuts lineage and survives lost executors. The folder goes when the application ends.

    rows, if given, is a counted bound of its rows. A table of up to FEW_ROWS is dealt evenly into few files; others are written as df is
    dealt. (Spark's coalesce would merge partitions unevenly where they have preferred places.)
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    if rows is not None and rows <= FEW_ROWS:
        df = df.repartition(min(max(1, -(-rows // ROWS_A_FILE)), 2 * spark.sparkContext.defaultParallelism))
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """df marked for broadcasting if its rows are counted and few enough; otherwise the join is left to Spark. For tables that are written or bounded."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
