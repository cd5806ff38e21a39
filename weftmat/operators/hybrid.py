"""Products of a matrix that is split into a grammar-compressed part A and a plain part B."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.operators import algebra, grammar
from weftmat.plans.scratch import materialize, small


def compress_split(split: DataFrame, block: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, cseq, b) from (i, pos, code, part): the grammar of part A by block (an expression over i), and part B as (block, i, code)."""
    split = materialize(split.withColumn("block", F.expr(block).cast("bigint")), "split")
    a = split.filter("part = 'A'").groupBy("block", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("seq"))
    rules, cseq = grammar.compress(a)
    return rules, cseq, split.filter("part = 'B'").select("block", "i", "code")


def terminal_weights(values: DataFrame, x: DataFrame, cols: int, used: DataFrame) -> DataFrame:
    """(sym, w): value times vector element of the codes that are used (sym)."""
    at = used.select("sym", F.pmod(F.col("sym") - 1, F.lit(cols)).cast("int").alias("j"), F.expr(f"(sym - 1) div {cols}").alias("val_id"))
    return at.join(small(values), "val_id").join(algebra._vec(x, cols), "j").select("sym", (F.col("v") * F.col("x")).alias("w"))


def right_multiply(rules: DataFrame, cseq: DataFrame, b: DataFrame, values: DataFrame, x: DataFrame, cols: int) -> DataFrame:
    """(i, y) with y = A x + B x; x is (j, x). Rows without codes are left out."""
    first = rules.groupBy("block").agg(F.min("nt").alias("first"))
    syms = rules.select("block", F.explode(F.array("left", "right")).alias("sym")).union(cseq.select("block", "sym")).distinct()
    used = syms.join(first, "block", "left").filter("first IS NULL OR sym < first").select("sym").distinct()
    ya = grammar.right_multiply(rules, cseq, terminal_weights(values, x, cols, used))
    yb = algebra.right_multiply_codes(b, values, x, cols)
    return ya.unionByName(yb).groupBy("i").agg(F.sum("y").alias("y"))


def left_multiply(rules: DataFrame, cseq: DataFrame, b: DataFrame, values: DataFrame, y: DataFrame, cols: int, rows: int | None = None) -> DataFrame:
    """(j, z) with z = y' A + y' B; y is (i, y)."""
    mass = grammar.symbol_masses(rules, cseq, y)
    at = mass.select(F.pmod(F.col("sym") - 1, F.lit(cols)).cast("int").alias("j"), F.expr(f"(sym - 1) div {cols}").alias("val_id"), "mass")
    za = at.join(small(values), "val_id").groupBy("j").agg(F.sum(F.col("v") * F.col("mass")).alias("z"))
    return za.unionByName(algebra.left_multiply_codes(b, values, y, cols, rows)).groupBy("j").agg(F.sum("z").alias("z"))
