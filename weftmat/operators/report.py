"""Sizes of a matrix in every encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.functions import codecs


def sizes(values: DataFrame, codes: DataFrame, rows: int, cols: int, rules: DataFrame, cseq: DataFrame, value_bytes: int = 8) -> DataFrame:
    """(encoding, bytes, percent of the dense matrix, bits an entry); the dictionary counts in each.

    codes: 32 bits a code and a terminator a row. codes_iv: the same at the width of the largest. grammar: 64 bits a rule, 32 a symbol.
    grammar_iv and grammar_ans: the blocks' rules and symbols by these codecs, in bytes as stored.
    """
    n = values.agg(F.count(F.lit(1)).alias("k")).select((F.col("k") * value_bytes).alias("val"))
    c = codes.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.max(codecs.bit_width(F.col("code"))), F.lit(1)).alias("width"))
    plain = c.select(F.lit("codes").alias("encoding"), (4 * (F.col("nnz") + rows)).alias("b")).union(c.select(F.lit("codes_iv"), F.ceil((F.col("nnz") + rows) * F.col("width") / 8)))
    r, q = rules.agg(F.count(F.lit(1)).alias("r")), cseq.agg(F.count(F.lit(1)).alias("q"), F.count_distinct("i").alias("lines"))
    plain = plain.union(r.crossJoin(F.broadcast(q)).select(F.lit("grammar"), F.col("r") * 8 + (F.col("q") + F.col("lines")) * 4))  # one-row sides
    pairs = rules.select(F.col("block") * 2, F.posexplode(F.array("left", "right")).alias("k", "sym"), "nt").toDF("block", "k", "sym", "nt").select("block", (F.col("nt") * 2 + F.col("k")).alias("pos"), "sym")
    syms = cseq.select((F.col("block") * 2 + 1).alias("block"), (F.col("i") * (1 << 20) + F.col("pos")).alias("pos"), "sym")
    for codec in ("iv", "ans"):
        coded = codecs.encode_blocks(pairs.union(syms), codec)
        plain = plain.union(coded.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("b")).select(F.lit(f"grammar_{codec}"), "b"))
    dense = rows * cols * value_bytes
    out = plain.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(c.select("nnz")))  # one-row sides
    total = F.col("b") + F.col("val")
    return out.select("encoding", total.cast("bigint").alias("bytes"), (100.0 * total / dense).alias("percent"), (8.0 * total / F.col("nnz")).alias("bits_an_entry"))
