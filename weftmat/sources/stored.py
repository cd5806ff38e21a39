"""Stored encodings: a folder with the dictionary and, by row block, codes, A and B parts, or grammars, plain or coded.

    values/            (val_id, v)
    codes/block=k      (i, j, code)
    split/block=k      (i, pos, code, part)
    rules/block=k      (nt, left, right, level), cseq/block=k (i, pos, sym)
    coded/             (block, kind, n, data): the same two sequences of every block as bytes of a codec

All blocks share the dictionary. A reader given blocks opens only their folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmat.functions import codecs
from weftmat.operators import grammar


def _put(df: DataFrame, path: str, name: str) -> None:
    df.repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/{name}")


def _get(spark: SparkSession, path: str, name: str, schema: str, blocks: list[int] | None) -> DataFrame:
    df = spark.read.schema(schema + ", block bigint").parquet(f"{path}/{name}")
    return df if blocks is None else df.filter(F.col("block").isin(blocks))


def store_values(values: DataFrame, path: str) -> None:
    values.select("val_id", "v").write.mode("overwrite").parquet(f"{path}/values")


def load_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/values")


def store_codes(codes: DataFrame, path: str) -> None:
    """(block, i, j, code)."""
    _put(codes.select("block", "i", "j", "code"), path, "codes")


def load_codes(spark: SparkSession, path: str, blocks: list[int] | None = None) -> DataFrame:
    return _get(spark, path, "codes", "i bigint, j int, code bigint", blocks)


def store_split(split: DataFrame, path: str) -> None:
    """(block, i, pos, code, part)."""
    _put(split.select("block", "i", "pos", "code", "part"), path, "split")


def load_split(spark: SparkSession, path: str, part: str, blocks: list[int] | None = None) -> DataFrame:
    return _get(spark, path, "split", "i bigint, pos int, code bigint, part string", blocks).filter(F.col("part") == part)


def store_grammar(rules: DataFrame, cseq: DataFrame, path: str) -> None:
    _put(rules.select("block", "nt", "left", "right", "level"), path, "rules")
    _put(cseq.select("block", "i", "pos", "sym"), path, "cseq")


def load_grammar(spark: SparkSession, path: str, blocks: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    rules = _get(spark, path, "rules", "nt bigint, left bigint, right bigint, level int", blocks)
    return rules.select("block", "nt", "left", "right", "level"), _get(spark, path, "cseq", "i bigint, pos bigint, sym bigint", blocks).select("block", "i", "pos", "sym")


def store_coded(rules: DataFrame, cseq: DataFrame, path: str, codec: str = "ans") -> None:
    """The rules as pairs behind the first nonterminal, and the rows' symbols with 0 after each row and their numbers, in one codec's bytes a block.

    Only (block, kind, n, data) is stored; kind is rules, rows or cseq.
    """
    first = rules.groupBy("block").agg(F.min("nt").alias("first"))
    pair = rules.select("block", F.lit("rules").alias("kind"), F.posexplode(F.array("left", "right")).alias("k", "sym"), "nt").select("block", "kind", (F.col("nt") * 2 + F.col("k")).alias("pos"), "sym")
    head = first.select("block", F.lit("rules").alias("kind"), F.lit(-1).cast("bigint").alias("pos"), F.col("first").alias("sym"))
    width = F.lit(1 << 20)
    syms = cseq.select("block", F.lit("cseq").alias("kind"), (F.col("i") * width + F.col("pos")).alias("pos"), "sym")
    ends = cseq.select("block", "i").distinct().select("block", F.lit("cseq").alias("kind"), (F.col("i") * width + width - 1).alias("pos"), F.lit(0).cast("bigint").alias("sym"))
    rows = cseq.select("block", "i").distinct().select("block", F.lit("rows").alias("kind"), F.col("i").alias("pos"), F.col("i").alias("sym"))
    every = pair.unionByName(head).unionByName(syms).unionByName(ends).unionByName(rows)
    # two keys in one: a codec sees one sequence for each block and kind
    kinds = F.when(F.col("kind") == "rules", 0).when(F.col("kind") == "rows", 1).otherwise(2)
    coded = codecs.encode_blocks(every.select((F.col("block") * 3 + kinds).alias("block"), "pos", "sym"), codec)
    coded.select(F.expr("block div 3").alias("block"), F.element_at(F.array(*map(F.lit, ("rules", "rows", "cseq"))), (F.col("block") % 3 + 1).cast("int")).alias("kind"), "n", "data").write.mode("overwrite").parquet(f"{path}/coded")


def load_coded(spark: SparkSession, path: str, codec: str = "ans", blocks: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, cseq) as compress() gives them."""
    import numpy as np
    import pandas as pd

    df = spark.read.parquet(f"{path}/coded")
    df = df if blocks is None else df.filter(F.col("block").isin(blocks))
    dec = codecs.CODECS[codec][1]

    def run_rules(batches):
        for pdf in batches:
            for block, raw in zip(pdf["block"], pdf["data"], strict=True):
                x = dec(raw).astype(np.int64)
                first, pairs = int(x[0]), x[1:].reshape(-1, 2)
                yield pd.DataFrame({"block": block, "nt": first + np.arange(len(pairs)), "left": pairs[:, 0], "right": pairs[:, 1], "level": grammar.levels([tuple(p) for p in pairs.tolist()], first)})

    def run_cseq(pdf: pd.DataFrame) -> pd.DataFrame:
        got = {k: dec(raw).astype(np.int64) for k, raw in zip(pdf["kind"], pdf["data"], strict=True)}
        sym = got["cseq"]
        end = sym == 0
        row = np.append(0, np.cumsum(end)[:-1])
        pos = np.arange(len(sym)) - np.append(0, np.flatnonzero(end) + 1)[row]
        return pd.DataFrame({"block": pdf["block"].iloc[0], "i": got["rows"][row[~end]], "pos": pos[~end], "sym": sym[~end]})

    rules = df.filter("kind = 'rules'").select("block", "data").mapInPandas(run_rules, grammar.RULES)
    return rules, df.filter("kind <> 'rules'").select("block", "kind", "data").groupBy("block").applyInPandas(run_cseq, grammar.CSEQ)
