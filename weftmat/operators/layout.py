"""Layouts of code sequences: frequencies, hybrid split, alphabet, sorted deltas. Sequences are rows (i, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmat.operators.encode import number_rows
from weftmat.plans.scratch import small


#: Ranks whose gaps one task adds up.
RANKS_A_TASK = 100_000


def code_freq(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("freq"))


def topk_codes(codes: DataFrame, k: int) -> DataFrame:
    """The k most frequent codes, ties by code."""
    return code_freq(codes).orderBy(F.desc("freq"), "code").limit(k)


def topk_codes_per_column(codes: DataFrame, k: int) -> DataFrame:
    f = codes.groupBy("j", "code").agg(F.count(F.lit(1)).alias("freq"))
    r = F.row_number().over(Window.partitionBy("j").orderBy(F.desc("freq"), "code"))
    return f.withColumn("rank", r).filter(F.col("rank") <= k)


def adjacent_pairs(seqs: DataFrame) -> DataFrame:
    """(a, b) of neighbours inside each row, one row per occurrence."""
    return seqs.filter("size(seq) > 1").select(F.explode(F.expr("zip_with(slice(seq, 1, size(seq) - 1), slice(seq, 2, size(seq) - 1), (a, b) -> struct(a, b))")).alias("p")).select("p.a", "p.b")


def bigram_freq(seqs: DataFrame) -> DataFrame:
    return adjacent_pairs(seqs).groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))


def allpair_freq(codes: DataFrame, top: DataFrame) -> DataFrame:
    """Frequency of ordered pairs of top codes inside a row. Rows hold at most `cols` codes, so a row's pairs are bounded."""
    seqs = codes.join(small(top.select("code")), "code", "left_semi").groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "code"))), lambda x: x["code"]).alias("seq"))
    pairs = F.expr("flatten(transform(seq, (a, k) -> transform(slice(seq, k + 2, size(seq)), b -> struct(a, b))))")
    return seqs.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("freq"))


def column_pair_freq(pair_freq: DataFrame, cols: int) -> DataFrame:
    """Pair frequencies above one, added up by the columns of the two codes."""
    c = lambda x: F.pmod(F.col(x) - 1, F.lit(cols)).cast("int")
    return pair_freq.filter("freq > 1").groupBy(c("a").alias("c1"), c("b").alias("c2")).agg(F.sum("freq").alias("freq"))


def hybrid_split(seqs: DataFrame, threshold: int = 1) -> DataFrame:
    """(i, pos, code, part): part B where all of a code's neighbour pairs occur at most threshold times, else A."""
    freq = bigram_freq(seqs)
    at = seqs.select("i", F.posexplode("seq").alias("pos", "code"))
    w = Window.partitionBy("i").orderBy("pos")
    at = at.withColumns({"prev": F.lag("code").over(w), "next": F.lead("code").over(w)})
    # the frequency of the pair that starts at a position; its successor reads it by lag
    at = at.join(freq.select(F.col("a").alias("code"), F.col("b").alias("next"), "freq"), ["code", "next"], "left")
    at = at.withColumn("before", F.lag("freq").over(w))
    rare = lambda c: F.col(c).isNull() | (F.col(c) <= threshold)
    lone = F.col("prev").isNull() & F.col("next").isNull()
    return at.select("i", "pos", "code", F.when(~lone & rare("freq") & rare("before"), "B").otherwise("A").alias("part"))


def alphabet(codes: DataFrame) -> DataFrame:
    """(rank, code): the distinct codes and 0 in ascending order."""
    every = codes.select(F.col("code").cast("bigint").alias("code")).distinct().union(codes.sparkSession.range(1).select(F.col("id").alias("code"))).distinct()
    return number_rows(every, ["code"], "rank").select("rank", "code")


def alphabet_gaps(alpha: DataFrame) -> DataFrame:
    """(rank, gap) to the code before."""
    before = alpha.select((F.col("rank") + 1).alias("rank"), F.col("code").alias("last"))
    return alpha.join(before, "rank", "left").select("rank", (F.col("code") - F.coalesce("last", F.lit(0))).alias("gap"))


def alphabet_from_gaps(gaps: DataFrame) -> DataFrame:
    """(rank, code) from (rank, gap): running sums in ranges of ranks, each shifted by the sum of those before it."""
    w = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = gaps.withColumn("part", F.expr(f"rank div {RANKS_A_TASK}"))
    sums = at.groupBy("part").agg(F.sum("gap").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for RANKS_A_TASK ranks
    shift = sums.select("part", before.alias("shift"))
    return at.withColumn("own", F.sum("gap").over(w)).join(shift, "part").select("rank", (F.col("own") + F.col("shift")).alias("code"))


def to_ranks(codes: DataFrame, alpha: DataFrame) -> DataFrame:
    """The column code of a table replaced by its rank in the alphabet."""
    return codes.join(small(alpha), "code").drop("code").withColumnRenamed("rank", "code")


def from_ranks(ranks: DataFrame, alpha: DataFrame) -> DataFrame:
    """The ranks in column code replaced by the codes they stand for."""
    return ranks.withColumnRenamed("code", "rank").join(small(alpha), "rank").drop("rank")


def locate(seqs: DataFrame, wanted: list[int]) -> DataFrame:
    """(code, i, pos) of every occurrence of the wanted codes."""
    at = seqs.select("i", F.posexplode("seq").alias("pos", "code"))
    return at.filter(F.col("code").isin(wanted)).select("code", "i", "pos")


def ole_encode(seqs: DataFrame) -> DataFrame:
    """(i, seq): sorted, first code kept, then gaps. A code repeated in a row has no such form and fails."""
    s = seqs.withColumn("s", F.array_sort("seq"))
    gaps = F.expr("CASE WHEN size(array_distinct(s)) < size(s) THEN raise_error('repeated code in a row') ELSE transform(s, (x, k) -> x - CASE WHEN k = 0 THEN 0 ELSE s[k - 1] END) END")
    return s.select("i", gaps.alias("seq"))


def ole_decode(gaps: DataFrame) -> DataFrame:
    """(i, pos, code) by running sums."""
    at = gaps.select("i", F.posexplode("seq").alias("pos", "gap"))
    return at.select("i", "pos", F.sum("gap").over(Window.partitionBy("i").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("code"))


def rows_from_terminators(symbols: DataFrame) -> DataFrame:
    """(block, pos, sym) with 0 after each row, as in an imported file, to (block, row, pos, sym); ordered inside each block."""
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return symbols.withColumn("row", F.coalesce(F.sum((F.col("sym") == 0).cast("bigint")).over(w), F.lit(0))).filter("sym <> 0")


def compact(df: DataFrame, col: str, name: str) -> DataFrame:
    """df plus name: the rank of the column's value among its distinct values, from 0. Any number of values."""
    ranks = number_rows(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], name)
    return df.join(small(ranks), col)
