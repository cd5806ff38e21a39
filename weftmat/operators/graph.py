"""Degrees and PageRank on edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame, drop_self_loops: bool = False, shift: int = 0, transpose: bool = False) -> DataFrame:
    """Distinct edges. Without drop_self_loops loops stay, as in the file pipeline."""
    s, d = ("dst", "src") if transpose else ("src", "dst")
    e = edges.select((F.col(s) + shift).alias("src"), (F.col(d) + shift).alias("dst")).distinct()
    return e.filter("src <> dst") if drop_self_loops else e


def degrees(edges: DataFrame, side: str = "src") -> DataFrame:
    return edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node) without outgoing edges."""
    return nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def edge_stats(edges: DataFrame) -> DataFrame:
    ends = F.array("src", "dst")
    return edges.agg(F.min(F.array_min(ends)).alias("min_node"), F.max(F.array_max(ends)).alias("max_node"), F.count(F.lit(1)).alias("arcs"), F.count_if(F.expr("src = dst")).alias("self_loops"))


def pagerank(edges: DataFrame, nodes: int, rounds: int = 100, damping: float = 0.9, eps: float = -1.0, save=None, moves: list[float] | None = None) -> DataFrame:
    """(node, rank) for nodes 0 .. nodes - 1 and distinct edges.

    Each round spreads d * rank / outdegree along edges, and d * the dangling nodes' mass + 1 - d evenly. It stops after
    rounds, or once the ranks move by less than eps in sum. save(df, round) writes a table to a shared folder
    and reads it back; with it a long loop keeps a short lineage. moves, if given with eps, receives each round's movement.
    """
    spark = edges.sparkSession
    deg = degrees(edges).withColumnRenamed("degree", "out")
    every = spark.range(nodes).select(F.col("id").alias("node")).join(deg, "node", "left")
    state = every.withColumn("rank", F.lit(1.0 / nodes))
    for k in range(1, rounds + 1):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = edges.join(state.filter("out IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share")), "src")
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        new = every.join(got, "node", "left").crossJoin(F.broadcast(lost))
        new = new.select("node", "out", (damping * F.coalesce("got", F.lit(0.0)) + (damping * F.col("lost") + (1 - damping)) / nodes).alias("rank"))
        if save:
            new = save(new, k)
        if eps >= 0:
            moved = new.select("node", F.col("rank").alias("r1")).join(state.select("node", "rank"), "node").agg(F.sum(F.abs(F.col("r1") - F.col("rank")))).first()[0]
            state = new
            if moves is not None:
                moves.append(moved)
            if moved < eps:
                break
        state = new
    return state.select("node", "rank")


def topk(ranks: DataFrame, k: int = 3) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "node").limit(k)


def summary(edges: DataFrame, nodes: int, ranks: DataFrame) -> DataFrame:
    """nodes, dangling (nodes without outgoing edges), arcs, rank_sum."""
    deg = degrees(edges)
    every = edges.sparkSession.range(nodes).select(F.col("id").alias("node")).join(deg, "node", "left").join(ranks.select("node", "rank"), "node", "left")
    return every.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree").isNull()).alias("dangling"), F.sum("degree").alias("arcs"), F.sum("rank").alias("rank_sum"))
