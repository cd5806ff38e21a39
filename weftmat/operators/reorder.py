"""Column similarity and column orders."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmat.operators import layout


def csm(e: DataFrame, cols: int) -> DataFrame:
    """(c1, c2, w) for all c1 < c2: w = distinct value pairs less rows where both cells are nonzero, at most 0.

    Each row's cells meet in one array of at most `cols` structs; value pairs are counted once each before they are
    added up by column pair.
    """
    rows = e.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    pairs = F.expr("flatten(transform(c, (a, k) -> transform(slice(c, k + 2, size(c)), b -> struct(a.j AS c1, b.j AS c2, a.v AS v1, b.v AS v2))))")
    each = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("c1", "c2", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    w = each.groupBy("c1", "c2").agg((F.count(F.lit(1)) - F.sum("n")).alias("w"))
    n = e.sparkSession.range(cols).select(F.col("id").cast("int").alias("c"))
    every = n.select(F.col("c").alias("c1")).join(F.broadcast(n.select(F.col("c").alias("c2"))), F.expr("c1 < c2"))
    return every.join(w, ["c1", "c2"], "left").withColumn("w", F.coalesce("w", F.lit(0)))


def csm_blocks(e: DataFrame, block: str) -> DataFrame:
    """(block, c1, c2, w) of the pairs that share a row, with the similarity of each row block by itself; block is an expression over i."""
    rows = e.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    pairs = F.expr("flatten(transform(c, (a, k) -> transform(slice(c, k + 2, size(c)), b -> struct(a.j AS c1, b.j AS c2, a.v AS v1, b.v AS v2))))")
    each = rows.select(F.expr(block).alias("block"), F.explode(pairs).alias("p")).select("block", "p.*").groupBy("block", "c1", "c2", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("block", "c1", "c2").agg((F.count(F.lit(1)) - F.sum("n")).alias("w"))


def order_blocks(sim: DataFrame, cols: int, method: str = "pathcover") -> DataFrame:
    """(block, pos, col): an order of the columns for each row block, one bounded task a block."""
    import pandas as pd

    solve = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = solve(list(zip(pdf["c1"], pdf["c2"], pdf["w"], strict=True)), cols)
        return pd.DataFrame({"block": pdf["block"].iloc[0], "pos": range(cols), "col": order})

    return sim.groupBy("block").applyInPandas(run, "block bigint, pos int, col int")


def apply_block_orders(codes: DataFrame, orders: DataFrame) -> DataFrame:
    """(block, i, pos, code) from (block, i, j, code): each block's rows in its own order."""
    at = codes.join(orders.select("block", F.col("col").alias("j"), F.col("pos").alias("__p")), ["block", "j"])
    return at.select("block", "i", (F.row_number().over(Window.partitionBy("i").orderBy("__p")) - 1).alias("pos"), "code")


def frequent_order(codes: DataFrame, cols: int, k: int) -> list[int]:
    """The converter's column order: from how often the k most frequent codes of each column share a row."""
    freq = layout.column_pair_freq(layout.allpair_freq(codes, layout.topk_codes_per_column(codes, k)), cols)
    return path_cover_frequent([(r.c1, r.c2, r.freq) for r in freq.collect()], cols)  # at most cols * cols rows


def reordered_sequences(codes: DataFrame, order: list[int]) -> DataFrame:
    """(i, seq): each row's codes in the given column order."""
    at = apply_permutation(codes, order)
    return at.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("seq"))


def retest(codes: DataFrame, cols: int, block: str, sim: DataFrame, methods: tuple[str, ...] = ("pathcover", "contract", "matching")) -> DataFrame:
    """(method, block, n_rules, n_symbols, est_bytes): grammar sizes of each block in its own order by each method, and in the given one."""
    from weftmat.operators import grammar

    codes = codes.withColumn("block", F.expr(block).cast("bigint"))
    out = None
    for m in ("none", *methods):
        at = codes.withColumn("pos", F.col("j")) if m == "none" else apply_block_orders(codes, order_blocks(sim, cols, m))
        seqs = at.groupBy("block", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("seq"))
        got = grammar.grammar_stats(*grammar.compress(seqs)).select(F.lit(m).alias("method"), "block", "n_rules", "n_symbols", "est_bytes")
        out = got if out is None else out.unionByName(got)
    return out


def prune_local(sim: DataFrame, k: int) -> DataFrame:
    """Pairs among the k most similar of either column."""
    both = sim.select(F.col("c1").alias("c"), "c1", "c2", "w").union(sim.select(F.col("c2").alias("c"), "c1", "c2", "w"))
    r = F.row_number().over(Window.partitionBy("c").orderBy("w", "c1", "c2"))
    return both.withColumn("r", r).filter(F.col("r") <= k).select("c1", "c2", "w").distinct()


def prune_global(sim: DataFrame, k: int, cols: int) -> DataFrame:
    return sim.orderBy("w", "c1", "c2").limit(min(k * cols, cols * (cols - 1) // 2))


def path_cover(pairs: Iterable[tuple[int, int, float]], cols: int) -> list[int]:
    """A column order: pairs by ascending weight join paths whose ends they are; paths follow by their smallest end column."""
    return _paths(((a, b) for _, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in pairs)), cols)


def path_cover_frequent(pairs: Iterable[tuple[int, int, int]], cols: int) -> list[int]:
    """As path_cover, from pair frequencies: pairs in descending frequency are taken from the median outwards."""
    ranked = sorted((-f, a, b) for a, b, f in pairs if a != b)
    mid = len(ranked) // 2
    return _paths(((ranked[k][1], ranked[k][2]) for k in sorted(range(len(ranked)), key=lambda k: (abs(k - mid), k))), cols)


def _paths(pairs: Iterable[tuple[int, int]], cols: int) -> list[int]:
    parent, near = list(range(cols)), [[] for _ in range(cols)]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb and len(near[a]) < 2 and len(near[b]) < 2:
            near[a].append(b)
            near[b].append(a)
            parent[max(ra, rb)] = min(ra, rb)
    seen, out = [False] * cols, []
    for start in range(cols):
        at = None if seen[start] or len(near[start]) > 1 else start
        while at is not None:
            seen[at] = True
            out.append(at)
            at = next((c for c in near[at] if not seen[c]), None)
    return out


def path_cover_contract(pairs: Iterable[tuple[int, int, float]], cols: int) -> list[int]:
    """Path cover by contraction with updated weights.

    Two paths are as similar as their most similar columns, inner ones too, so the paths that belong together most are joined first, by
    the best of their end columns. After a join the new path's similarity to every other is the better of the two it
    came from. Pairs of paths without a known pair of ends are never joined.
    """
    w = {(min(a, b), max(a, b)): x for a, b, x in pairs if a != b}
    paths = {c: [c] for c in range(cols)}
    near: dict[int, dict[int, float]] = {c: {} for c in range(cols)}
    for (a, b), x in w.items():
        near[a][b] = near[b][a] = x
    heap = [(x, a, b) for (a, b), x in w.items()]
    heapq.heapify(heap)
    while heap:
        x, p, q = heapq.heappop(heap)
        if p not in paths or q not in paths or near[p].get(q) != x:
            continue
        ends = {(i, j): w.get((min(paths[p][i], paths[q][j]), max(paths[p][i], paths[q][j]))) for i in (0, -1) for j in (0, -1)}
        known = [(v, paths[p][i], paths[q][j], i, j) for (i, j), v in ends.items() if v is not None]
        if not known:
            continue
        _, _, _, i, j = min(known)
        head = paths[p] if i == -1 else paths[p][::-1]
        tail = paths[q] if j == 0 else paths[q][::-1]
        keep, gone = min(p, q), max(p, q)
        paths[keep] = head + tail
        del paths[gone]
        merged = {r: min(near[p].get(r, math.inf), near[q].get(r, math.inf)) for r in {*near[p], *near[q]} - {p, q}}
        for r in near.pop(gone):
            near[r].pop(gone, None)
        near[keep] = merged
        for r, v in merged.items():
            near[r][keep] = v
            heapq.heappush(heap, (v, min(keep, r), max(keep, r)))
    return [c for k in sorted(paths, key=lambda k: min(paths[k])) for c in paths[k]]


def _gain(w: float) -> int:
    return int(-w) // 256 + 1


def matching_weight(pairs: Iterable[tuple[int, int, float]], after: dict[int, int]) -> int:
    return sum(_gain(w) for a, b, w in pairs if after.get(min(a, b)) == max(a, b))


def matching_order(pairs: Iterable[tuple[int, int, float]], cols: int) -> list[int]:
    """Chains of a maximum-weight matching of columns to successors, by ascending start."""
    after = matching(pairs, cols)
    starts, out = set(range(cols)) - set(after.values()), []
    for c in sorted(starts):
        while c is not None:
            out.append(c)
            c = after.get(c)
    return out


def matching(pairs: Iterable[tuple[int, int, float]], cols: int) -> dict[int, int]:
    """Column to successor, c1 < c2: a matching of maximum weight.

    Successive shortest augmenting paths on the bipartite graph of predecessors and successors; each augmentation
    raises the total weight, and it ends when none does.
    """
    weight = {(min(a, b), max(a, b)): _gain(w) for a, b, w in pairs if w < 0}
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    while True:
        # longest gain from any free predecessor, over alternating paths (Bellman-Ford)
        gain = {a: 0 for a in range(cols) if a not in after}
        came: dict[int, int] = {}
        reach: dict[int, int] = {}
        for _ in range(2 * cols):
            moved = False
            for (a, b), w in weight.items():
                if a in gain and after.get(a) != b and gain[a] + w > reach.get(b, -1 << 62):
                    reach[b], came[b], moved = gain[a] + w, a, True
                    if b in before:
                        p = before[b]
                        if reach[b] - weight[p, b] > gain.get(p, -1 << 62):
                            gain[p] = reach[b] - weight[p, b]
            if not moved:
                break
        best = max((b for b in reach if b not in before), key=lambda b: (reach[b], -b), default=None)
        if best is None or reach[best] <= 0:
            break
        b = best
        while b is not None:
            a = came[b]
            b_next = after.get(a)
            after[a], before[b] = b, a
            b = b_next
    return after


def apply_permutation(e: DataFrame, order: list[int], code: str = "code") -> DataFrame:
    """(i, pos, code): each row's codes in the given column order, which is broadcast and holds every column once."""
    perm = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*map(F.lit, range(len(order)))))
    at = e.withColumn("__p", F.element_at(perm, F.col("j").cast("int")))
    return at.select("i", (F.row_number().over(Window.partitionBy("i").orderBy("__p")) - 1).alias("pos"), code)


#: Column orders by name, from (c1, c2, w) and the number of columns.
METHODS = {"pathcover": path_cover, "contract": path_cover_contract, "matching": matching_order}
