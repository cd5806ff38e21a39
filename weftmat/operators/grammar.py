"""Pair-replacement grammars of row blocks, their expansion, and products evaluated on them.

A block's rows are one symbol sequence in which rows never join. While some adjacent pair occurs twice, the most frequent
one (ties: the smallest) becomes a rule and is replaced everywhere. Rules refer to smaller symbols
only; level is one more than that of the deeper child, terminals being 0. Each block is a bounded task of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.plans.scratch import materialize

RULES = "block bigint, nt bigint, left bigint, right bigint, level int"
CSEQ = "block bigint, i bigint, pos bigint, sym bigint"


def repair(rows: list[list[int]], first_nt: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (rule k defines symbol first_nt + k) and the replaced rows.

    Occurrences are indexed by pair, so a replacement touches its own places only; stale index entries are skipped.
    """
    import heapq

    sym, nxt, prv = [], [], []
    for r in rows:
        base = len(sym)
        sym += r
        nxt += [*range(base + 1, base + len(r)), -1] if r else []
        prv += [-1, *range(base, base + len(r) - 1)] if r else []
    heads = list(np.cumsum([0] + [len(r) for r in rows]))
    where: dict[tuple[int, int], set[int]] = {}
    for i, n in enumerate(nxt):
        if n >= 0:
            where.setdefault((sym[i], sym[n]), set()).add(i)
    heap = [(-len(v), p) for p, v in where.items() if len(v) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []

    def add(i: int, touched: set) -> None:
        if i >= 0 and nxt[i] >= 0:
            p = (sym[i], sym[nxt[i]])
            where.setdefault(p, set()).add(i)
            touched.add(p)

    def gone(i: int, touched: set) -> None:
        if i >= 0 and nxt[i] >= 0:
            p = (sym[i], sym[nxt[i]])
            where.get(p, set()).discard(i)
            touched.add(p)

    while heap:
        n, pair = heapq.heappop(heap)
        places = where.get(pair, set())
        if len(places) != -n:
            if len(places) > 1:
                heapq.heappush(heap, (-len(places), pair))
            continue
        picked, last = [], -1
        for i in sorted(places):  # places that overlap, as in aaa, count from the left
            if i != last:
                picked.append(i)
                last = nxt[i]
        if len(picked) < 2:
            continue
        new, touched = first_nt + len(rules), set()
        rules.append(pair)
        for i in picked:
            j = nxt[i]
            if j < 0 or (sym[i], sym[j]) != pair:
                continue
            gone(prv[i], touched)
            gone(i, touched)
            gone(j, touched)
            sym[i], nxt[i] = new, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            sym[j] = -1
            add(prv[i], touched)
            add(i, touched)
        where.pop(pair, None)
        for p in touched:
            if p != pair and len(where.get(p, ())) > 1:
                heapq.heappush(heap, (-len(where[p]), p))
    out = []
    for r, h in zip(rows, heads, strict=False):
        row, i = [], h if r else -1
        while i >= 0:
            row.append(sym[i])
            i = nxt[i]
        out.append(row)
    return rules, out


def repair_text(text: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """Alphabet, rules and symbols of a text as one row: character k of the sorted alphabet is symbol k + 1."""
    alphabet = sorted(set(text))
    rank = {c: k + 1 for k, c in enumerate(alphabet)}
    rules, rows = repair([[rank[c] for c in text]], len(alphabet) + 1)
    return "".join(alphabet), rules, rows[0]


def expand_text(alphabet: str, rules: list[tuple[int, int]], symbols: list[int]) -> str:
    words = ["", *alphabet]
    for a, b in rules:
        words.append(words[a] + words[b])
    return "".join(words[s] for s in symbols)


def levels(rules: list[tuple[int, int]], first_nt: int) -> list[int]:
    out: list[int] = []
    for pair in rules:
        out.append(1 + max(out[s - first_nt] if s >= first_nt else 0 for s in pair))
    return out


def compress(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, cseq) from (block, i, seq), both from one written table, so each block is compressed once. Blocks, which bound a task, are the caller's choice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        rows = [[int(x) for x in s] for s in pdf["seq"]]
        first = max((max(r) for r in rows if r), default=0) + 1
        rules, out = repair(rows, first)
        block = int(pdf["block"].iloc[0])
        r = pd.DataFrame([(block, 0, first + k, a, b, lv) for k, ((a, b), lv) in enumerate(zip(rules, levels(rules, first), strict=True))], columns=["block", "kind", "x", "y", "z", "level"])
        c = pd.DataFrame([(block, 1, i, k, s, 0) for i, row in zip(pdf["i"], out, strict=True) for k, s in enumerate(row)], columns=["block", "kind", "x", "y", "z", "level"])
        return pd.concat([r, c]).astype("int64")

    both = seqs.select(F.col("block").cast("bigint"), "i", "seq").groupBy("block").applyInPandas(run, "block bigint, kind bigint, x bigint, y bigint, z bigint, level bigint")
    both = materialize(both, "grammar")
    rules = both.filter("kind = 0").select("block", F.col("x").alias("nt"), F.col("y").alias("left"), F.col("z").alias("right"), F.col("level").cast("int"))
    return rules, both.filter("kind = 1").select("block", F.col("x").alias("i"), F.col("y").alias("pos"), F.col("z").alias("sym"))


def _by_block(rules: DataFrame, cseq: DataFrame, fn, schema: str) -> DataFrame:
    # rules and cseq may come from one plan: new aliases keep their columns apart
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy("block")
    return fresh(rules).cogroup(fresh(cseq)).applyInPandas(fn, schema)


def expand(rules: DataFrame, cseq: DataFrame) -> DataFrame:
    """(block, i, seq) of terminals; rows without symbols are not in cseq and so not here either."""

    def run(r: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        text: dict[int, list[int]] = {}
        for nt, a, b in r.sort_values("nt")[["nt", "left", "right"]].itertuples(index=False):
            text[nt] = text.get(a, [a]) + text.get(b, [b])
        c = c.sort_values(["i", "pos"])
        rows = [(int(c["block"].iloc[0]), int(i), [x for s in g for x in text.get(s, [s])]) for i, g in c.groupby("i")["sym"]] if len(c) else []
        return pd.DataFrame(rows, columns=["block", "i", "seq"])

    return _by_block(rules, cseq, run, "block bigint, i bigint, seq array<bigint>")


def right_multiply(rules: DataFrame, cseq: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, y) where weights is (sym, w): the product of each terminal's value and vector element; rows without symbols are left out.

    A block's rules, symbols and the weights of its own terminals meet in one task, whatever the depth of the rules: they are
    valued once each, a level at a time in arrays; no block is expanded and no vector has to fit a task.
    """
    kind = weights.schema["w"].dataType.simpleString()
    dtype = np.int64 if kind in ("bigint", "int") else np.float64
    out_kind = "bigint" if dtype is np.int64 else "double"
    used = rules.select("block", F.explode(F.array("left", "right")).alias("sym")).union(cseq.select("block", "sym")).distinct()
    w = used.join(weights.select("sym", F.col("w").cast(out_kind).alias("w")), "sym")
    none = F.lit(None).cast(out_kind)
    each = (
        rules.select("block", F.lit(0).alias("kind"), F.col("nt").alias("x"), F.col("left").alias("y"), F.col("right").alias("z"), F.col("level").cast("bigint").alias("level"), none.alias("w"))
        .union(cseq.select("block", F.lit(1), "i", "sym", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), none))
        .union(w.select("block", F.lit(2), "sym", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "w"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, t = (pdf[pdf["kind"] == k] for k in range(3))
        names = np.sort(np.concatenate([t["x"].to_numpy(np.int64), r["x"].to_numpy(np.int64)]))
        place = lambda x: np.searchsorted(names, x.to_numpy(np.int64))
        val = np.zeros(len(names), dtype)
        val[place(t["x"])] = t["w"].to_numpy(dtype)
        for _, g in r.groupby("level"):
            val[place(g["x"])] = val[place(g["y"])] + val[place(g["z"])]
        rows, which = np.unique(c["x"].to_numpy(np.int64), return_inverse=True)
        y = np.zeros(len(rows), dtype)
        np.add.at(y, which, val[place(c["y"])])
        return pd.DataFrame({"i": rows, "y": y})

    return each.groupBy("block").applyInPandas(run, f"i bigint, y {out_kind}")


def symbol_masses(rules: DataFrame, cseq: DataFrame, y: DataFrame) -> DataFrame:
    """(sym, mass) of terminals, the sum of y over their occurrences: mass is pushed down from rules to children.

    With it z_j = sum of value * mass over the terminals of column j: the left product on the grammar.
    """
    start = cseq.join(y, "i").groupBy("block", "sym").agg(F.sum("y").alias("mass"))

    def run(r: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        mass: Counter = Counter()
        for s, m in c[["sym", "mass"]].itertuples(index=False):
            mass[s] += m
        for nt, a, b in r.sort_values("nt", ascending=False)[["nt", "left", "right"]].itertuples(index=False):
            m = mass.pop(nt, 0)
            mass[a] += m
            mass[b] += m
        return pd.DataFrame(mass.items(), columns=["sym", "mass"])

    kind = start.schema["mass"].dataType.simpleString()
    return _by_block(rules, start, run, f"sym bigint, mass {kind}").groupBy("sym").agg(F.sum("mass").alias("mass"))


def code_points(df: DataFrame, text: str) -> DataFrame:
    """df plus pos, sym: the code point of every character of a text column."""
    return df.select("*", F.posexplode(F.split(text, "")).alias("pos", "c")).withColumn("sym", F.ascii("c")).drop("c")


def code_point_seqs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(block, i, seq) for compress(): each text one row and block of its own, code points plus one, so 0 stays free."""
    return df.select(F.col(key).alias("block"), F.lit(0).cast("bigint").alias("i"), F.transform(F.split(text, ""), lambda c: (F.ascii(c) + 1).cast("bigint")).alias("seq"))


def expand_texts(rules: DataFrame, cseq: DataFrame) -> DataFrame:
    """(block, text) of grammars over code_point_seqs()."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"block": pdf["block"], "text": ["".join(chr(x - 1) for x in s) for s in pdf["seq"]]})

    return expand(rules, cseq).select("block", "seq").mapInPandas(run, "block bigint, text string")


def text_grammars(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alphabet, left, right, symbols), a row for each row of df: the grammar of its text, as repair_text gives it, in arrays.

    Every text is a block of its own, so rows that repeat a key stay apart and no symbol becomes a row. A written table.
    """
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one text at a time: a batch of long ones does not pile up
                alphabet, rules, symbols = repair_text(b.column(1)[k].as_py() or "")
                sides = [pa.array([[r[s] for r in rules]], ints) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([alphabet]), *sides, pa.array([symbols], ints)], [key, "alphabet", "left", "right", "symbols"])

    rows = df.select(key, text).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    kind = df.schema[key].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"`{key}` {kind}, alphabet string, left array<int>, right array<int>, symbols array<int>"), "text_grammars")


def expand_text_grammars(grammars: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of text_grammars(), a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, x, y, z = (b.column(k).to_pylist() for k in range(1, 5))
            texts = [expand_text(p, list(zip(q, r, strict=True)), t) for p, q, r, t in zip(a, x, y, z, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, text])

    kind = grammars.schema[key].dataType.simpleString()
    return grammars.select(key, "alphabet", "left", "right", "symbols").mapInArrow(run, f"`{key}` {kind}, `{text}` string")


def expanded_lengths(rules: DataFrame, cseq: DataFrame) -> DataFrame:
    """(block, length): the number of terminals that a block's sequences stand for."""
    ones = rules.select("block", F.explode(F.array("left", "right")).alias("sym")).union(cseq.select("block", "sym")).select("sym").distinct().withColumn("w", F.lit(1).cast("bigint"))
    rows = right_multiply(rules, cseq, ones)
    return cseq.select("block", "i").distinct().join(rows, "i").groupBy("block").agg(F.sum("y").alias("length"))


def grammar_stats(rules: DataFrame, cseq: DataFrame) -> DataFrame:
    """block, n_rules, n_symbols, depth and the estimated bytes ((2R + (R + C) * log) / 8 + 1)."""
    r = rules.groupBy("block").agg(F.count(F.lit(1)).alias("n_rules"), F.max("level").alias("depth"), F.max("nt").alias("top"))
    c = cseq.groupBy("block").agg(F.count(F.lit(1)).alias("n_symbols"), F.max("sym").alias("top_c"))
    j = c.join(r, "block", "left").fillna(0, ["n_rules", "depth"]).withColumn("n", F.greatest(F.coalesce("top", F.lit(0)), "top_c"))
    est = F.expr("(2 * n_rules + (n_rules + n_symbols) * length(bin(n))) div 8 + 1")
    return j.select("block", "n_rules", "n_symbols", "depth", est.alias("est_bytes"))
