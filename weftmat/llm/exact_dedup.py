"""Exact duplicates by distributed MSD radix partitioning.

Each round deals the rows that are still undecided by the next digit, a run of successive bytes of the
text that grows from round to round, under the group of their bytes so far. A group with one row is
decided: its text is unique. A group whose digit is shorter than the round's width has reached the end of its
texts: its rows are equal. Only larger, unfinished groups go on. No digest decides equality; all bytes of
the rows that stay together have been compared.

The counts of a round are map-side combined, so a group holding a third of all rows costs one row
per task in the shuffle. Rows find their new group by a join with the groups of two rows or more. In the first
round, where all texts take part, that is a broadcast while the groups' counted size is small; otherwise it is a
shuffled join, whose hot keys adaptive execution splits. Later rounds only see rows that share their first bytes.
The rows that go on are written to the shared folder, so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.llm.common import materialize, sized

#: Bytes compared in the first rounds; the last entry is multiplied by GROW from then on.
WIDTHS = (96, 928, 7168)
GROW = 16


ADDED = ("__keep_id", "__group_size", "__kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None) -> DataFrame:
    """Returns the payload columns of every row (default: all) plus __keep_id, __group_size, __kept.

    Of equal texts the row with the largest id stays; of rows with that id, exactly one. Null text
    equals empty text; null ids sort lowest. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    out = _decided(docs, id_col, text_col, payload)
    names = docs.columns if payload is None else payload
    return out.select(*[F.col("__row").getField(c).alias(c) for c in names if c not in ADDED], *ADDED)


def _decided(docs: DataFrame, id_col: str, text_col: str, payload: list[str] | None) -> DataFrame:
    """__row (a struct of the payload), __keep_id, __group_size, __kept."""
    payload = list(docs.columns) if payload is None else payload
    # A payload with the text is the only copy of it that travels; else the bytes still to compare travel alone.
    within = text_col in payload
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in payload]).alias("__row"), F.col(id_col).alias("__id"), F.lit(0).cast("bigint").alias("__gid"), *([] if within else [body.alias("__rest")]))
    rest = F.coalesce(F.col("__row").getField(text_col), F.lit("")).cast("binary") if within else F.col("__rest")
    alone = lambda df: df.select("__row", F.col("__id").alias("__keep_id"), F.lit(1).cast("bigint").alias("__group_size"), F.lit(True).alias("__kept"))
    on, results, level, width, past, total = ["__gid", "__digit"], [], 0, 0, 0, None
    while True:
        width = WIDTHS[level] if level < len(WIDTHS) else width * GROW
        dealt = rows.withColumn("__digit", F.substring(rest, past + 1, width))
        best = F.max(F.struct(F.col("__id"), F.col("__rid"))) if level else F.lit(None)
        groups = dealt.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), best.alias("__best")).filter(F.col("__n") >= 2)
        groups = groups.withColumn("__next", F.monotonically_increasing_id())
        groups = materialize(groups if level else groups.drop("__best"), f"groups{level}", rows=total)
        n, nbytes, total = groups.agg(F.count(F.lit(1)), F.sum(F.length("__digit") + 64), F.sum("__n")).first()
        if not n:
            results.append(alone(rows))
            break
        nbytes = nbytes if level == 0 else None
        results.append(alone(dealt.join(sized(groups.select(*on), nbytes), on, "left_anti")))
        joined = dealt.join(sized(groups, nbytes), on)
        ended = F.length("__digit") < width
        if level:
            keeps = F.col("__id").eqNullSafe(F.col("__best.__id")) & (F.col("__rid") == F.col("__best.__rid"))
            results.append(joined.filter(ended).select("__row", F.col("__best.__id").alias("__keep_id"), F.col("__n").alias("__group_size"), keeps.alias("__kept")))
            joined = joined.filter(~ended)
        # After the first round even ended groups go on: their rows need a row number that stays.
        rid = (F.col("__rid") if level else F.monotonically_increasing_id()).alias("__rid")
        cut = [] if within else [F.expr(f"substring(__rest, {width + 1})").alias("__rest")]
        rows = materialize(joined.select("__row", "__id", rid, F.col("__next").alias("__gid"), *cut), f"rows{level}")
        past += width if within else 0
        level += 1
        if level > 1 and rows.isEmpty():
            break
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select("__row", *ADDED)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    return _decided(docs, id_col, text_col, None).filter("__kept").select("__row.*")


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = docs.select("doc_id", "text", digest.alias("text_sha256"))
    out = exact_dedup(rows, payload=["doc_id", "text_sha256"])
    return out.select("doc_id", F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"), F.col("__kept").alias("kept"), "text_sha256")
