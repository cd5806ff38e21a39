"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression that is true where it rejects. On a bounded random sample the seconds of each group
of counts and of each rule by itself are measured, repeated and with an empty job's time taken off, and which
rules reject which rows. Rules then run in descending order of rejection per cost: of what is still there, and counting
only groups of counts that no earlier rule has needed. A filtering cascade computes a group of counts only for
the documents that are left when the first rule needs it. The order changes the work, never the verdict: a document is
kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmat.llm.common import WS_CHARS, row_of, text_or_empty, word_array

#: Rows of the sample on which cost and selectivity are measured, and how often; they decide the order only.
SAMPLE_ROWS, REPEATS = 512, 3
WINDOW = 8


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))


def n_capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))


def with_words(df: DataFrame) -> DataFrame:
    """__words, __n_words, __word_chars (code points in words), __h (word hashes), __n_distinct of these."""
    df = df.withColumn("__words", word_array(F.col("text")))
    df = df.withColumns({"__n_words": F.size("__words").cast("bigint"), "__word_chars": F.length(F.array_join("__words", "")).cast("bigint"), "__h": F.transform("__words", lambda w: F.xxhash64(w))})
    return df.withColumn("__n_distinct", F.size(F.array_distinct("__h")).cast("bigint"))


def with_windows(df: DataFrame) -> DataFrame:
    """__n_repeat_words: only texts with a repeated window hash sort their windows, compare the words, and mark what equal windows cover."""
    items = ", ".join(f"__h[i{f' + {k}' if k else ''}]" for k in range(WINDOW))
    df = df.withColumn("__win", F.expr(f"CASE WHEN __n_words >= {WINDOW} THEN transform(sequence(0, int(__n_words) - {WINDOW}), i -> xxhash64({items})) ELSE cast(array() AS array<bigint>) END"))
    # (window hash, position), sorted; then the positions whose window equals a neighbour's, in text order
    df = df.withColumn("__pos", F.expr("CASE WHEN size(array_distinct(__win)) < size(__win) THEN sort_array(transform(__win, (h, i) -> struct(h, i))) END")).drop("__win")
    window = lambda x: f"slice(__words, {x}.i + 1, {WINDOW})"
    again = " OR ".join(f"({there} AND __pos[{k}].h = x.h AND {window(f'__pos[{k}]')} = {window('x')})" for there, k in (("k > 0", "k - 1"), ("k + 1 < size(__pos)", "k + 1")))
    df = df.withColumn("__pos", F.expr(f"CASE WHEN __pos IS NOT NULL THEN sort_array(transform(filter(transform(__pos, (x, k) -> struct(x.i AS i, {again} AS again)), x -> x.again), x -> x.i)) END"))
    covered = f"aggregate(__pos, named_struct('n', 0L, 'e', 0L), (a, i) -> named_struct('n', a.n + i + {WINDOW} - greatest(a.e, cast(i AS bigint)), 'e', cast(i + {WINDOW} AS bigint)), a -> a.n)"
    return df.withColumn("__n_repeat_words", F.expr(f"CASE WHEN __pos IS NULL THEN 0L ELSE {covered} END")).drop("__pos")


def with_lines(df: DataFrame) -> DataFrame:
    """__n_lines with a word in them, __n_dup_lines equal to an earlier one."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(WS_CHARS)) != "")
    df = df.withColumn("__lines", lines)
    return df.withColumns({"__n_lines": F.size("__lines").cast("bigint"), "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint")}).drop("__lines")


#: Groups of counts over the column text: how to add them, and their columns. Windows build on words.
GROUPS = {"words": (with_words, ("n_words", "word_chars", "n_distinct")), "windows": (with_windows, ("n_repeat_words",)), "lines": (with_lines, ("n_lines", "n_dup_lines"))}
COUNTS = tuple(f"__{c}" for _, cols in GROUPS.values() for c in cols) + ("__n_symbols",)


@dataclass(frozen=True)
class Rule:
    """name; groups of counts it needs; reject(text) -> boolean column, true where it rejects."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Column], Column]


def _c(name: str) -> Column:
    return F.col(f"__{name}")


#: The two base rules and the method's own ones. Empty texts fail too_few_words.
RULES = (
    Rule("too_few_words", ("words",), lambda t: _c("n_words") < 20),
    Rule("repeated_words", ("words", "windows"), lambda t: _c("n_repeat_words") * 100 > _c("n_words") * 30),
    Rule("duplicate_lines", ("lines",), lambda t: (_c("n_dup_lines") >= 5) & (_c("n_dup_lines") * 100 > _c("n_lines") * 30)),
    Rule("few_distinct_words", ("words",), lambda t: (_c("n_words") < 2000) & (_c("n_distinct") * 4 < _c("n_words"))),
    Rule("symbols", ("words",), lambda t: n_symbols(t) * 10 > _c("n_words")),
    Rule("capitals", (), lambda t: n_capitals(t) * 100 > F.length(t) * 40),
    Rule("word_length", ("words",), lambda t: (_c("word_chars") < _c("n_words") * 2) | (_c("word_chars") > _c("n_words") * 25)),
)


def _add(df: DataFrame, needs: tuple[str, ...], have: set[str]) -> DataFrame:
    for g in needs:
        if g not in have:
            df = GROUPS[g][0](df)
            have.add(g)
    return df


@dataclass(frozen=True)
class Measured:
    """Seconds of each group of counts and of each rule on the sample, and how many rows each set of rules rejects."""

    groups: dict[str, float]
    rules: dict[str, float]
    rejected: list[tuple[frozenset[str], int]]


def measure(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> Measured:
    """On a sample with a column text that is not null. A job runs REPEATS times and its least time counts, so compilation does not."""
    t = F.col("text")

    def seconds(df: DataFrame, *cols: Column) -> float:
        best = float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            df.agg(*[F.max(c) for c in cols]).collect()
            best = min(best, time.perf_counter() - began)
        return best

    sample = sample.persist()
    try:
        empty = seconds(sample, F.octet_length(t))
        groups, needed = {}, [g for g in GROUPS if any(g in r.needs for r in rules)]
        for g in needed:
            first = ("words",) if g == "windows" else ()
            with_it = seconds(_add(sample, (*first, g), set()), *[_c(c) for c in GROUPS[g][1]])
            groups[g] = max(0.0, with_it - empty - sum(groups[f] for f in first))
        full = _add(sample, tuple(needed), set()).select("text", *[_c(c) for g in needed for c in GROUPS[g][1]]).persist()
        try:
            empty = seconds(full, F.octet_length(t))
            cost = {r.name: max(0.0, seconds(full, r.reject(t)) - empty) for r in rules}
            hit = F.concat(*[F.when(r.reject(t), "1").otherwise("0") for r in rules])
            found = full.groupBy(hit.alias("hit")).count().collect()  # at most a row for each set of rules
        finally:
            full.unpersist()
    finally:
        sample.unpersist()
    return Measured(groups, cost, [(frozenset(r.name for r, h in zip(rules, row["hit"], strict=True) if h == "1"), row["count"]) for row in found])


def order_rules(m: Measured, rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Names by rejection per cost among the rows that earlier rules leave, best first; ties by name."""
    left, have, alive, order = {r.name: r for r in rules}, set(), m.rejected, []
    while left:

        def gain(r: Rule) -> float:
            cost = m.rules[r.name] + sum(m.groups[g] for g in r.needs if g not in have)
            return (sum(n for names, n in alive if r.name in names) + 0.1) / max(cost, 1e-4)

        best = min(left.values(), key=lambda r: (-gain(r), r.name))
        order.append(best.name)
        have.update(best.needs)
        alive = [(names, n) for names, n in alive if best.name not in names]
        del left[best.name]
    return order


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[str]:
    rows = docs.select(text_or_empty(text).alias("text"))
    share = 1.5 * SAMPLE_ROWS / max(1, docs.count())
    return order_rules(measure((rows.sample(share, 17) if share < 1 else rows).limit(SAMPLE_ROWS), rules), rules)


def _case(rules: tuple[Rule, ...], order: list[str]) -> Column:
    by, out = {r.name: r for r in rules}, None
    for name in order:
        cond = by[name].reject(F.col("text"))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """docs with the columns COUNTS and __rejected_by: the first rule in cascade order that rejects, or null.

    One CASE, evaluated up to the first hit. Null text is empty; an empty table gives an empty result. All columns pass
    through whatever their names, but those named as the added ones are replaced.
    """
    df = docs.select(row_of(docs, *COUNTS, "__rejected_by"), text_or_empty(text).alias("text"))
    df = _add(df, tuple(GROUPS), set())
    df = df.withColumns({"__n_symbols": n_symbols(F.col("text")).cast("bigint"), "at": F.monotonically_increasing_id()})
    # `at` keeps a caller's filter above the counts, which Spark would else evaluate again below it.
    rejected = F.when(F.col("at") >= 0, _case(rules, order or plan(docs, rules, text))).alias("__rejected_by")
    return df.select("row.*", *COUNTS, rejected)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """The documents no rule rejects, with their columns, whatever their names. Counts are computed once, for what earlier rules left."""
    by, have = {r.name: r for r in rules}, set()
    df = docs.select(row_of(docs), text_or_empty(text).alias("text"))
    for name in order or plan(docs, rules, text):
        df = _add(df, by[name].needs, have)
        # Spark must not push this filter below the projections of the counts, where it would evaluate them again.
        df = df.withColumn("at", F.monotonically_increasing_id())
        df = df.filter(~F.coalesce(by[name].reject(F.col("text")), F.lit(False)) & (F.col("at") >= 0))
    return df.select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    out = cascade(docs.select("doc_id", "text"))
    failed = (F.col("__n_words") < 20) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 30)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col(f"__{n}").alias(n) for n in names), failed.alias("base_failed"), (~failed & F.col("__rejected_by").isNull()).alias("kept"))
