"""Secret scans in DataFrame functions only: fixed patterns, then sliding-window entropy of candidate strings.

A text is cut at the matches of a pattern with one \\G-anchored pass; lengths of the pieces give positions in
code points and bytes. Candidates for the entropy scan are maximal runs of secret-like characters outside the fixed
patterns' spans. A window slides over the run; the character that enters and the one that leaves change two
counts, and with them the sum of c*log2(c), so each step costs the same whatever the run. The sum does not depend on the
character class: a class has its own alphabet, which all characters of a window must belong to, and its own threshold.
Windows above it are merged where they overlap or touch, unless the allow-list covers the run.

Work is linear in the text and in the length of a run, and nearly so in the number of spans: sums run over parts of CHUNK, runs are
scanned in stretches of STRETCH windows, and text is cut by bytes, which need no walk from its start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmat.llm.common import text_or_empty

# The base patterns and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class: its characters and the bits a character from which a window counts as random.
CLASSES = {
    "hex": ("0123456789abcdef", 3.0),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
}
#: Runs that look random and are not secrets: one kind of character only, UUIDs, paths and slugs of plain words, digests of the empty string.
ALLOW = (
    r"^[0-9]+$", r"^[a-z+/_=-]+$", r"^[A-Z+/_=-]+$", r"^[A-Za-z]+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}[/_=-])+[A-Za-z]*[0-9]{0,4}$",
    r"^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)",
)
#: Counting sequences and placeholders: they clear a run of up to SHORT characters; in longer ones only the windows that touch them.
FILLERS = ("0123456789", "abcdefghij", "example", "placeholder", "dummy", "changeme", "xxxxxx")
REPEAT = 8  # so do equal characters in a row
SHORT = 128
CHUNK, STRETCH = 64, 512


def _sql(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "struct<start:bigint,kind:int,end:bigint,b0:bigint,b1:bigint>"


def _running(values: str, merge: str) -> str:
    """SQL: running sums or maxima (merge over a and x) of an array of non-negative numbers, part by part.

    An aggregate copies its state at every step, so a list must not grow in it; sums over parts of CHUNK are short.
    """
    over = lambda part: f"aggregate({part}, 0L, (a, x) -> {merge})"
    tops = f"transform(sequence(0, greatest(size(v) - 1, 0), {CHUNK}), i -> {over(f'slice(v, i + 1, {CHUNK})')})"
    before = f"transform(array({tops}), t -> transform(t, (y, k) -> {over('slice(t, 1, k)')}))[0]"
    own = over(f"slice(v, k - k % {CHUNK} + 1, k % {CHUNK} + 1)")
    return f"transform(array({values}), v -> transform(array({before}), o -> transform(v, (y, k) -> transform(array(o[k div {CHUNK}]), a -> transform(array({own}), x -> {merge})[0])[0]))[0])[0]"


SUM, MAX = "a + x", "greatest(a, x)"


def _spans(pieces: str, pattern: str, kind: int, keep: str = "true") -> str:
    """SQL: pieces end in a match; array of (start, kind, end, first byte, end byte) of the matches m for which keep holds."""
    ends = ", ".join(f"'{n}', {_running(f'transform({pieces}, p -> cast({f}(p) AS bigint))', SUM)}" for n, f in (("n", "length"), ("b", "octet_length")))
    span = f"named_struct('start', q.n[k] - length(m), 'kind', {kind}, 'end', q.n[k], 'b0', q.b[k] - octet_length(m), 'b1', q.b[k])"
    each = f"transform({pieces}, (p, k) -> transform(array(regexp_extract(p, {_sql(pattern)}, 0)), m -> CASE WHEN {keep.replace('{m}', 'm')} THEN {span} END)[0])"
    return f"CASE WHEN size({pieces}) > 0 THEN transform(array(named_struct({ends})), q -> filter({each}, x -> x IS NOT NULL))[0] ELSE cast(array() AS array<{SPAN}>) END"


def _pieces(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))


def _union(spans: str) -> str:
    """SQL: spans sorted by start, those that overlap made one, as (b0, b1) in bytes."""
    tops = _running(f"transform({spans}, x -> x.b1)", MAX)
    # a span begins a new one if it starts at or behind every end so far; the end of the old one is that running maximum
    first = "filter(transform(z, (x, k) -> CASE WHEN k = 0 OR x.s.b0 >= z[k - 1].t THEN x.s.b0 END), b -> b IS NOT NULL)"
    last = "filter(transform(z, (x, k) -> CASE WHEN k = size(z) - 1 OR z[k + 1].s.b0 >= x.t THEN x.t END), b -> b IS NOT NULL)"
    return f"transform(array(zip_with({spans}, {tops}, (s, t) -> named_struct('s', s, 't', t))), z -> zip_with({first}, {last}, (p, q) -> named_struct('b0', p, 'b1', q)))[0]"


def _replaced(text: str, cuts: str, fill: str) -> str:
    """SQL: text with each of the disjoint, ascending byte ranges `cuts` replaced by fill (an expression over x)."""
    raw = f"cast({text} AS binary)"
    part = f"concat(decode(substring(raw, cast(CASE WHEN k = 0 THEN 1 ELSE c[k - 1].b1 + 1 END AS int), cast(x.b0 - CASE WHEN k = 0 THEN 0 ELSE c[k - 1].b1 END AS int)), 'UTF-8'), {fill})"
    tail = "decode(substring(raw, cast(c[size(c) - 1].b1 + 1 AS int)), 'UTF-8')"
    return f"transform(array({cuts}), c -> transform(array({raw}), raw -> concat(array_join(transform(c, (x, k) -> {part}), ''), {tail}))[0])[0]"


def _fillers(run: str) -> str:
    """SQL: run with its fillers blanked, length kept."""
    for f in FILLERS:
        run = f"regexp_replace({run}, '(?i){f}', '{' ' * len(f)}')"
    return f"regexp_replace({run}, {_sql(r'(.)' + chr(92) + '1{' + str(REPEAT - 1) + '}')}, '{' ' * REPEAT}')"


def _windows() -> str:
    """SQL over a run's characters c (code points): array of (first, end) of its random stretches, 0-based, merged.

    Runs are scanned in stretches of windows, each by one aggregate whose state is the sum of c*log2(c), the length
    of what belongs to each class, and the open stretch. The counts of the entering and the leaving character are taken from the window.
    """
    w, ks = WINDOW, range(len(CLASSES))
    f = lambda n: f"element_at(g, {n} + 1)"  # noqa: E731  # n*log2(n) by table
    table = ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(w + 1))
    member = [f"element_at(m{k}, least(x, 127) + 1)" for k in ks]
    tables = [", ".join("true" if chr(c) in a else "false" for c in range(128)) for a, _ in CLASSES.values()]
    least = [w * (math.log2(w) - bits) + 1e-9 for _, bits in CLASSES.values()]
    enter = f"size(filter(slice(c, greatest(i - {w} + 1, a.i0) + 1, i - greatest(i - {w} + 1, a.i0)), y -> y = x))"  # before it enters, among the last w - 1
    leave = f"size(filter(slice(c, i - {w} + 1, {w}), y -> y = o))"  # among the w before the step, itself included
    runs = ", ".join(f"'r{k}', CASE WHEN {member[k]} THEN a.r{k} + 1 ELSE 0 END" for k in ks)
    hit = " OR ".join(f"(b.r{k} >= {w} AND b.s <= {least[k]!r}D)" for k in ks)
    s_out = f"CASE WHEN i - {w} >= a.i0 THEN transform(array(c[i - {w}]), o -> transform(array({leave}), n -> {f('n')} - {f('n - 1')})[0])[0] ELSE 0D END"
    s_in = f"transform(array({enter}), n -> {f('n + 1')} - {f('n')})[0]"
    moved = f"transform(array(c[i]), x -> named_struct('s', a.s - {s_out} + {s_in}, {runs}))[0]"
    keep = ", ".join(f"'r{k}', b.r{k}" for k in ks)
    opened = f"""CASE WHEN NOT ({hit}) THEN named_struct('i0', a.i0, 's', b.s, {keep}, 'first', a.first, 'end', a.end, 'out', a.out)
        WHEN a.end > 0 AND a.end >= i - {w} + 1 THEN named_struct('i0', a.i0, 's', b.s, {keep}, 'first', a.first, 'end', i + 1, 'out', a.out)
        ELSE named_struct('i0', a.i0, 's', b.s, {keep}, 'first', i - {w} + 1, 'end', i + 1, 'out', CASE WHEN a.end > 0 THEN concat(a.out, array(named_struct('first', a.first, 'end', a.end))) ELSE a.out END) END"""
    zero = f"named_struct('i0', i0, 's', 0D, {', '.join(f'{chr(39)}r{k}{chr(39)}, 0' for k in ks)}, 'first', -1, 'end', 0, 'out', cast(array() AS array<struct<first:int,end:int>>))"
    done = "a -> CASE WHEN a.end > 0 THEN concat(a.out, array(named_struct('first', a.first, 'end', a.end))) ELSE a.out END"
    scan = f"aggregate(sequence(i0, least(i0 + {STRETCH + w - 2}, size(c) - 1)), {zero}, (a, i) -> transform(array({moved}), b -> {opened})[0], {done})"
    each = f"flatten(transform(sequence(0, greatest(size(c) - {w}, 0), {STRETCH}), i0 -> {scan}))"
    # stretches that touch across two scans
    first = "filter(transform(z, (x, k) -> CASE WHEN k = 0 OR x.first > z[k - 1].end THEN x.first END), v -> v IS NOT NULL)"
    last = "filter(transform(z, (x, k) -> CASE WHEN k = size(z) - 1 OR z[k + 1].first > x.end THEN x.end END), v -> v IS NOT NULL)"
    joined = f"transform(array({each}), z -> zip_with({first}, {last}, (p, q) -> named_struct('first', p, 'end', q)))[0]"
    for k in ks:
        joined = f"transform(array(array({tables[k]})), m{k} -> {joined})[0]"
    return f"transform(array(array({table})), g -> {joined})[0]"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus __spans: array of (start, kind, end, b0, b1), sorted; kind indexes KINDS, positions are code points, end exclusive; b0 and b1 are bytes.

    Null text is empty and has no spans. All columns pass through whatever their names; one named __spans is replaced.
    """
    none = f"cast(array() AS array<{SPAN}>)"
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "__spans"]).alias("row"), text_or_empty(text_col).alias("text"))
    df = df.withColumns({"p0": _pieces("text", ASSIGN), "p1": _pieces("text", ACCESS), "p2": _pieces("text", HEX)})
    keep = f"length(regexp_extract({{m}}, {_sql(ASSIGN)}, 1)) >= 8"
    df = df.withColumn("base", F.expr(f"array_sort(concat({_spans('p0', ASSIGN, 0, keep)}, {_spans('p1', ACCESS, 1)}, {_spans('p2', HEX, 2)}))")).drop("p0", "p1", "p2")
    # fixed spans are ASCII: blanks in their place keep all positions
    df = df.withColumn("masked", F.expr(f"CASE WHEN size(base) > 0 THEN {_replaced('text', _union('base'), 'repeat(' + chr(39) + ' ' + chr(39) + ', cast(x.b1 - x.b0 AS int))')} ELSE text END"))
    df = df.withColumn("p3", _pieces("masked", CANDIDATE)).drop("masked")
    allowed = " OR ".join(f"m RLIKE {_sql(p)}" for p in ALLOW)
    filler = f"m RLIKE {_sql('(?i)' + '|'.join(FILLERS) + '|(.)' + chr(92) + '1{' + str(REPEAT - 1) + ',}')}"
    runs = f"transform({_spans('p3', CANDIDATE, 3)}, (r, k) -> transform(array(regexp_extract(p3[k], {_sql(CANDIDATE)}, 0)), m -> named_struct('r', r, 'm', CASE WHEN {allowed} THEN '' WHEN {filler} THEN CASE WHEN length(m) <= {SHORT} THEN '' ELSE {_fillers('m')} END ELSE m END))[0])"
    df = df.withColumn("runs", F.expr(f"CASE WHEN size(p3) > 0 THEN filter({runs}, x -> x.m <> '') END")).drop("p3")
    found = f"transform(array(transform(split(x.m, ''), y -> ascii(y))), c -> transform({_windows()}, v -> named_struct('start', x.r.start + v.first, 'kind', 3, 'end', x.r.start + v.end, 'b0', x.r.b0 + v.first, 'b1', x.r.b0 + v.end)))[0]"
    df = df.withColumn("found", F.expr(f"CASE WHEN size(runs) > 0 THEN flatten(transform(runs, x -> {found})) ELSE {none} END"))
    return df.select("row.*", F.expr("CASE WHEN size(found) > 0 THEN array_sort(concat(base, found)) ELSE base END").alias("__spans"))


def _digest(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')"


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    df = scan(docs.select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(__spans, x -> x.kind = {k})) AS bigint)")
    return df.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_digest("filter(__spans, x -> x.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_digest("__spans")).alias("spans"), count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by [SECRET]; overlapping spans become one. length_col, if present, follows the new text.

    All columns pass through whatever their names; null texts stay null.
    """
    df = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text")))
    df = df.withColumn("new", F.expr(f"CASE WHEN size(__spans) > 0 THEN {_replaced('text', _union('__spans'), chr(39) + '[SECRET]' + chr(39))} ELSE text END"))
    size = F.when(F.size("__spans") > 0, F.length("new").cast("bigint"))
    cols = [F.col("new").alias(c) if c == text_col else F.coalesce(size, F.col("row").getField(c)).alias(c) if c == length_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return df.select(*cols)
