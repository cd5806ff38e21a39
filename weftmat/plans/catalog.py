"""Registered matrix queries on the driver's tables, each with the SQL that defines it.

The main matrix is lineitem's four numeric columns in hundredths, as exact integers; rows are numbered in the order of
all columns. A second one has six columns with few values, a graph links suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmat.functions import codecs
from weftmat.operators import algebra, encode, grammar, graph, hybrid, layout, reorder
from weftmat.plans.scratch import materialize, scratch_dir
from weftmat.sources import readers, sinks, stored

ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
COLS, X = 4, [1, 2, 3, 4]
BLOCKS = 4
GRAMMAR_ROWS = 4096
ROUNDS = 5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LINES = f"m AS (SELECT row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS i, * FROM lineitem)"
_MAIN = f"""{_LINES}, cl AS (
  SELECT i, 0 AS j, CAST(round(l_quantity * 100) AS BIGINT) AS v FROM m UNION ALL SELECT i, 1, CAST(round(l_extendedprice * 100) AS BIGINT) FROM m
  UNION ALL SELECT i, 2, CAST(round(l_discount * 100) AS BIGINT) FROM m UNION ALL SELECT i, 3, CAST(round(l_tax * 100) AS BIGINT) FROM m),
e AS (SELECT * FROM cl WHERE v <> 0),
x AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3), (3, 4)) t(j, x)),
d AS (SELECT v, row_number() OVER (ORDER BY min(i * 4 + j)) - 1 AS val_id FROM e GROUP BY v),
c AS (SELECT i, j, d.val_id * 4 + j + 1 AS code, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS pos FROM e JOIN d USING (v)),
n AS (SELECT i, pos, code, lag(code) OVER w AS prev, lead(code) OVER w AS next FROM c WINDOW w AS (PARTITION BY i ORDER BY j)),
bf AS (SELECT code AS a, next AS b, count(*) AS freq FROM n WHERE next IS NOT NULL GROUP BY code, next),
al AS (SELECT row_number() OVER (ORDER BY code) - 1 AS rank, code FROM (SELECT code FROM c UNION SELECT 0)),
oe AS (SELECT i, row_number() OVER w - 1 AS pos, code, code - coalesce(lag(code) OVER w, 0) AS gap FROM c WINDOW w AS (PARTITION BY i ORDER BY code)) """
_SIX = f"""{_LINES}, e AS (SELECT * FROM (
  SELECT i, 0 AS j, CAST(round(l_quantity * 100) AS BIGINT) AS v FROM m UNION ALL SELECT i, 1, CAST(round(l_discount * 100) AS BIGINT) FROM m
  UNION ALL SELECT i, 2, CAST(round(l_tax * 100) AS BIGINT) FROM m UNION ALL SELECT i, 3, CAST(l_linenumber AS BIGINT) FROM m
  UNION ALL SELECT i, 4, CAST(month(l_shipdate) AS BIGINT) FROM m UNION ALL SELECT i, 5, CAST(ascii(l_returnflag) AS BIGINT) FROM m) WHERE v <> 0),
n AS (SELECT * FROM generate_series(0, 5) t(c)),
w AS (SELECT a.j AS c1, b.j AS c2, a.v AS v1, b.v AS v2, count(*) AS n FROM e a JOIN e b ON a.i = b.i AND a.j < b.j GROUP BY ALL),
csm AS (SELECT CAST(p.c AS INTEGER) AS c1, CAST(q.c AS INTEGER) AS c2, CAST(coalesce(count(w.n) - sum(w.n), 0) AS BIGINT) AS w
  FROM n p JOIN n q ON p.c < q.c LEFT JOIN w ON w.c1 = p.c AND w.c2 = q.c GROUP BY p.c, q.c) """
_GRAPH = """nn AS (SELECT max(p_partkey) + 1 AS n FROM part), g AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
deg AS (SELECT src AS node, count(*) AS degree FROM g GROUP BY src),
nodes AS (SELECT u.node, degree AS out FROM (SELECT unnest(range((SELECT n FROM nn))) AS node) u LEFT JOIN deg USING (node)) """


def _ranks(rounds: int) -> str:
    parts = ["r0 AS (SELECT node, out, CAST(1.0 AS DOUBLE) / (SELECT n FROM nn) AS rank FROM nodes)"]
    for k in range(rounds):
        parts.append(f"""r{k + 1} AS (SELECT v.node, v.out, (CAST(0.9 AS DOUBLE) * coalesce(g.got, 0) + (CAST(0.9 AS DOUBLE) * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE out IS NULL) + (CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE))) / (SELECT n FROM nn)) AS rank
          FROM nodes v LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM g JOIN r{k} ON node = src GROUP BY dst) g ON g.dst = v.node)""")
    return ", ".join(parts)


def query(name: str, sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def main_sql(body: str) -> str:
    return f"WITH {_MAIN} {body}"


MAIN = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lines(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = MAIN) -> DataFrame:
    return encode.number_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER), ORDER, "i", list(keep))


def cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


def main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the main matrix; rows are numbered once, in a written table."""
    return encode.entries(lines(spark, sf_dir), [cents(c) for c in MAIN])


def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.cells(lines(spark, sf_dir), [cents(c) for c in MAIN])


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("i", F.array(*[cents(c) for c in MAIN]).alias("vals"))


def unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without numbers, for results that do not name rows."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.array(*[cents(c) for c in MAIN]).alias("vals"))


def six(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir, ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_shipdate", "l_returnflag"))
    return encode.entries(rows, [cents("l_quantity"), cents("l_discount"), cents("l_tax"), F.col("l_linenumber").cast("bigint"), F.month("l_shipdate").cast("bigint"), F.ascii("l_returnflag").cast("bigint")])


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table: most layouts read the codes more than once."""
    e = main(spark, sf_dir)
    return materialize(encode.csrv(e, encode.dictionary(e, COLS), COLS), "codes")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.sequences(codes(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Suppliers link to the numbers of their parts; there are more parts than suppliers, so many nodes dangle."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0] + 1
    return graph.clean_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))), n


def _x(spark: SparkSession) -> DataFrame:
    return spark.range(COLS).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1).alias("x"))


# products


@query("right_multiply", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    return algebra.dense_right(dense(spark, d), X).select("i", F.col("y").cast("bigint").alias("y"))


@query("right_multiply_codes", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    e = main(spark, d)
    values = encode.dictionary(e, COLS)
    return algebra.right_multiply_codes(encode.csrv(e, values, COLS), values, _x(spark), COLS)


@query("right_multiply_sparse", "SELECT l_suppkey AS i, CAST(sum(l_partkey % 7) AS BIGINT) AS y FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count(F.lit(1)).alias("v"))
    parts = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("j")).distinct()
    return algebra.right_multiply(e, parts.withColumn("x", F.col("j") % 7))


@query("left_multiply", main_sql("SELECT j, CAST(sum(v * (i % 7 + 1)) AS BIGINT) AS z FROM e GROUP BY j"))
def _(spark, d):
    return algebra.dense_left(dense(spark, d), F.col("i") % 7 + 1, COLS)


@query("left_multiply_sparse", "SELECT l_partkey AS j, CAST(sum(l_suppkey % 5) AS BIGINT) AS z FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count(F.lit(1)).alias("v"))
    y = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 5).alias("y"))
    return algebra.left_multiply(e, y)


@query("gram_columns", main_sql("SELECT CAST(j AS INTEGER) AS j, round(ln(sum(CAST(v AS DOUBLE) * y)), 8) AS log_z FROM e JOIN (SELECT i, CAST(sum(v) AS DOUBLE) AS y FROM e GROUP BY i) r USING (i) GROUP BY j"))
def _(spark, d):
    z = algebra.gram_apply(unordered(spark, d).select(F.col("vals").cast("array<double>").alias("vals")), [1.0] * COLS)
    return spark.createDataFrame([(k, v) for k, v in enumerate(z)], "j int, z double").select("j", F.round(F.log("z"), 8).alias("log_z"))


def _power_sql(rounds: int) -> str:
    out = [f"WITH {_MAIN}, z0 AS (SELECT j, CAST(1 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS lam FROM x)"]
    for k in range(rounds):
        out.append(f"y{k} AS (SELECT i, sum(v * z / lam) AS y FROM e JOIN z{k} USING (j) GROUP BY i), t{k} AS (SELECT j, sum(v * y) AS z FROM e JOIN y{k} USING (i) GROUP BY j), z{k + 1} AS (SELECT j, z, (SELECT max(abs(z)) FROM t{k}) AS lam FROM t{k})")
    return ", ".join(out) + f" SELECT j, round(z / lam, 8) AS x, round(ln((SELECT max(lam) FROM z{rounds - 1})), 8) AS log_lambda FROM z{rounds}"


@query("power_iterate_n", _power_sql(3))
def _(spark, d):
    lam, z = algebra.power_iterate(unordered(spark, d).select(F.col("vals").cast("array<double>").alias("vals")), [1.0] * COLS, 3)
    top = max(map(abs, z))
    return spark.createDataFrame([(k, v / top, lam) for k, v in enumerate(z)], "j int, x double, lam double").select("j", F.round("x", 8).alias("x"), F.round(F.log("lam"), 8).alias("log_lambda"))


def _cramer() -> str:
    """SQL: the normal equations of four columns against l_linenumber, solved by determinants."""
    from itertools import permutations

    cols = ["l_quantity / 50", "l_extendedprice / 1e5", "l_discount * 10", "l_tax * 12.5"]
    sums = [f"sum(({a}) * ({b})) AS a{i}{j}" for i, a in enumerate(cols) for j, b in enumerate(cols)] + [f"sum(({a}) * l_linenumber) AS b{i}" for i, a in enumerate(cols)]

    def det(replaced: int | None) -> str:
        terms = []
        for p in permutations(range(4)):
            odd = sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2
            terms.append(("-" if odd else "+") + " * ".join(f"b{i}" if p[i] == replaced else f"a{i}{p[i]}" for i in range(4)))
        return "(" + " ".join(terms) + ")"

    body = " UNION ALL ".join(f"SELECT {k} AS j, round({det(k)} / {det(None)}, 5) AS x FROM t" for k in range(4))
    return f"WITH t AS (SELECT {', '.join(sums)} FROM lineitem) {body}"


@query("least_squares", _cramer())
def _(spark, d):
    """The line numbers as a combination of the four columns, by conjugate gradients."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 12.5).alias("vals"), F.col("l_linenumber").cast("double").alias("y"))
    w = algebra.least_squares(e, "y", COLS, 12)
    return spark.createDataFrame([(k, round(v, 5)) for k, v in enumerate(w)], "j int, x double")


@query("dense_dot", "SELECT vec_id AS i, round(list_sum(list_transform(embedding, lambda x, k: CAST(x AS DOUBLE) * (k % 5 + 1))), 6) AS y FROM embeddings")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("vals"))
    return algebra.dense_right(e, [(k + 1) % 5 + 1.0 for k in range(64)]).select("i", F.round("y", 6).alias("y"))


@query("complex_multiply", "WITH " + _LINES + " SELECT i, CAST(round(l_quantity * 100) * 2 - round(l_discount * 100) * 3 - round(l_tax * 100) + 5 * l_linenumber AS BIGINT) AS re, CAST(round(l_quantity * 100) * 3 + round(l_discount * 100) * 2 - 5 * round(l_tax * 100) - l_linenumber AS BIGINT) AS im FROM m")
def _(spark, d):
    """Two complex columns: quantity + discount i and tax + line number i, times 2 + 3i and -1 - 5i."""
    rows = lines(spark, d, (*MAIN, "l_linenumber"))
    cell = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    cells = F.array(cell(cents("l_quantity"), cents("l_discount")), cell(cents("l_tax"), F.col("l_linenumber").cast("bigint")))
    e = rows.select("i", F.posexplode(cells).alias("j", "v"))
    x = spark.createDataFrame([(0, (2, 3)), (1, (-1, -5))], "j int, x struct<re:bigint,im:bigint>")
    return algebra.complex_multiply(e, x, 2)


def _hybrid(spark, d):
    e = main(spark, d)
    values = encode.dictionary(e, COLS)
    split = layout.hybrid_split(encode.sequences(materialize(encode.csrv(e, values, COLS), "codes")), 1)
    return hybrid.compress_split(split, f"i div {GRAMMAR_ROWS}"), values


@query("hybrid_right_multiply", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    (rules, cseq, b), values = _hybrid(spark, d)
    return hybrid.right_multiply(rules, cseq, b, values, _x(spark), COLS)


@query("hybrid_left_multiply", main_sql("SELECT CAST(j AS INTEGER) AS j, CAST(sum(v * (i % 7 + 1)) AS BIGINT) AS z FROM e GROUP BY j"))
def _(spark, d):
    (rules, cseq, b), values = _hybrid(spark, d)
    y = cseq.select("i").union(b.select("i")).distinct().withColumn("y", F.col("i") % 7 + 1)
    return hybrid.left_multiply(rules, cseq, b, values, y, COLS)


def _power_signed_sql(rounds: int) -> str:
    out = [f"WITH {_MAIN}, z0 AS (SELECT j, CAST(1 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS lam FROM x)"]
    for k in range(rounds):
        out.append(f"y{k} AS (SELECT i, sum(CASE WHEN j = 2 THEN -v ELSE v END * z / lam) AS y FROM e JOIN z{k} USING (j) GROUP BY i), t{k} AS (SELECT j, sum(CASE WHEN j = 2 THEN -v ELSE v END * y) AS z FROM e JOIN y{k} USING (i) GROUP BY j), z{k + 1} AS (SELECT j, z, (SELECT greatest(max(z), 2.2250738585072014e-308) FROM t{k}) AS lam FROM t{k})")
    return ", ".join(out) + f" SELECT j, round(z / lam, 8) AS x, round(ln((SELECT max(lam) FROM z{rounds - 1})), 8) AS log_lambda FROM z{rounds}"


@query("power_iterate_signed", _power_signed_sql(3))
def _(spark, d):
    """With a negative column and the signed norm of the dense programs."""
    rows = unordered(spark, d).select(F.transform("vals", lambda v, k: F.when(k == 2, -v).otherwise(v).cast("double")).alias("vals"))
    lam, z = algebra.power_iterate(rows, [1.0] * COLS, 3, signed=True)
    return spark.createDataFrame([(k, v / max(z), lam) for k, v in enumerate(z)], "j int, x double, lam double").select("j", F.round("x", 8).alias("x"), F.round(F.log("lam"), 8).alias("log_lambda"))


# encodings


@query("value_dictionary", main_sql("SELECT val_id, v FROM d"))
def _(spark, d):
    return encode.dictionary(main(spark, d), COLS)


@query("csrv_codes", main_sql("SELECT i, CAST(j AS INTEGER) AS j, code FROM c"))
def _(spark, d):
    return codes(spark, d)


@query("csrv_decode", main_sql("SELECT i, CAST(j AS INTEGER) AS j, v FROM e"))
def _(spark, d):
    e = main(spark, d)
    values = encode.dictionary(e, COLS)
    return encode.csrv_decode(encode.csrv(e, values, COLS), values, COLS)


@query("drv_codes", main_sql("SELECT i, CAST(j AS INTEGER) AS j, q.id + 1 AS code FROM cl JOIN (SELECT v, row_number() OVER (ORDER BY min(i * 4 + j)) - 1 AS id FROM cl GROUP BY v) q USING (v)"))
def _(spark, d):
    return encode.drv(all_cells(spark, d), COLS)


@query("matrix_stats", main_sql("SELECT count(*) AS nnz, count(DISTINCT v) AS n_distinct, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM cl) AS density, count(DISTINCT v) * 4 AS max_code, CAST(length(bin(count(DISTINCT v) * 4)) AS BIGINT) AS code_bits FROM e"))
def _(spark, d):
    cells = unordered(spark, d)
    return encode.stats(cells.select(F.explode("vals").alias("v")).filter("v <> 0"), cells.count(), COLS)


@query("row_nnz", main_sql("SELECT i, count(*) AS nnz FROM e GROUP BY i"))
def _(spark, d):
    return dense(spark, d).select("i", F.size(F.filter("vals", lambda v: v != 0)).cast("bigint").alias("nnz")).filter("nnz > 0")


@query("col_nnz", main_sql("SELECT CAST(j AS INTEGER) AS j, count(*) AS nnz FROM e GROUP BY j"))
def _(spark, d):
    return unordered(spark, d).select(F.posexplode("vals").alias("j", "v")).filter("v <> 0").groupBy("j").agg(F.count(F.lit(1)).alias("nnz"))


@query("block_sizes", main_sql("SELECT i // ((SELECT count(*) + 3 FROM m) // 4) AS block, count(*) AS nnz FROM e GROUP BY 1"))
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    return main(spark, d).groupBy(encode.block_of(rows, BLOCKS)).agg(F.count(F.lit(1)).alias("nnz"))


@query("compression_report", main_sql("SELECT 8 * count(DISTINCT v) AS val_bytes, 4 * (count(*) + (SELECT count(*) FROM m)) AS vc_bytes, 32 * (SELECT count(*) FROM m) AS dense_bytes, round(100.0 * (8 * count(DISTINCT v) + 4 * (count(*) + (SELECT count(*) FROM m))) / (32 * (SELECT count(*) FROM m)), 4) AS percent FROM e"))
def _(spark, d):
    s = unordered(spark, d).select(F.explode("vals").alias("v")).agg(F.count_distinct(F.when(F.col("v") != 0, F.col("v"))).alias("k"), F.count_if(F.col("v") != 0).alias("nnz"), (F.count(F.lit(1)) / COLS).cast("bigint").alias("r"))
    s = s.select((8 * F.col("k")).alias("val_bytes"), (4 * (F.col("nnz") + F.col("r"))).alias("vc_bytes"), (32 * F.col("r")).alias("dense_bytes"))
    return s.withColumn("percent", F.round(F.lit(100.0) * (F.col("val_bytes") + F.col("vc_bytes")) / F.col("dense_bytes"), 4))


# layouts


@query("code_freq", main_sql("SELECT code, count(*) AS freq FROM c GROUP BY code"))
def _(spark, d):
    return layout.code_freq(codes(spark, d))


@query("topk_codes", main_sql("SELECT code, count(*) AS freq FROM c GROUP BY code ORDER BY freq DESC, code LIMIT 20"))
def _(spark, d):
    return layout.topk_codes(codes(spark, d), 20)


_TOP = "tp AS (SELECT * FROM (SELECT CAST(j AS INTEGER) AS j, code, freq, CAST(row_number() OVER (PARTITION BY j ORDER BY freq DESC, code) AS INTEGER) AS rank FROM (SELECT j, code, count(*) AS freq FROM c GROUP BY j, code)) WHERE rank <= 3), ap AS (SELECT p.code AS a, q.code AS b, count(*) AS freq FROM c p JOIN c q ON p.i = q.i AND p.j < q.j WHERE p.code IN (SELECT code FROM tp) AND q.code IN (SELECT code FROM tp) GROUP BY ALL)"


@query("topk_codes_per_column", f"WITH {_MAIN}, {_TOP} SELECT * FROM tp")
def _(spark, d):
    return layout.topk_codes_per_column(codes(spark, d), 3)


@query("allpair_freq", f"WITH {_MAIN}, {_TOP} SELECT * FROM ap")
def _(spark, d):
    c = codes(spark, d)
    return layout.allpair_freq(c, layout.topk_codes_per_column(c, 3))


@query("column_pair_freq", f"WITH {_MAIN}, {_TOP} SELECT CAST((a - 1) % 4 AS INTEGER) AS c1, CAST((b - 1) % 4 AS INTEGER) AS c2, CAST(sum(freq) AS BIGINT) AS freq FROM ap WHERE freq > 1 GROUP BY 1, 2")
def _(spark, d):
    c = codes(spark, d)
    return layout.column_pair_freq(layout.allpair_freq(c, layout.topk_codes_per_column(c, 3)), COLS)


@query("bigram_freq", main_sql("SELECT * FROM bf"))
def _(spark, d):
    return layout.bigram_freq(seqs(spark, d))


@query("hybrid_split", main_sql("SELECT i, CAST(pos AS INTEGER) AS pos, code, CASE WHEN prev IS NULL AND next IS NULL THEN 'A' WHEN coalesce(p.freq, 0) <= 1 AND coalesce(q.freq, 0) <= 1 THEN 'B' ELSE 'A' END AS part FROM n LEFT JOIN bf p ON p.a = prev AND p.b = code LEFT JOIN bf q ON q.a = code AND q.b = next"))
def _(spark, d):
    return layout.hybrid_split(seqs(spark, d), 1)


@query("alphabet_map", main_sql("SELECT rank, code FROM al"))
def _(spark, d):
    return layout.alphabet(codes(spark, d))


@query("alphabet_gaps", main_sql("SELECT rank, code - coalesce(lag(code) OVER (ORDER BY rank), 0) AS gap FROM al"))
def _(spark, d):
    return layout.alphabet_gaps(layout.alphabet(codes(spark, d)))


@query("alphabet_gap_decode", main_sql("SELECT rank, code FROM al"))
def _(spark, d):
    return layout.alphabet_from_gaps(layout.alphabet_gaps(layout.alphabet(codes(spark, d))))


@query("alphabet_to_ranks", main_sql("SELECT i, CAST(j AS INTEGER) AS j, rank AS code FROM c JOIN al USING (code)"))
def _(spark, d):
    c = codes(spark, d)
    return layout.to_ranks(c, layout.alphabet(c)).select("i", "j", "code")


@query("alphabet_unmap", main_sql("SELECT i, CAST(j AS INTEGER) AS j, code FROM c"))
def _(spark, d):
    c = codes(spark, d)
    alpha = layout.alphabet(c)
    return layout.from_ranks(layout.to_ranks(c, alpha), alpha).select("i", "j", "code")


@query("bad_codes", main_sql("SELECT i, CAST(j AS INTEGER) AS j, CASE WHEN i % 100 = 7 THEN -code ELSE code + 4 * (SELECT count(*) FROM d) END AS code FROM c WHERE i % 100 = 7 OR i % 100 = 9"))
def _(spark, d):
    """Codes of which some have been moved out of the range are found; none of the others is."""
    c = codes(spark, d)
    n = c.agg(F.max(F.expr(f"(code - 1) div {COLS}"))).first()[0] + 1
    moved = F.when(F.col("i") % 100 == 7, -F.col("code")).when(F.col("i") % 100 == 9, F.col("code") + n * COLS).otherwise(F.col("code"))
    return encode.bad_codes(c.withColumn("code", moved), n, COLS)


@query("rows_from_terminators", main_sql("SELECT i // 1000 AS block, i % 1000 AS row, code AS sym FROM c"))
def _(spark, d):
    """Codes with 0 behind each row, as in files, and no row numbers: these come back from the zeros."""
    s = seqs(spark, d).select(F.expr("i div 1000").alias("block"), "i", F.posexplode(F.concat("seq", F.array(F.lit(0).cast("bigint")))).alias("k", "sym"))
    every = lines(spark, d).select(F.expr("i div 1000").alias("block"), "i").join(s.select("i").distinct(), "i", "left_anti").select("block", "i", F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("sym"))
    flat = s.unionByName(every).select("block", (F.col("i") * 16 + F.col("k")).alias("pos"), "sym")
    return layout.rows_from_terminators(flat).select("block", "row", "sym")


@query("row_blocks", main_sql("SELECT i // ((SELECT count(*) + 3 FROM m) // 4) AS block, i, CAST(sum(v) AS BIGINT) AS x FROM e GROUP BY i"))
def _(spark, d):
    """A vector, the row sums, cut into the blocks of its matrix."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    return main(spark, d).groupBy("i").agg(F.sum("v").alias("x")).select(encode.block_of(rows, BLOCKS), "i", "x")


@query("ole_encode", main_sql("SELECT i, string_agg(gap, ',' ORDER BY pos) AS gaps FROM oe GROUP BY i"))
def _(spark, d):
    return layout.ole_encode(seqs(spark, d)).select("i", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("gaps"))


@query("ole_decode", main_sql("SELECT i, CAST(pos AS INTEGER) AS pos, code FROM oe"))
def _(spark, d):
    return layout.ole_decode(layout.ole_encode(seqs(spark, d)))


# codecs


@query("entropy_h0", "SELECT CAST(sum(f) AS BIGINT) AS n, count(*) AS sigma, round(log2(sum(f)) - sum(f * log2(f)) / sum(f), 8) AS h0 FROM (SELECT l_quantity, count(*) AS f FROM lineitem GROUP BY 1)")
def _(spark, d):
    return codecs.entropy(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity").withColumn("h0", F.round("h0", 8))


@query("cross_entropy", "SELECT round(sum(-(p.f / (SELECT sum(f) FROM a)) * log2(q.f / (SELECT sum(f) FROM b))), 8) AS bits FROM (SELECT l_linenumber AS s, CAST(count(*) AS DOUBLE) AS f FROM lineitem GROUP BY 1) p JOIN (SELECT l_linenumber AS s, CAST(count(*) AS DOUBLE) AS f FROM lineitem WHERE l_quantity > 10 GROUP BY 1) q USING (s)".replace("FROM a)", "FROM (SELECT count(*) AS f FROM lineitem))").replace("FROM b)", "FROM (SELECT count(*) AS f FROM lineitem WHERE l_quantity > 10))"))
def _(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("sym"), "l_quantity")
    f = lambda x: x.groupBy("sym").agg(F.count(F.lit(1)).alias("f"))
    return codecs.cross_entropy(f(t), f(t.filter("l_quantity > 10"))).select(F.round("bits", 8).alias("bits"))


_FOLD = "CASE WHEN v >= 256 * 16777216::BIGINT THEN (v >> 32) + 1020 WHEN v >= 16777216 THEN (v >> 24) + 765 WHEN v >= 65536 THEN (v >> 16) + 510 WHEN v >= 256 THEN (v >> 8) + 255 ELSE v END"


@query("fold_mapping", f"SELECT v, {_FOLD} AS sym, CAST((v >= 256)::INT + (v >= 65536)::INT + (v >= 16777216)::INT + (v >= 4294967296)::INT AS BIGINT) AS n_exceptions FROM (SELECT DISTINCT CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)")
def _(spark, d):
    v = spark.read.parquet(f"{d}/lineitem.parquet").select(cents("l_extendedprice").alias("v")).distinct()
    return v.select("v", codecs.fold(F.col("v")).alias("sym"), codecs.fold_exceptions(F.col("v")).alias("n_exceptions"))


@query("iv_width", main_sql("SELECT CAST(length(bin(max(code))) AS BIGINT) AS width, count(*) AS n, CAST(length(bin(max(code))) AS BIGINT) * count(*) AS bits FROM c"))
def _(spark, d):
    return codes(spark, d).agg(codecs.bit_width(F.max("code")).alias("width"), F.count(F.lit(1)).alias("n")).withColumn("bits", F.col("width") * F.col("n"))


@query("varint_cost", main_sql("SELECT CAST(sum(2 * length(bin(code + 1)) - 1) AS BIGINT) AS gamma_bits, CAST(sum(CAST(ceil(length(bin(code)) / 7.0) AS BIGINT)) AS BIGINT) AS varint_bytes FROM c"))
def _(spark, d):
    return codes(spark, d).agg(F.sum(codecs.gamma_bits(F.col("code"))).alias("gamma_bits"), F.sum(codecs.varint_bytes(F.col("code"))).alias("varint_bytes"))


@query("count_values", main_sql("SELECT code, count(*) AS n FROM c WHERE code IN (1, 2, 6, 9) GROUP BY code"))
def _(spark, d):
    return codes(spark, d).filter(F.col("code").isin(1, 2, 6, 9)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_CODED = main_sql(f"SELECT i // {GRAMMAR_ROWS} AS block, row_number() OVER (PARTITION BY i // {GRAMMAR_ROWS} ORDER BY i, j) - 1 AS pos, code AS sym FROM c")


def _round_trip(codec: str) -> Query:
    def run(spark, d):
        """Every code again after its block went through the codec."""
        s = codes(spark, d).select(F.expr(f"i div {GRAMMAR_ROWS}").alias("block"), (F.col("i") * COLS + F.col("j")).alias("pos"), F.col("code").alias("sym"))
        return codecs.decode_blocks(materialize(codecs.encode_blocks(s, codec), "coded"), codec)

    return run


for _name, _codec in (("ans_round_trip", "ans"), ("iv_round_trip", "iv"), ("ans_reorder_round_trip", "rans"), ("byte_ans_round_trip", "bytes")):
    query(_name, _CODED)(_round_trip(_codec))


@query("interpolative_round_trip", main_sql("SELECT code // 65536 AS block, row_number() OVER (PARTITION BY code // 65536 ORDER BY code) - 1 AS pos, code AS sym FROM al"))
def _(spark, d):
    """The alphabet, ascending, in blocks."""
    s = layout.alphabet(codes(spark, d)).select(F.expr("code div 65536").alias("block"), F.col("rank").alias("pos"), F.col("code").alias("sym"))
    return codecs.decode_blocks(materialize(codecs.encode_blocks(s, "interpolative"), "coded"), "interpolative")


@query("symbols_by_frequency", main_sql("SELECT code, freq, row_number() OVER (ORDER BY freq DESC, code) - 1 AS rank FROM (SELECT code, count(*) AS freq FROM c GROUP BY code)"))
def _(spark, d):
    f = layout.code_freq(codes(spark, d)).withColumn("__down", -F.col("freq"))
    return encode.number_rows(f, ["__down", "code"], "rank", ["code", "freq"])


@query("compact_alphabet", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_partkey) - 1 AS sym FROM lineitem")
def _(spark, d):
    """Part keys as consecutive numbers in their order."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return layout.compact(t, "l_partkey", "sym").select("l_orderkey", "l_linenumber", "sym")


@query("chars_to_ints", "SELECT n_nationkey, CAST(p - 1 AS INTEGER) AS pos, unicode(n_name[p]) AS sym FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS p FROM nation)")
def _(spark, d):
    return grammar.code_points(spark.read.parquet(f"{d}/nation.parquet"), "n_name").select("n_nationkey", "pos", "sym")


@query("text_grammar", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0")
def _(spark, d):
    """Each document's text as a grammar over its code points, expanded again."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("length(text) > 0")
    return grammar.expand_text_grammars(grammar.text_grammars(docs, "doc_id", "text"), "doc_id", "text")


@query("locate_values", main_sql("SELECT code, i, CAST(pos AS INTEGER) AS pos FROM c WHERE code IN (1, 2, 6, 9)"))
def _(spark, d):
    return layout.locate(seqs(spark, d), [1, 2, 6, 9])


# similarity and order


@query("csm_full", f"WITH {_SIX} SELECT * FROM csm")
def _(spark, d):
    return reorder.csm(six(spark, d), 6)


@query("csm_pruned_local", f"WITH {_SIX}, b AS (SELECT c1 AS c, * FROM csm UNION ALL SELECT c2, * FROM csm), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w, c1, c2) AS k FROM b) SELECT DISTINCT c1, c2, w FROM r WHERE k <= 2")
def _(spark, d):
    return reorder.prune_local(reorder.csm(six(spark, d), 6), 2)


@query("csm_pruned_global", f"WITH {_SIX} SELECT * FROM csm ORDER BY w, c1, c2 LIMIT 6")
def _(spark, d):
    return reorder.prune_global(reorder.csm(six(spark, d), 6), 1, 6)


def _cover_sql(ranked: str, cols: int) -> str:
    """SQL behind WITH RECURSIVE: columns in the order of a path cover, from a table ranked(k, a, b) of pairs, the first to try being k = 1."""
    lab, deg = f"range({cols})", f"list_transform(range({cols}), lambda x: 0)"
    ok = "(s.lab[r.a + 1] <> s.lab[r.b + 1] AND s.deg[r.a + 1] < 2 AND s.deg[r.b + 1] < 2)"
    return f"""ranked AS ({ranked}),
    s(k, lab, deg, es) AS (SELECT 0, {lab}, {deg}, CAST([] AS INTEGER[]) UNION ALL
      SELECT s.k + 1, CASE WHEN {ok} THEN list_transform(s.lab, lambda x: CASE WHEN x = greatest(s.lab[r.a + 1], s.lab[r.b + 1]) THEN least(s.lab[r.a + 1], s.lab[r.b + 1]) ELSE x END) ELSE s.lab END,
             CASE WHEN {ok} THEN list_transform(s.deg, lambda x, p: x + CASE WHEN p - 1 = r.a OR p - 1 = r.b THEN 1 ELSE 0 END) ELSE s.deg END,
             CASE WHEN {ok} THEN list_concat(s.es, [CAST(r.a * {cols} + r.b AS INTEGER), CAST(r.b * {cols} + r.a AS INTEGER)]) ELSE s.es END
      FROM s JOIN ranked r ON r.k = s.k + 1),
    fin AS (SELECT es, deg FROM s ORDER BY k DESC LIMIT 1),
    walk(pos, col, seen) AS (
      SELECT 0, (SELECT list_min(list_filter(range({cols}), lambda c: deg[c + 1] < 2)) FROM fin), [(SELECT list_min(list_filter(range({cols}), lambda c: deg[c + 1] < 2)) FROM fin)] UNION ALL
      SELECT pos + 1, nxt, list_append(seen, nxt) FROM (
        SELECT w.*, coalesce(list_min(list_filter(range({cols}), lambda c: list_contains(f.es, CAST(w.col * {cols} + c AS INTEGER)) AND NOT list_contains(w.seen, c))),
                             list_min(list_filter(range({cols}), lambda c: f.deg[c + 1] < 2 AND NOT list_contains(w.seen, c)))) AS nxt FROM walk w, fin f) WHERE nxt IS NOT NULL)
    SELECT CAST(pos AS INTEGER) AS pos, CAST(col AS INTEGER) AS col FROM walk"""


@query("path_cover", f"WITH RECURSIVE {_SIX}, " + _cover_sql("SELECT row_number() OVER (ORDER BY w, c1, c2) AS k, c1 AS a, c2 AS b FROM csm", 6))
def _(spark, d):
    order = reorder.path_cover([(r.c1, r.c2, r.w) for r in reorder.csm(six(spark, d), 6).collect()], 6)
    return spark.createDataFrame(list(enumerate(order)), "pos int, col int")


_FREQUENT = """SELECT row_number() OVER (ORDER BY abs(k - m // 2), k) AS k, c1 AS a, c2 AS b FROM (
  SELECT c1, c2, row_number() OVER (ORDER BY f DESC, c1, c2) - 1 AS k, count(*) OVER () AS m FROM (SELECT (a - 1) % 4 AS c1, (b - 1) % 4 AS c2, sum(freq) AS f FROM ap WHERE freq > 1 GROUP BY 1, 2) WHERE c1 <> c2)"""


def _frequent_order(c: DataFrame) -> list[int]:
    return reorder.frequent_order(c, COLS, 3)


@query("path_cover_frequent", f"WITH RECURSIVE {_MAIN}, {_TOP}, " + _cover_sql(_FREQUENT, 4))
def _(spark, d):
    return spark.createDataFrame(list(enumerate(_frequent_order(codes(spark, d)))), "pos int, col int")


@query("reorder_converter", f"WITH RECURSIVE {_MAIN}, {_TOP}, pc AS (SELECT * FROM (WITH RECURSIVE " + _cover_sql(_FREQUENT, 4) + ")) SELECT i, string_agg(code, ',' ORDER BY pc.pos) AS seq FROM c JOIN pc ON pc.col = c.j GROUP BY i")
def _(spark, d):
    """The converter's reordering from end to end: frequent codes, their column pairs, the order, the reordered sequences."""
    c = codes(spark, d)
    s = reorder.reordered_sequences(c, _frequent_order(c))
    return s.select("i", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


@query("csm_blocks", f"WITH {_SIX}, bw AS (SELECT i // 4096 AS block, c1, c2, count(*) - sum(n) AS w FROM (SELECT a.i // 4096 AS i, a.j AS c1, b.j AS c2, count(*) AS n FROM e a JOIN e b ON a.i = b.i AND a.j < b.j GROUP BY a.i // 4096, a.j, b.j, a.v, b.v) t(i0, c1, c2, n) GROUP BY 1, 2, 3) SELECT 0".replace("i // 4096 AS block, c1, c2, count(*) - sum(n) AS w FROM (SELECT a.i // 4096 AS i,", "i0 AS block, c1, c2, CAST(count(*) - sum(n) AS BIGINT) AS w FROM (SELECT a.i // 4096 AS i0,").replace(" t(i0, c1, c2, n) GROUP BY 1, 2, 3) SELECT 0", " GROUP BY 1, 2, 3) SELECT block, CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2, w FROM bw"))
def _(spark, d):
    return reorder.csm_blocks(six(spark, d), "i div 4096")


@query("path_cover_contract", None)
def _(spark, d):
    order = reorder.path_cover_contract([(r.c1, r.c2, r.w) for r in reorder.csm(six(spark, d), 6).collect()], 6)
    return spark.createDataFrame(list(enumerate(order)), "pos int, col int")


@query("matching_order", None)
def _(spark, d):
    order = reorder.matching_order([(r.c1, r.c2, r.w) for r in reorder.csm(six(spark, d), 6).collect()], 6)
    return spark.createDataFrame(list(enumerate(order)), "pos int, col int")


@query("matching_weight", f"""WITH RECURSIVE {_SIX}, o AS (SELECT c1, c2, CAST(-w // 256 + 1 AS BIGINT) AS g FROM csm WHERE w < 0),
r(c, mask, g) AS (SELECT 0, 0, CAST(0 AS BIGINT) UNION (SELECT r.c + 1, r.mask, r.g FROM r WHERE r.c < 6 UNION ALL SELECT r.c + 1, r.mask | (1 << o.c2), r.g + o.g FROM r JOIN o ON o.c1 = r.c AND r.mask & (1 << o.c2) = 0))
SELECT CAST(max(g) AS BIGINT) AS weight FROM r""")
def _(spark, d):
    """The weight of the matching behind the order is the largest there is; SQL tries all matchings."""
    pairs = [(r.c1, r.c2, r.w) for r in reorder.csm(six(spark, d), 6).collect()]
    return spark.createDataFrame([(reorder.matching_weight(pairs, reorder.matching(pairs, 6)),)], "weight bigint")


@query("apply_permutation", main_sql("SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY p.pos) - 1 AS INTEGER) AS pos, code FROM c JOIN (VALUES (2, 0), (0, 1), (3, 2), (1, 3)) p(j, pos) USING (j)"))
def _(spark, d):
    return reorder.apply_permutation(codes(spark, d), [2, 0, 3, 1])


# graph


@query("out_degree", f"WITH {_GRAPH} SELECT * FROM deg")
def _(spark, d):
    return graph.degrees(edges(spark, d)[0])


@query("in_degree", f"WITH {_GRAPH} SELECT dst AS node, count(*) AS degree FROM g GROUP BY dst")
def _(spark, d):
    return graph.degrees(edges(spark, d)[0], "dst")


@query("dangling_nodes", f"WITH {_GRAPH} SELECT node FROM nodes WHERE out IS NULL")
def _(spark, d):
    e, n = edges(spark, d)
    return graph.dangling(spark.range(n).withColumnRenamed("id", "node"), e)


@query("graph_summary", f"WITH {_GRAPH} SELECT count(*) AS nodes, count(*) FILTER (out IS NULL) AS dangling, CAST(sum(out) AS BIGINT) AS arcs, CAST(1.0 AS DOUBLE) AS rank_sum FROM nodes")
def _(spark, d):
    """The ranks after some rounds sum to one, whatever dangles."""
    e, n = edges(spark, d)
    return graph.summary(materialize(e, "edges"), n, _pagerank(spark, d, 10)).withColumn("rank_sum", F.round("rank_sum", 6))


@query("remove_self_loops", f"WITH {_GRAPH} SELECT src, dst FROM g WHERE src <> dst")
def _(spark, d):
    return graph.clean_edges(edges(spark, d)[0], drop_self_loops=True)


@query("transpose", f"WITH {_GRAPH} SELECT dst + 1 AS src, src + 1 AS dst FROM g")
def _(spark, d):
    return graph.clean_edges(edges(spark, d)[0], transpose=True, shift=1)


@query("edge_stats", f"WITH {_GRAPH} SELECT min(least(src, dst)) AS min_node, max(greatest(src, dst)) AS max_node, count(*) AS arcs, count(*) FILTER (src = dst) AS self_loops FROM g")
def _(spark, d):
    return graph.edge_stats(edges(spark, d)[0])


def _pagerank(spark: SparkSession, sf_dir: str, digits: int = 10) -> DataFrame:
    e, n = edges(spark, sf_dir)
    ranks = graph.pagerank(materialize(e, "edges"), n, ROUNDS, save=lambda df, k: materialize(df, f"ranks{k}"))
    return ranks.select("node", F.round("rank", digits).alias("rank"))


_DELTA = " UNION ALL ".join(f"SELECT {k} AS round, round(sum(abs(a.rank - b.rank)), 9) AS delta FROM r{k} a JOIN r{k - 1} b USING (node)" for k in range(1, ROUNDS + 1))


@query("pagerank_deltas", f"WITH {_GRAPH}, {_ranks(ROUNDS)} {_DELTA}")
def _(spark, d):
    """How far the ranks move in each round, and that a threshold between two of these moves ends the loop there."""
    e, n = edges(spark, d)
    moves: list[float] = []
    save = lambda df, k: materialize(df, f"ranks{k}")
    e = materialize(e, "edges")
    graph.pagerank(e, n, ROUNDS, eps=0.0, save=save, moves=moves)
    again: list[float] = []
    graph.pagerank(e, n, ROUNDS, eps=(moves[1] + moves[2]) / 2, save=save, moves=again)
    if len(again) != 3:
        raise ValueError("the threshold did not end the loop")
    return spark.createDataFrame([(k + 1, round(m, 9)) for k, m in enumerate(moves)], "round int, delta double")


@query("pagerank_n", f"WITH {_GRAPH}, {_ranks(ROUNDS)} SELECT node, round(rank, 10) AS rank FROM r{ROUNDS}")
def _(spark, d):
    return _pagerank(spark, d)


@query("pagerank_topk", f"WITH {_GRAPH}, {_ranks(ROUNDS)} SELECT node, round(rank, 10) AS rank FROM r{ROUNDS} ORDER BY round(rank, 10) DESC, node LIMIT 3")
def _(spark, d):
    return graph.topk(_pagerank(spark, d), 3)


# vectors and cells


@query("inf_norm", "SELECT max(abs(s_acctbal)) AS norm FROM supplier")
def _(spark, d):
    return algebra.inf_norm(spark.read.parquet(f"{d}/supplier.parquet"), "s_acctbal")


@query("norm2", "SELECT CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT) * CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS norm2sq FROM supplier")
def _(spark, d):
    return algebra.norm2sq(spark.read.parquet(f"{d}/supplier.parquet").select(cents("s_acctbal").alias("x")))


def _vectors(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("idx"), cents("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("bigint").alias("x"))


@query("dot", "SELECT CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT) * s_nationkey) AS BIGINT) AS dot FROM supplier")
def _(spark, d):
    return algebra.dot(*_vectors(spark, d))


@query("axpy", "SELECT s_suppkey AS idx, CAST(round(s_acctbal * 100) + 3 * s_nationkey AS BIGINT) AS x FROM supplier")
def _(spark, d):
    return algebra.axpy(*_vectors(spark, d), 3)


@query("vector_add", "SELECT s_suppkey AS idx, CAST(round(s_acctbal * 100) + s_nationkey AS BIGINT) AS x FROM supplier")
def _(spark, d):
    return algebra.add(*_vectors(spark, d))


@query("normalize", "SELECT s_suppkey AS idx, s_acctbal / (SELECT max(abs(s_acctbal)) FROM supplier) AS x FROM supplier")
def _(spark, d):
    return algebra.normalize(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("x")))


@query("vector_scale", "SELECT s_suppkey AS idx, CAST(round(s_acctbal * 100) AS BIGINT) * -3 AS x FROM supplier")
def _(spark, d):
    return algebra.scale(_vectors(spark, d)[0], -3)


@query("normalize_signed", "SELECT s_suppkey AS idx, s_acctbal / (SELECT greatest(max(s_acctbal), 2.2250738585072014e-308) FROM supplier) AS x FROM supplier")
def _(spark, d):
    return algebra.normalize(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("x")), signed=True)


@query("constant_vector", "SELECT range AS idx, CAST(CASE range % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.5 ELSE -1.0 END AS DOUBLE) AS x FROM range(1000)")
def _(spark, d):
    return algebra.constant_vector(spark, 1000, [1.0, 2.5, -1.0])


@query("strip_columns", "WITH " + _LINES + " SELECT i - 2 AS i, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(round(l_discount * 100) AS BIGINT) AS b FROM m WHERE i >= 2")
def _(spark, d):
    cut = dense(spark, d).filter("i >= 2").select((F.col("i") - 2).alias("i"), F.slice("vals", 2, 2).alias("vals"))
    return cut.select("i", F.col("vals")[0].alias("a"), F.col("vals")[1].alias("b"))


@query("fill_missing", "SELECT doc_id, CASE WHEN trim(lang) IN ('', 'NA', 'en') THEN '0' ELSE lang END AS cell FROM documents")
def _(spark, d):
    cells = F.array(F.when(F.col("lang") == "en", "NA").otherwise(F.col("lang")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", readers.fill_missing(cells, "0")[0].alias("cell"))


@query("token_hash", "SELECT doc_id, CASE WHEN t = '0' THEN 0 ELSE CAST(('0x' || sha256(t)[1:8]) AS BIGINT) END AS h FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '0' ELSE source END AS t FROM documents)")
def _(spark, d):
    token = F.when(F.col("lang") == "en", "0").otherwise(F.col("source"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", encode.token_hash(token).alias("h"))


# grammar


def grammar_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = main(spark, sf_dir)
    values = encode.dictionary(e, COLS)
    s = encode.sequences(encode.csrv(e, values, COLS)).withColumn("block", F.expr(f"i div {GRAMMAR_ROWS}"))
    rules, cseq = grammar.compress(s)
    return rules, cseq, values


def _weights(values: DataFrame) -> DataFrame:
    """(sym, j, v, w) of every possible terminal."""
    return values.select(F.explode(F.sequence(F.lit(0), F.lit(COLS - 1))).alias("j"), "val_id", "v").select((F.col("val_id") * COLS + F.col("j") + 1).alias("sym"), "j", "v", (F.col("v") * (F.col("j") + 1)).alias("w"))


@query("repair_expand", main_sql("SELECT i, string_agg(code, ',' ORDER BY j) AS seq FROM c GROUP BY i"))
def _(spark, d):
    rules, cseq, _ = grammar_of(spark, d)
    return grammar.expand(rules, cseq).select("i", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


@query("grammar_right_multiply", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    rules, cseq, values = grammar_of(spark, d)
    return grammar.right_multiply(rules, cseq, _weights(values).select("sym", "w"))


@query("grammar_left_multiply", main_sql("SELECT j, CAST(sum(v * (i % 7 + 1)) AS BIGINT) AS z FROM e GROUP BY j"))
def _(spark, d):
    rules, cseq, values = grammar_of(spark, d)
    y = cseq.select("i").distinct().withColumn("y", F.col("i") % 7 + 1)
    return grammar.symbol_masses(rules, cseq, y).join(_weights(values), "sym").groupBy("j").agg(F.sum(F.col("v") * F.col("mass")).alias("z"))


@query("grammar_lengths", main_sql(f"SELECT i // {GRAMMAR_ROWS} AS block, count(*) AS length FROM c GROUP BY 1"))
def _(spark, d):
    """The lengths that the blocks' rules and symbols stand for, each rule's length counted once."""
    rules, cseq, _ = grammar_of(spark, d)
    return grammar.expanded_lengths(rules, cseq)


def _stored(spark, d):
    path = scratch_dir(spark)
    rules, cseq, values = grammar_of(spark, d)
    stored.store_values(values, path)
    return path, rules, cseq


@query("stored_codes_multiply", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    """Codes stored by block, read back block by block, put together, checked, and multiplied."""
    path = scratch_dir(spark)
    e = main(spark, d)
    values = encode.dictionary(e, COLS)
    stored.store_values(values, path)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    stored.store_codes(encode.csrv(e, values, COLS).withColumn("block", encode.block_of(rows, BLOCKS)), path)
    back = stored.load_values(spark, path)
    c = stored.load_codes(spark, path, [0, 1]).unionByName(stored.load_codes(spark, path, [2, 3]))
    return algebra.right_multiply_codes(encode.checked_codes(c, back.count(), COLS), back, _x(spark), COLS)


@query("stored_grammar_multiply", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    path, rules, cseq = _stored(spark, d)
    stored.store_grammar(rules, cseq, path)
    return grammar.right_multiply(*stored.load_grammar(spark, path), _weights(stored.load_values(spark, path)).select("sym", "w"))


@query("stored_ans_grammar_expand", main_sql("SELECT i, string_agg(code, ',' ORDER BY j) AS seq FROM c GROUP BY i"))
def _(spark, d):
    """Rules and sequences of every block as ANS bytes, read, decoded and expanded."""
    path, rules, cseq = _stored(spark, d)
    stored.store_coded(rules, cseq, path, "ans")
    out = grammar.expand(*stored.load_coded(spark, path, "ans"))
    return out.select("i", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


@query("stored_iv_grammar_multiply", main_sql("SELECT j, CAST(sum(v * (i % 7 + 1)) AS BIGINT) AS z FROM e GROUP BY j"))
def _(spark, d):
    path, rules, cseq = _stored(spark, d)
    stored.store_coded(rules, cseq, path, "iv")
    rules, cseq = (materialize(t, "loaded") for t in stored.load_coded(spark, path, "iv"))
    y = cseq.select("i").distinct().withColumn("y", F.col("i") % 7 + 1)
    return grammar.symbol_masses(rules, cseq, y).join(_weights(stored.load_values(spark, path)), "sym").groupBy("j").agg(F.sum(F.col("v") * F.col("mass")).alias("z"))


@query("stored_split_multiply", main_sql("SELECT i, CAST(sum(v * x) AS BIGINT) AS y FROM e JOIN x USING (j) GROUP BY i"))
def _(spark, d):
    """Parts A and B stored by block, read, A's grammar made, and both multiplied."""
    path = scratch_dir(spark)
    e = main(spark, d)
    values = encode.dictionary(e, COLS)
    split = layout.hybrid_split(encode.sequences(materialize(encode.csrv(e, values, COLS), "codes")), 1)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    stored.store_split(split.withColumn("block", encode.block_of(rows, BLOCKS)), path)
    a = stored.load_split(spark, path, "A").groupBy("block", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("seq"))
    rules, cseq = grammar.compress(a.withColumn("block", F.expr(f"i div {GRAMMAR_ROWS}")))
    return hybrid.right_multiply(rules, cseq, stored.load_split(spark, path, "B"), values, _x(spark), COLS)


# files, written to the shared folder and read back


def _supplier(spark, d):
    return encode.number_rows(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_suppkey"], "i")


_SUPPLIER = "s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, * FROM supplier)"


@query("csv_scan", main_sql("SELECT i, CAST(j AS INTEGER) AS j, v FROM cl"))
def _(spark, d):
    """The matrix as gzip CSV files and back."""
    path = scratch_dir(spark)
    sinks.write_csv(dense(spark, d), path, compression="gzip")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    back = readers.dense_csv(spark, path, COLS, rows)
    return back.select("i", F.posexplode("vals").alias("j", "v")).select("i", "j", F.col("v").cast("bigint").alias("v"))


def _matrix_bytes(spark, d, dtype: str) -> tuple[str, int]:
    """A file of suppliers' (balance in cents, nation): one block of the dense writer, put into one file."""
    path = f"{scratch_dir(spark)}/m.bin"
    m = _supplier(spark, d).select("i", F.array(cents("s_acctbal"), F.col("s_nationkey").cast("bigint")).alias("vals"))
    rows = m.count()
    parts = sinks.binary_blocks(m, rows, 1, dtype).orderBy("chunk").collect()
    sinks.write_bytes(spark, path, b"".join(bytes(p.data) for p in parts))
    return path, rows


for _dtype in ("f64", "f32", "i32"):

    def _scan(spark, d, dtype=_dtype):
        path, rows = _matrix_bytes(spark, d, dtype)
        back = readers.dense_binary(spark, path, rows, 2, dtype)
        return back.select("i", *(F.col("vals")[k].cast("bigint").alias(n) for k, n in enumerate("ab")))

    query(f"binary_scan_{_dtype}", f"WITH {_SUPPLIER} SELECT i, CAST(round(s_acctbal * 100) AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b FROM s")(_scan)


@query("complex_binary_scan", f"WITH {_SUPPLIER} SELECT i, CAST(round(s_acctbal * 100) AS BIGINT) AS re, CAST(s_nationkey AS BIGINT) AS im FROM s")
def _(spark, d):
    path, rows = _matrix_bytes(spark, d, "f64")
    return readers.dense_binary(spark, path, rows, 1, "c128").select("i", F.col("vals")[0].re.cast("bigint").alias("re"), F.col("vals")[0].im.cast("bigint").alias("im"))


@query("complex_csv_scan", f"WITH {_SUPPLIER} SELECT i, s_acctbal AS re, CAST(s_nationkey AS DOUBLE) AS im FROM s")
def _(spark, d):
    path = scratch_dir(spark)
    line = F.format_string("(%s%sj)", F.col("s_acctbal").cast("string"), F.concat(F.lit("+"), F.col("s_nationkey").cast("string")))
    _supplier(spark, d).repartitionByRange("i").sortWithinPartitions("i").select(line.alias("value")).write.text(path)
    return readers.complex_csv(spark, path, 1).select("i", F.col("vals")[0].re.alias("re"), F.col("vals")[0].im.alias("im"))


_CELLS = "SELECT l_suppkey AS i, CAST(l_partkey % 100 AS INTEGER) AS j, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


def _cells(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 100).cast("int").alias("j")).agg(F.sum("l_linenumber").cast("double").alias("v"))


@query("triplet_scan", _CELLS)
def _(spark, d):
    path = scratch_dir(spark)
    e = _cells(spark, d)
    e.select(F.concat_ws(" ", "i", "j", "v").alias("value")).write.text(path)
    return readers.triplets(spark, path, 1 << 31, 100)


@query("boolean_scan", f"SELECT i, j, CAST(1 AS DOUBLE) AS v FROM ({_CELLS})")
def _(spark, d):
    path = scratch_dir(spark)
    _cells(spark, d).select(F.concat_ws(" ", "i", "j").alias("value")).write.text(path)
    return readers.boolean(spark, path, 1 << 31, 100)


@query("boolean_dense", f"WITH b AS ({_CELLS}), r AS (SELECT unnest(range((SELECT max(l_suppkey) + 3 FROM lineitem))) AS i) SELECT i, coalesce(string_agg(j, ',' ORDER BY j), '') AS ones, CAST(100 AS INTEGER) AS width FROM r LEFT JOIN b USING (i) GROUP BY i")
def _(spark, d):
    """Rows of 0 and 1, some without any one."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").agg(F.max("l_suppkey")).first()[0] + 3
    out = readers.boolean_dense(_cells(spark, d), 100, rows)
    ones = F.expr("array_join(transform(filter(transform(vals, (x, k) -> CASE WHEN x = 1 THEN k END), k -> k IS NOT NULL), k -> cast(k AS string)), ',')")
    return out.select("i", ones.alias("ones"), F.size("vals").alias("width"))


@query("edge_list_scan", f"WITH {_GRAPH} SELECT src, dst FROM g")
def _(spark, d):
    """Edges, some twice, as sorted lines behind a header, and back."""
    path = scratch_dir(spark)
    e = edges(spark, d)[0]
    sinks.write_edges(e.union(e), path, header=False)
    sinks.write_bytes(spark, f"{path}/00000.txt", b"%%MatrixMarket matrix coordinate\n10 10 10\n")
    return readers.edge_list(spark, path)


@query("edge_counts", f"WITH {_GRAPH} SELECT 'row' AS side, src AS node, count(*) AS degree FROM g GROUP BY src UNION ALL SELECT 'col', dst, count(*) FROM g GROUP BY dst")
def _(spark, d):
    return sinks.edge_counts(edges(spark, d)[0])


@query("vector_scan", f"WITH {_SUPPLIER} SELECT i AS idx, s_acctbal AS x FROM s")
def _(spark, d):
    path = f"{scratch_dir(spark)}/v.dbl"
    sinks.write_bytes(spark, path, sinks.vector_bytes(_supplier(spark, d).select(F.col("i").alias("idx"), F.col("s_acctbal").alias("x"))))
    return readers.vector(spark, path)


@query("vector_table", f"WITH {_SUPPLIER} SELECT i AS idx, s_acctbal AS x FROM s")
def _(spark, d):
    path = scratch_dir(spark)
    sinks.write_vector(_supplier(spark, d).select(F.col("i").alias("idx"), F.col("s_acctbal").alias("x")), path)
    return spark.read.parquet(path)


@query("list_scan", f"WITH {_SUPPLIER} SELECT i AS pos, s_suppkey * 7 AS sym FROM s")
def _(spark, d):
    path = scratch_dir(spark)
    sinks.write_list(_supplier(spark, d).select(F.col("i").alias("pos"), (F.col("s_suppkey") * 7).alias("sym")), path)
    return readers.text_list(spark, path)


@query("int_stream_scan", f"WITH {_SUPPLIER} SELECT i AS pos, s_suppkey * 7 AS sym FROM s")
def _(spark, d):
    path = f"{scratch_dir(spark)}/s.int"
    v = _supplier(spark, d).select(F.col("i").alias("idx"), (F.col("s_suppkey") * 7).cast("int").alias("x"))
    sinks.write_bytes(spark, path, sinks.vector_bytes(v, "i32"))
    return readers.int_stream(spark, path, "i32")


@query("tour_scan", "SELECT * FROM (VALUES (0, 3), (1, 0), (2, 2), (3, 1)) t(pos, col)")
def _(spark, d):
    path = f"{scratch_dir(spark)}/t.tour"
    sinks.write_bytes(spark, path, ("NAME : t\nTOUR_SECTION\n" + sinks.tour_lines([3, 0, 2, 1])).encode())
    return readers.tour(spark, path)


@query("similarity_lines", f"WITH {_SIX} SELECT c1, string_agg(w, ' ' ORDER BY c2) AS value FROM csm GROUP BY c1")
def _(spark, d):
    return sinks.similarity_lines(reorder.csm(six(spark, d), 6), 6)


@query("first_cells", main_sql("SELECT i, CAST(j AS INTEGER) AS j, v FROM e WHERE i * 4 + j < 1001"))
def _(spark, d):
    return readers.first_cells(main(spark, d), COLS, 1001)


@query("lossy_dictionary", "SELECT DISTINCT l_extendedprice AS v FROM lineitem WHERE l_extendedprice <> trunc(l_extendedprice)")
def _(spark, d):
    """The values that a dictionary of integers would change."""
    v = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").alias("v")).distinct()
    return sinks.lossy_values(v)


@query("grammar_stats", None)
def _(spark, d):
    rules, cseq, _ = grammar_of(spark, d)
    return grammar.grammar_stats(rules, cseq)
