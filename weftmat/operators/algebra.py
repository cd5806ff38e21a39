"""Products with a matrix of entries (i, j, v) or dense rows (i, vals), vectors (idx, x), and iterations built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmat.plans.scratch import small

#: Elements up to which a vector is sent to every executor.
BROADCAST_ELEMENTS = 1_000_000
#: Columns up to which iterations keep the vector on the driver and pass it as a literal.
DRIVER_COLUMNS = 4096
DBL_MIN = 2.2250738585072014e-308


def _vec(x: DataFrame, n: int | None) -> DataFrame:
    return F.broadcast(x) if n is not None and n <= BROADCAST_ELEMENTS else x


def right_multiply(e: DataFrame, x: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """(i, y) with y = M x; x is (j, x). With rows given, empty rows give 0. cols is the known length of x."""
    y = e.join(_vec(x, cols), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return y if rows is None else _fill(y, "i", rows)


def left_multiply(e: DataFrame, y: DataFrame, cols: int | None = None, rows: int | None = None) -> DataFrame:
    """(j, z) with z = y' M; y is (i, y)."""
    z = e.join(_vec(y, rows), "i").groupBy("j").agg(F.sum(F.col("v") * F.col("y")).alias("z"))
    return z if cols is None else _fill(z, "j", cols)


def _fill(v: DataFrame, key: str, n: int) -> DataFrame:
    name = v.columns[1]
    kind = v.schema[name].dataType
    every = v.sparkSession.range(n).select(F.col("id").cast(v.schema[key].dataType).alias(key))
    return every.join(v, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast(kind)))


def right_multiply_codes(codes: DataFrame, values: DataFrame, x: DataFrame, cols: int) -> DataFrame:
    """(i, y) on dictionary codes (i, code): x is summed by (row, value) before values are looked up."""
    c = codes.select("i", F.pmod(F.col("code") - 1, F.lit(cols)).cast("int").alias("j"), F.expr(f"(code - 1) div {cols}").alias("val_id"))
    part = c.join(_vec(x, cols), "j").groupBy("i", "val_id").agg(F.sum("x").alias("sx"))
    return part.join(small(values), "val_id").groupBy("i").agg(F.sum(F.col("v") * F.col("sx")).alias("y"))


def left_multiply_codes(codes: DataFrame, values: DataFrame, y: DataFrame, cols: int, rows: int | None = None) -> DataFrame:
    """(j, z) on dictionary codes (i, code): y is summed by code, of which there are few, before values are looked up."""
    part = codes.join(_vec(y, rows), "i").groupBy("code").agg(F.sum("y").alias("sy"))
    part = part.select(F.pmod(F.col("code") - 1, F.lit(cols)).cast("int").alias("j"), F.expr(f"(code - 1) div {cols}").alias("val_id"), "sy")
    return part.join(small(values), "val_id").groupBy("j").agg(F.sum(F.col("v") * F.col("sy")).alias("z"))


def dense_right(dense: DataFrame, x: list[float]) -> DataFrame:
    """(i, y) from (i, vals): no shuffle."""
    arr = F.array(*[F.lit(v) for v in x])
    return dense.select("i", F.aggregate(F.zip_with("vals", arr, lambda a, b: a * b), F.lit(0).cast(dense.schema["vals"].dataType.elementType), lambda s, v: s + v).alias("y"))


def dense_left(dense: DataFrame, y: Column, cols: int) -> DataFrame:
    """(j, z) from (i, vals) with the row's y as an expression: one partial aggregate, `cols` rows shuffled a task."""
    return dense.select(F.posexplode("vals").alias("j", "v"), y.alias("y")).groupBy("j").agg(F.sum(F.col("v") * F.col("y")).alias("z"))


def complex_multiply(e: DataFrame, x: DataFrame, cols: int | None = None) -> DataFrame:
    """(i, re, im) for complex v and x, structs of re and im. cols is the known length of x."""
    p = e.join(_vec(x, cols), "j")
    return p.groupBy("i").agg(F.sum(F.expr("v.re * x.re - v.im * x.im")).alias("re"), F.sum(F.expr("v.re * x.im + v.im * x.re")).alias("im"))


# vectors


def constant_vector(spark: SparkSession, n: int, values: list[float]) -> DataFrame:
    """(idx, x) of n elements, the values repeating."""
    return spark.range(n).select(F.col("id").alias("idx"), F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int")).alias("x"))


def inf_norm(v: DataFrame, x: str = "x") -> DataFrame:
    return v.agg(F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("norm"))


def norm2sq(v: DataFrame, x: str = "x") -> DataFrame:
    return v.agg(F.sum(F.col(x) * F.col(x)).alias("norm2sq"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of a.x * b.x by idx."""
    return a.join(b.withColumnRenamed("x", "w"), "idx").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))


def axpy(v: DataFrame, w: DataFrame, t: float) -> DataFrame:
    """(idx, x) = v + t * w."""
    return v.join(w.withColumnRenamed("x", "w"), "idx").select("idx", (F.col("x") + F.lit(t) * F.col("w")).alias("x"))


def scale(v: DataFrame, t: float) -> DataFrame:
    return v.select("idx", (F.col("x") * F.lit(t)).alias("x"))


def add(v: DataFrame, w: DataFrame) -> DataFrame:
    return v.unionByName(w).groupBy("idx").agg(F.sum("x").alias("x"))


def normalize(v: DataFrame, signed: bool = False) -> DataFrame:
    """v divided by its largest absolute value, or with signed=True by its largest value, at least DBL_MIN; a zero norm leaves v."""
    top = F.greatest(F.max("x"), F.lit(DBL_MIN)) if signed else F.max(F.abs("x"))
    n = v.agg(top.alias("norm"))  # one row
    return v.crossJoin(F.broadcast(n)).select("idx", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("x"))


# iterations


def gram_apply(dense: DataFrame, x: list[float]) -> list[float]:
    """M' M x for dense rows (i, vals) with few columns: one job, no row is shuffled."""
    if len(x) > DRIVER_COLUMNS:
        raise ValueError("use entries and left_multiply for so many columns")
    y = dense.select("vals", F.aggregate(F.zip_with("vals", F.array(*[F.lit(float(v)) for v in x]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("y"))
    sums = [F.sum(F.element_at("vals", k + 1) * F.col("y")) for k in range(len(x))]
    return [v or 0.0 for v in y.agg(*sums).first()]


def power_iterate(dense: DataFrame, x: list[float], rounds: int, signed: bool = False) -> tuple[float, list[float]]:
    """(lambda, z) after y = M x, z = M' y, x = z / max|z|, as many rounds; lambda is the norm of the round before the last, 0 for one.

    signed: the norm is the largest value, at least DBL_MIN, as in the programs for dense files.
    """
    dense = dense.select("vals").persist() if rounds > 1 else dense
    try:
        lam, z = 0.0, gram_apply(dense, x)
        for _ in range(rounds - 1):
            lam = max(DBL_MIN, *z) if signed else max(abs(v) for v in z)
            z = gram_apply(dense, [v / lam for v in z] if lam > 0 else z)
        return lam, z
    finally:
        if rounds > 1:
            dense.unpersist()


def least_squares(dense: DataFrame, y: str, cols: int, rounds: int) -> list[float]:
    """x that minimises |M x - y| by conjugate gradients on the normal equations; y names a column beside vals."""
    dense = dense.select("vals", F.col(y).alias("y")).persist()
    try:
        rhs = [v or 0.0 for v in dense.agg(*[F.sum(F.element_at("vals", k + 1) * F.col("y")) for k in range(cols)]).first()]
        w, r = [0.0] * cols, [-v for v in rhs]
        p, rr = [-v for v in r], sum(v * v for v in r)
        for _ in range(rounds):
            if rr == 0:
                break
            q = gram_apply(dense, p)
            pq = sum(a * b for a, b in zip(p, q, strict=True))
            if pq == 0:
                break
            alpha = rr / pq
            w = [a + alpha * b for a, b in zip(w, p, strict=True)]
            r = [a + alpha * b for a, b in zip(r, q, strict=True)]
            new = sum(v * v for v in r)
            p = [new / rr * a - b for a, b in zip(p, r, strict=True)]
            rr = new
        return w
    finally:
        dense.unpersist()
