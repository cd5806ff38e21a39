"""CompressedMatrix: the public face of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.operators import algebra, encode, grammar, hybrid, layout, reorder, report


@dataclass(frozen=True)
class CompressedMatrix:
    """Entries (i, j, v) with the matrix's size. Encodings are derived tables; every product has one meaning."""

    entries: DataFrame
    rows: int
    cols: int

    @classmethod
    def from_dense(cls, dense: DataFrame, rows: int, cols: int) -> CompressedMatrix:
        """From (i, vals)."""
        cells = dense.select("i", F.posexplode("vals").alias("j", "v"))
        return cls(cells.filter("v <> 0"), rows, cols)

    def dictionary(self) -> DataFrame:
        return encode.dictionary(self.entries, self.cols)

    def encode(self) -> tuple[DataFrame, DataFrame]:
        """(values, codes)."""
        values = self.dictionary()
        return values, encode.csrv(self.entries, values, self.cols)

    def sequences(self) -> DataFrame:
        return encode.sequences(self.encode()[1])

    def split(self, threshold: int = 1) -> DataFrame:
        return layout.hybrid_split(self.sequences(), threshold)

    def compress(self, blocks: int = 1) -> tuple[DataFrame, DataFrame]:
        """Grammar (rules, cseq) of each row block."""
        return grammar.compress(self.sequences().withColumn("block", encode.block_of(self.rows, blocks)))

    def right_multiply(self, x: DataFrame) -> DataFrame:
        return algebra.right_multiply(self.entries, x, self.rows, self.cols)

    def left_multiply(self, y: DataFrame) -> DataFrame:
        return algebra.left_multiply(self.entries, y, self.cols, self.rows)

    def dense_rows(self) -> DataFrame:
        """(i, vals) of the rows that have entries."""
        m = self.entries.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "v"))).alias("m"))
        return m.select("i", F.transform(F.sequence(F.lit(0), F.lit(self.cols - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("vals"))

    def power_iterate(self, x: list[float], rounds: int) -> tuple[float, list[float]]:
        return algebra.power_iterate(self.dense_rows(), x, rounds)

    def lstsq(self, y: DataFrame, rounds: int) -> list[float]:
        """y is (i, y)."""
        rows = self.dense_rows().join(y, "i")
        return algebra.least_squares(rows, "y", self.cols, rounds)

    def similarity(self) -> DataFrame:
        return reorder.csm(self.entries, self.cols)

    def order(self, method: str = "pathcover", k: int | None = None) -> list[int]:
        """A column order from the similarity of at most reorder-sized column counts: pathcover, contract or matching."""
        sim = self.similarity()
        sim = sim if k is None else reorder.prune_local(sim, min(k, self.cols - 1))
        if self.cols > algebra.DRIVER_COLUMNS:
            raise ValueError("too many columns for an order on the driver")
        pairs = [(r.c1, r.c2, r.w) for r in sim.collect()]
        return reorder.METHODS[method](pairs, self.cols)

    def report(self) -> DataFrame:
        return encode.stats(self.entries, self.rows, self.cols)

    def sizes(self, blocks: int = 1) -> DataFrame:
        """Bytes of the matrix in every encoding."""
        values, codes = self.encode()
        return report.sizes(values, codes, self.rows, self.cols, *self.compress(blocks))

    def hybrid(self, blocks: int = 1, threshold: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rules, cseq, b): part A as a grammar by row block, part B as codes; see operators.hybrid for products."""
        return hybrid.compress_split(self.split(threshold), f"i div {-(-self.rows // blocks)}")
