import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmat.sources import readers, sinks
from weftmat.streaming import streaming_right_multiply


def test_dense_csv_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1.5,0,2\n0,-3,4e1\n7,8,9\n")
    d = readers.dense_csv(spark, str(tmp_path / "m.csv"), 3)
    assert [r.vals for r in d.orderBy("i").collect()] == [[1.5, 0, 2], [0, -3, 40], [7, 8, 9]]
    sinks.write_csv(d, str(tmp_path / "out"), skip_rows=1, skip_left=1)
    assert [r.vals for r in readers.dense_csv(spark, str(tmp_path / "out"), 2).orderBy("i").collect()] == [[-3, 40], [8, 9]]
    assert [r.vals for r in readers.dense_csv(spark, str(tmp_path / "m.csv"), 2, skip_rows=1, skip_cols=1).orderBy("i").collect()] == [[-3, 40], [8, 9]]


def test_csv_with_wrong_cells_fails(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="cells in row"):
        readers.dense_csv(spark, str(tmp_path / "m.csv"), 2).collect()


def test_complex(spark, tmp_path):
    (tmp_path / "c.csv").write_text("(1.0+2.0j),(-3e1-.5j)\n")
    assert [(v.re, v.im) for v in readers.complex_csv(spark, str(tmp_path / "c.csv"), 2).first().vals] == [(1, 2), (-30, -0.5)]
    np.array([1, 2, -3, 4.5]).tofile(tmp_path / "c.bin")
    assert [(v.re, v.im) for v in readers.dense_binary(spark, str(tmp_path / "c.bin"), 1, 2, "c128").first().vals] == [(1, 2), (-3, 4.5)]


@pytest.mark.parametrize(("dtype", "np_type"), [("f64", "<f8"), ("f32", "<f4"), ("i32", "<i4")])
def test_binary(spark, tmp_path, dtype, np_type):
    x = np.arange(12).reshape(4, 3).astype(np_type)
    x.tofile(tmp_path / "m.bin")
    d = readers.dense_binary(spark, str(tmp_path / "m.bin"), 4, 3, dtype)
    assert [r.vals for r in d.orderBy("i").collect()] == x.tolist()
    parts = sinks.binary_blocks(d, 4, 2, dtype).orderBy("block", "chunk").collect()
    assert b"".join(bytes(p.data) for p in parts) == x.tobytes()
    with pytest.raises(Exception, match="bytes"):
        readers.dense_binary(spark, str(tmp_path / "m.bin"), 5, 3, dtype).collect()


def test_sparse_and_boolean(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0 1 2.5\n2 0 1\n2 0 1\n")
    e = readers.triplets(spark, str(tmp_path / "t.txt"), 3, 2)
    assert sorted(map(tuple, e.collect())) == [(0, 1, 2.5), (2, 0, 1), (2, 0, 1)]
    with pytest.raises(Exception, match="out of range"):
        readers.triplets(spark, str(tmp_path / "t.txt"), 2, 2).collect()
    (tmp_path / "b.txt").write_text("0 1\n1 0\n1 1\n")
    b = readers.boolean(spark, str(tmp_path / "b.txt"), 2, 2)
    assert [r.vals for r in readers.boolean_dense(b, 2).orderBy("i").collect()] == [[0, 1], [1, 1]]


def test_edges_vectors_tours(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket\n% note\n3 3 3\n1 2\n2 3 junk\n3 1\n1 2\n")
    e = readers.edge_list(spark, str(tmp_path / "g.mtx"), header=True, shift=-1)
    assert sorted(map(tuple, e.collect())) == [(0, 1), (0, 1), (2, 0)]
    sinks.write_edges(e, str(tmp_path / "out"))
    assert (tmp_path / "out.header").is_dir()
    np.array([1.5, 2]).tofile(tmp_path / "v.dbl")
    v = readers.vector(spark, str(tmp_path / "v.dbl"))
    assert sinks.vector_bytes(v) == np.array([1.5, 2]).tobytes()
    (tmp_path / "t.sol").write_text("NAME\n" + sinks.tour_lines([2, 0, 1]))
    assert [r.col for r in readers.tour(spark, str(tmp_path / "t.sol")).orderBy("pos").collect()] == [2, 0, 1]


def test_dictionary_sink(spark, tmp_path):
    values = spark.createDataFrame([(0, 1.0), (1, 2.5)], "val_id bigint, v double")
    assert sinks.write_dictionary(values, str(tmp_path / "d"), "int") == 1
    sinks.write_codes(spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "block bigint, i bigint, code bigint"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("block = 1").first().code == 6


def test_streaming_product(spark, tmp_path):
    spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0)], "i bigint, j int, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("i bigint, j int, v double").parquet(str(tmp_path / "in"))
    x = spark.createDataFrame([(0, 1.0), (1, 10.0)], "j int, x double")
    q = streaming_right_multiply(s, x).writeStream.outputMode("complete").format("memory").queryName("ymx").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.i: r.y for r in spark.table("ymx").collect()} == {0: 32.0, 1: 40.0}


def test_first_cells(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i bigint, j int, v double")
    assert readers.first_cells(e, 2, 2).count() == 1
    assert e.select(readers.fill_missing(F.array(F.lit("NA"), F.lit(" "), F.lit("3")), "0").alias("c")).first().c == ["0", "0", "3"]


def test_declared_rows_and_odd_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n\n3,4\n  \n5,6\n")
    path = str(tmp_path / "m.csv")
    assert [(r.i, r.vals) for r in readers.dense_csv(spark, path, 2, rows=3).orderBy("i").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6])]
    for rows in (2, 4):
        with pytest.raises(ValueError, match="declared"):
            readers.dense_csv(spark, path, 2, rows=rows)
    (tmp_path / "c.csv").write_text("(1+2j),(3-4j)\n(1+2j)\n")
    with pytest.raises(Exception, match="cells in row"):
        readers.complex_csv(spark, str(tmp_path / "c.csv"), 2).collect()
    (tmp_path / "d.csv").write_text("(1+2j),3\n")
    with pytest.raises(Exception, match="no complex number"):
        readers.complex_csv(spark, str(tmp_path / "d.csv"), 2).collect()


def test_lists_records_and_trimmed_blocks(spark, tmp_path):
    np.arange(10_000, dtype="<i4").tofile(tmp_path / "s.int")
    assert [(r.pos, r.sym) for r in readers.int_stream(spark, str(tmp_path / "s.int")).orderBy("pos").collect()] == [(i, i) for i in range(10_000)]
    with pytest.raises(ValueError, match="whole number"):
        readers.records(spark, str(tmp_path / "s.int"), 7)
    syms = spark.createDataFrame([(i, 9 - i) for i in range(10)], "pos bigint, sym bigint")
    sinks.write_list(syms, str(tmp_path / "list"))
    assert sorted(map(tuple, readers.text_list(spark, str(tmp_path / "list")).collect())) == sorted(map(tuple, syms.collect()))
    x = np.arange(20.0).reshape(5, 4)
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i bigint, vals array<double>")
    parts = sinks.binary_blocks(d, 4, 2, skip_rows=1, skip_left=1, skip_right=1).orderBy("block", "chunk").collect()
    assert b"".join(bytes(p.data) for p in parts) == x[1:, 1:3].tobytes()


def test_boolean_rows_without_ones_and_edge_counts(spark):
    b = spark.createDataFrame([(0, 1), (2, 0)], "i bigint, j int")
    assert [r.vals for r in readers.boolean_dense(b, 2, rows=4).orderBy("i").collect()] == [[0, 1], [0, 0], [1, 0], [0, 0]]
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "src bigint, dst bigint")
    assert sorted(map(tuple, sinks.edge_counts(e).collect())) == [("col", 1, 1), ("col", 2, 1), ("row", 0, 2)]
    sim = spark.createDataFrame([(0, 1, -3), (0, 2, 0), (1, 2, -1)], "c1 int, c2 int, w bigint")
    assert sorted((r.c1, r.value) for r in sinks.similarity_lines(sim, 3).collect()) == [(0, "-3 0"), (1, "-1")]
