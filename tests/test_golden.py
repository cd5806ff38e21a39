"""The worked 8 x 6 example and the five-node graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmat.matrix import CompressedMatrix
from weftmat.operators import algebra, encode, grammar, graph, layout, reorder

TINY = [
    [5.3, 0, 8.1, 0, 6, 0], [2.7, 0, 6, 2.7, 5.3, 5.3], [5.3, 0, 8.1, 0, 6, 5.3], [6, 0, 0, 2.7, 0, 6],
    [0, 0, 0, 0, 6, 5.3], [5.3, 2.7, 6, 2.7, 0, 6], [0, 0, 6, 2.7, 0, 8.1], [2.7, 0, 6, 2.7, 5.3, 0],
]


@pytest.fixture(scope="module")
def tiny(spark):
    dense = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(TINY)], "i bigint, vals array<double>")
    return CompressedMatrix.from_dense(dense, 8, 6)


def by(df, key, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(key).collect()]


def test_dictionary_and_codes(tiny):
    assert by(tiny.dictionary(), "val_id", "v") == [5.3, 8.1, 6.0, 2.7]
    assert by(tiny.sequences(), "i", "seq") == [[1, 9, 17], [19, 15, 22, 5, 6], [1, 9, 17, 6], [13, 22, 18], [17, 6], [1, 20, 15, 22, 18], [15, 22, 12], [19, 15, 22, 5]]


def test_products(spark, tiny):
    x = spark.range(6).select(F.col("id").cast("int").alias("j"), F.lit(1.0).alias("x"))
    y = tiny.right_multiply(x)
    assert np.allclose(by(y, "i", "y"), [19.4, 22.0, 24.7, 14.7, 11.3, 22.7, 16.8, 16.7])
    assert np.allclose(by(tiny.left_multiply(y), "j", "z"), [546.73, 61.29, 826.41, 250.83, 537.51, 667.88])


@pytest.mark.parametrize(("rounds", "lam"), [(1, 0), (2, 826.41), (3, 628.7175547), (10, 620.3245285), (50, 620.3244975)])
def test_power(tiny, rounds, lam):
    assert tiny.power_iterate([1.0] * 6, rounds)[0] == pytest.approx(lam, abs=1e-6)


def test_split_alphabet_ole(tiny):
    s = tiny.sequences()
    part = lambda p: {r.i: r.seq for r in tiny.split(1).filter(F.col("part") == p).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("seq")).collect()}
    assert part("A") == {0: [1, 9, 17], 1: [19, 15, 22, 5], 2: [1, 9, 17, 6], 3: [22, 18], 4: [17, 6], 5: [15, 22, 18], 6: [15, 22], 7: [19, 15, 22, 5]}
    b = part("B")
    assert b == {1: [6], 3: [13], 5: [1, 20], 6: [12]}
    alpha = layout.alphabet(tiny.encode()[1])
    assert by(alpha, "rank", "code") == [0, 1, 5, 6, 9, 12, 13, 15, 17, 18, 19, 20, 22]
    assert by(layout.alphabet_gaps(alpha), "rank", "gap") == [0, 1, 4, 1, 3, 3, 1, 2, 2, 1, 1, 1, 2]
    want = {(1, 9): 2, (9, 17): 2, (19, 15): 2, (15, 22): 4, (22, 5): 2, (17, 6): 2, (22, 18): 2}
    assert {(r.a, r.b): r.freq for r in layout.bigram_freq(s).filter("freq > 1").collect()} == want
    assert {r.i: r.seq for r in layout.ole_encode(s).collect()}[5] == [1, 14, 3, 2, 2]


def test_ole_refuses_repeats(spark):
    with pytest.raises(Exception, match="repeated code"):
        layout.ole_encode(spark.createDataFrame([(0, [3, 3])], "i bigint, seq array<bigint>")).collect()


def test_similarity(tiny):
    w = {(r.c1, r.c2): r.w for r in tiny.similarity().collect()}
    rowsw = [[0, -2, -1, -2, 0], [0, 0, 0, 0], [-3, -2, 0], [-1, -1], [-1]]
    assert w == {(a, a + 1 + k): v for a, r in enumerate(rowsw) for k, v in enumerate(r)}
    for method in ("pathcover", "contract", "matching"):
        assert sorted(tiny.order(method)) == list(range(6))


def naive_contract(pairs, cols):
    """Path cover by contraction, everything computed anew from the members in each step."""
    w = {frozenset((a, b)): x for a, b, x in pairs}
    paths = [[c] for c in range(cols)]
    while True:
        best = None
        for i, p in enumerate(paths):
            for j, q in enumerate(paths):
                if i < j:
                    ends = [(w[frozenset((a, b))], a, b) for a in (p[0], p[-1]) for b in (q[0], q[-1]) if frozenset((a, b)) in w]
                    if ends:
                        near = min(w.get(frozenset((a, b)), 1e9) for a in p for b in q)
                        best = min(best or (1e18,), (near, min(p), min(q), *min(ends), i, j))
        if best is None:
            return {frozenset(e) for p in paths for e in zip(p, p[1:], strict=False)}
        _, _, _, _, a, b, i, j = best
        p, q = paths[i], paths[j]
        paths = [x for k, x in enumerate(paths) if k not in (i, j)] + [(p if p[-1] == a else p[::-1]) + (q if q[0] == b else q[::-1])]
        paths.sort(key=min)


def test_contraction_updates_weights():
    rng = np.random.default_rng(2)
    differ = 0
    for _ in range(200):
        cols = int(rng.integers(2, 9))
        weights = rng.permutation(cols * cols)
        pairs = [(a, b, -int(weights[a * cols + b])) for a in range(cols) for b in range(a + 1, cols) if rng.random() < 0.9]
        order = reorder.path_cover_contract(pairs, cols)
        assert sorted(order) == list(range(cols))
        want = naive_contract(pairs, cols)
        got = {frozenset(e) for e in zip(order, order[1:], strict=False)}
        assert want <= got
        plain = reorder.path_cover(pairs, cols)
        differ += not want <= {frozenset(e) for e in zip(plain, plain[1:], strict=False)}
    assert differ > 20  # it is not the plain cover


def test_matching_weight_is_the_largest():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(100):
        cols = int(rng.integers(2, 6))
        pairs = [(a, b, -int(rng.integers(0, 3000))) for a in range(cols) for b in range(a + 1, cols)]
        gain = {(a, b): -w // 256 + 1 for a, b, w in pairs if w < 0}
        best = max(sum(gain[a, b] for a, b in enumerate(pick) if b is not None) for pick in product([None, *range(cols)], repeat=cols) if all(b is None or (a, b) in gain for a, b in enumerate(pick)) and len([b for b in pick if b is not None]) == len({b for b in pick if b is not None}))
        assert reorder.matching_weight(pairs, reorder.matching(pairs, cols)) == best


def test_orders_and_sizes_by_block(spark, tiny):
    codes = tiny.encode()[1]
    sim = reorder.csm_blocks(tiny.entries, "i div 4")
    orders = reorder.order_blocks(sim, 6)
    assert {r.block: sorted(x.col for x in orders.filter(F.col("block") == r.block).collect()) for r in sim.select("block").distinct().collect()} == {0: list(range(6)), 1: list(range(6))}
    table = reorder.retest(codes, 6, "i div 4", sim).collect()
    assert {(r.method, r.block) for r in table} == {(m, b) for m in ("none", "pathcover", "contract", "matching") for b in (0, 1)}
    assert all(r.n_symbols >= 1 and r.est_bytes >= 1 for r in table)
    size = {r.encoding: r for r in tiny.sizes(2).collect()}
    nnz = codes.count()
    assert size["codes"].bytes == 4 * 8 + 4 * (nnz + 8) and set(size) == {"codes", "codes_iv", "grammar", "grammar_iv", "grammar_ans"}
    assert size["codes_iv"].bytes == 4 * 8 + -(-(nnz + 8) * 5 // 8) and size["grammar_iv"].bytes > 32


def test_hybrid_and_stored(spark, tiny, tmp_path):
    from weftmat.operators import hybrid
    from weftmat.sources import stored

    x = spark.range(6).select(F.col("id").cast("int").alias("j"), F.lit(1.0).alias("x"))
    rules, cseq, b = tiny.hybrid(2)
    values = tiny.dictionary()
    y = hybrid.right_multiply(rules, cseq, b, values, x, 6)
    assert np.allclose(by(y, "i", "y"), [19.4, 22.0, 24.7, 14.7, 11.3, 22.7, 16.8, 16.7])
    z = hybrid.left_multiply(rules, cseq, b, values, y, 6)
    assert np.allclose(by(z, "j", "z"), [546.73, 61.29, 826.41, 250.83, 537.51, 667.88])
    rules, cseq = tiny.compress(3)
    for codec in ("iv", "ans", "rans", "bytes"):
        stored.store_coded(rules, cseq, str(tmp_path / codec), codec)
        back = stored.load_coded(spark, str(tmp_path / codec), codec)
        assert [sorted(map(tuple, t.collect())) for t in back] == [sorted(map(tuple, t.collect())) for t in (rules, cseq)]
    stored.store_grammar(rules, cseq, str(tmp_path / "g"))
    one = stored.load_grammar(spark, str(tmp_path / "g"), [1])
    assert sorted(map(tuple, one[1].collect())) == sorted(map(tuple, cseq.filter("block = 1").collect()))
    with pytest.raises(Exception, match="out of range"):
        encode.checked_codes(tiny.encode()[1], 3, 6).collect()


def test_matching_is_maximal():
    pairs = [(0, 1, -2560), (0, 2, -2500), (1, 2, -256), (1, 3, -10)]
    order = reorder.matching_order(pairs, 4)
    chosen = set(zip(order, order[1:], strict=False))
    assert sorted(order) == [0, 1, 2, 3]
    assert (0, 1) in chosen and (1, 2) in chosen or (0, 2) in chosen


@pytest.mark.parametrize("blocks", [1, 3, 6])
def test_grammar(spark, tiny, blocks):
    rules, cseq = (df.cache() for df in tiny.compress(blocks))
    assert rules.filter("left >= nt OR right >= nt").count() == 0
    assert by(grammar.expand(rules, cseq), "i", "seq") == by(tiny.sequences(), "i", "seq")
    values = tiny.dictionary()
    w = values.select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"), "val_id", "v").select((F.col("val_id") * 6 + F.col("j") + 1).alias("sym"), F.col("v").alias("w"))
    y = [19.4, 22.0, 24.7, 14.7, 11.3, 22.7, 16.8, 16.7]
    assert np.allclose(by(grammar.right_multiply(rules, cseq, w), "i", "y"), y)
    mass = grammar.symbol_masses(rules, cseq, spark.createDataFrame(list(enumerate(y)), "i bigint, y double"))
    z = mass.join(w, "sym").groupBy(((F.col("sym") - 1) % 6).alias("j")).agg(F.sum(F.col("w") * F.col("mass")).alias("z"))
    assert np.allclose(by(z, "j", "z"), [546.73, 61.29, 826.41, 250.83, 537.51, 667.88])


def test_repair_overlaps():
    rules, rows = grammar.repair([[7] * 7, [], [1, 2]], 8)
    text = {}
    for k, (a, b) in enumerate(rules):
        text[8 + k] = text.get(a, [a]) + text.get(b, [b])
    assert [[x for s in r for x in text.get(s, [s])] for r in rows] == [[7] * 7, [], [1, 2]]
    assert all(a < 8 + k and b < 8 + k for k, (a, b) in enumerate(rules))


def test_text_grammar():
    for t in ("", "a", "abababab", "mississippi" * 3):
        assert grammar.expand_text(*grammar.repair_text(t)) == t


def test_frequent_cover():
    pairs = [(0, 1, 9), (1, 2, 5), (2, 3, 2)]
    assert reorder.path_cover_frequent(pairs, 5) == [0, 1, 2, 3, 4]
    assert reorder.path_cover_frequent([], 3) == [0, 1, 2]
    # the median pair (0, 2) comes first, then (0, 1); (1, 2) would close a circle
    assert reorder.path_cover_frequent([(0, 1, 9), (0, 2, 5), (1, 2, 2)], 3) == [1, 0, 2]


GRAPH = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]


@pytest.mark.parametrize(
    ("extra", "args", "want"),
    [
        ([], {"rounds": 1}, [0.236, 0.146, 0.506, 0.056, 0.056]),
        ([], {"rounds": 10}, [0.375623426, 0.190637834, 0.384958240, 0.024390250, 0.024390250]),
        ([], {"eps": 1e-4}, [0.372480428, 0.192002538, 0.386736547, 0.024390244, 0.024390244]),
        ([(3, 3)], {"rounds": 10}, [0.366350263, 0.187610674, 0.377210054, 0.044438759, 0.024390250]),
    ],
)
def test_pagerank(spark, extra, args, want):
    from weftmat.plans.scratch import materialize

    e = graph.clean_edges(spark.createDataFrame(GRAPH + GRAPH[:1] + extra, "src bigint, dst bigint"))
    got = graph.pagerank(e, 5, save=lambda df, k: materialize(df, f"r{k}"), **args)
    assert np.allclose(by(got, "node", "rank"), want, atol=1e-8)
    if args == {"rounds": 10} and not extra:
        assert by(graph.topk(got, 3), F.desc("rank"), "node") == [2, 0, 1]


def test_least_squares_and_vectors(spark, tiny):
    x = spark.range(6).select(F.col("id").cast("int").alias("j"), F.lit(1.0).alias("x"))
    assert np.allclose(tiny.lstsq(tiny.right_multiply(x), 12), [1] * 6, atol=1e-5)
    v = algebra.constant_vector(spark, 4, [1.0, -4.0])
    assert algebra.inf_norm(v).first().norm == 4.0
    assert by(algebra.normalize(v), "idx", "x") == [0.25, -1, 0.25, -1]
    assert by(algebra.normalize(v, signed=True), "idx", "x") == [1, -4, 1, -4]
    assert by(algebra.normalize(algebra.scale(v, 0.0)), "idx", "x") == [0, 0, 0, 0]


def test_empty_rows_and_zero_matrix(spark):
    m = CompressedMatrix(spark.createDataFrame([], "i bigint, j int, v double"), 3, 2)
    x = spark.createDataFrame([(0, 1.0), (1, 1.0)], "j int, x double")
    assert by(m.right_multiply(x), "i", "y") == [0, 0, 0]
    assert m.dictionary().count() == 0
    assert [r.w for r in m.similarity().collect()] == [0]


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(0).alias("z"))
    assert all(r.k == r.n for r in encode.number_rows(df, ["k", "z"], "n").collect())
    # one leading value for all, and nulls, which come first
    skewed = df.select(F.lit(5).alias("lead"), "k")
    assert all(r.k == r.n for r in encode.number_rows(skewed, ["lead", "k"], "n").collect())
    odd = spark.createDataFrame([(None, 2), (None, 1), (5, 1), (1, 1), (9, 1), (3, 1)], "a int, b int")
    assert [(r.a, r.b) for r in sorted(encode.number_rows(odd, ["a", "b"], "n").collect(), key=lambda r: r.n)] == [(None, 1), (None, 2), (1, 1), (3, 1), (5, 1), (9, 1)]
    assert encode.number_rows(odd.limit(0), ["a", "b"], "n").count() == 0
