import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.operators import cells as c
from quiver.operators import linalg as la
from quiver.operators import tables as t


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_take_drop_cut(spark):
    a = arr(1, 2, 3)
    assert one(spark, c.take(5, a)) == [1, 2, 3, 1, 2] and one(spark, c.take(-5, a)) == [2, 3, 1, 2, 3]
    assert one(spark, c.drop(5, a)) == [] and one(spark, c.drop(-1, a)) == [1, 2]
    assert one(spark, c.cut([0, 2], a)) == [[1, 2], [3]] and one(spark, c.rotate(-1, a)) == [3, 1, 2]


def test_reshape_and_flip(spark):
    a = arr(*range(1, 8))
    assert one(spark, c.reshape(a, None, 3)) == [[1, 2, 3], [4, 5, 6], [7]]
    assert one(spark, c.reshape(a, 3, None)) == [[1, 2], [3, 4], [5, 6, 7]]
    assert one(spark, c.reshape(arr(1, 2), 2, 3)) == [[1, 2, 1], [2, 1, 2]]
    assert one(spark, c.flip(c.reshape(arr(1, 2, 3, 4), 2, 2))) == [[1, 3], [2, 4]]
    with pytest.raises(Exception, match="length"):
        one(spark, c.flip(c.reshape(a, None, 3)))


def test_lookup(spark):
    a = arr(3, 1, 3)
    assert one(spark, c.find(a, F.lit(3))) == 0 and one(spark, c.find(a, F.lit(9))) == 3
    assert one(spark, c.group(a)) == [[0, 2], [1]] and one(spark, c.grade(a)) == [1, 0, 2]
    assert one(spark, c.grade(a, up=False)) == [0, 2, 1] and one(spark, c.where(arr(1, 0, 2))) == [0, 2, 2]
    with pytest.raises(Exception, match="index"):
        one(spark, c.at_strict(a, F.lit(7)))


def test_folds(spark):
    a = arr(1, 2, 3, 4)
    assert one(spark, c.over(lambda x, y: x - y, a)) == -8
    assert one(spark, c.scan(lambda x, y: x + y, a)) == [1, 3, 6, 10]
    assert one(spark, c.slide(lambda x, y: y - x, arr(1, 4, 9, 16), 2)) == [3, 7]
    assert one(spark, c.do_fold(10, lambda x: x + x, F.lit(1))) == 1024
    with pytest.raises(Exception, match="length"):
        one(spark, c.each2(lambda x, y: x + y, a, arr(1, 2)))


def test_positions_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 3)], "v int")
    assert [tuple(r) for r in t.with_pos(df, ["v"]).orderBy("pos").collect()] == [(3, 0), (3, 1), (5, 2), (9, 3)]
    cuts = spark.createDataFrame([(3,), (4,), (9,)], "c int")
    assert sorted((r.v, r.cell) for r in t.bin_below(df, cuts, "v", "c").collect()) == [(3, 0), (3, 0), (5, 2), (9, 2)]


def test_closure_and_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {tuple(r) for r in t.closure(edges).collect()} == {(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (1, 4)}
    x = spark.createDataFrame([(40,)], "v int")
    got = t.fixpoint(lambda d: d.select((F.col("v") / 2).cast("int").alias("v")), x, lambda a, b: a.exceptAll(b).isEmpty())
    assert got.first().v == 0


def test_unfinished_loops_fail(spark):
    x = spark.createDataFrame([(0,)], "v int")
    up = lambda a: a + 1
    assert x.select(c.while_(lambda a: a < 64, up, F.col("v")).alias("v")).first().v == 64
    with pytest.raises(Exception, match="still holds after 64 rounds"):
        x.select(c.while_(lambda a: a < 65, up, F.col("v")).alias("v")).collect()
    with pytest.raises(RuntimeError, match="not reached"):
        t.fixpoint(lambda d: d.select((F.col("v") + 1).alias("v")), x, lambda a, b: False, rounds=3)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, pos long, v double")
    assert t.group(df, "k", "pos").count() == 0 and t.global_scan(df, "v", ["pos"]).count() == 0
    assert t.over(df, s=F.coalesce(F.sum("v"), F.lit(0.0))).first().s == 0.0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_decompositions(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n)) + 4 * np.eye(n)
    p, low, u = la.lu(a)
    assert np.allclose(p @ low @ u, a) and np.allclose(low, np.tril(low)) and np.allclose(u, np.triu(u))
    p, low, d, u = la.ldu(a)
    assert np.allclose(p @ low @ d @ u, a) and np.allclose(np.diag(u), 1)
    u, s, vt = la.svd(a)
    assert np.allclose(u @ s @ vt, a) and (u[(np.abs(u) > 1e-12).argmax(axis=0), range(n)] > 0).all()
    assert np.allclose(la.rref(a), np.eye(n)) and np.allclose(a @ la.lsq(a, np.ones(n)), 1)


def test_singular():
    a = np.array([[1.0, 2.0], [2.0, 4.0]])
    assert la.det(a) == 0 and np.isnan(la.lsq(a, np.ones(2))).all() and np.allclose(la.rref(a), [[1, 2], [0, 0]])


def test_product_of_rows(spark):
    """X X' on a few rows, where its size is no matter."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3))
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(5) for j in range(3)], "i int, j int, v double")
    got = {(r.i, r.j): r.v for r in la.mul(df, la.flip(df)).collect()}
    assert all(abs(got[i, j] - x[i] @ x[j]) < 1e-12 for i in range(5) for j in range(5))


def test_null_keys_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0), (4, 4.0), (None, 5.0)], "k int, v double")
    got = [(r.k, r.running) for r in t.global_scan(df, "v", ["k"]).orderBy("running").collect()]
    assert len(got) == 5 and [k for k, _ in got] == [None, None, 1, 2, 4] and got[-1][1] == 15.0
    same = spark.range(0, 1000, 1, 4).withColumn("k", F.lit(1))
    assert [r.id for r in t.with_pos(same, ["k"], parts=6).orderBy("pos").collect()] == list(range(1000))
    none = spark.createDataFrame([(1, None), (2, 1), (3, None)], "k int, v int")
    assert [r.running for r in t.global_scan(none, "v", ["k"]).orderBy("k").collect()] == [None, 1, 1]


def test_take_turns(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "pos int, v string")
    word = lambda n: "".join(r.v for r in t.take(df, n).orderBy("pos").collect())
    assert word(2) == "ab" and word(7) == "abcabca" and word(-2) == "bc" and word(-7) == "cabcabc" and word(0) == ""
    assert t.take(df.limit(0), 5).count() == 0


def test_loops_that_keep_steps(spark):
    x = spark.createDataFrame([(40,)], "v int")
    half = lambda d: d.select((F.col("v") / 2).cast("int").alias("v"))
    assert [d.first().v for d in t.steps(half, x, lambda a, b: a.exceptAll(b).isEmpty())] == [40, 20, 10, 5, 2, 1, 0]
    assert one(spark, c.converge_scan(lambda a: F.floor(a / 2).cast("int"), F.lit(9))) == [9, 4, 2, 1, 0]
    with pytest.raises(Exception, match="not reached"):
        one(spark, c.converge_scan(lambda a: a + 1, F.lit(9)))
    with pytest.raises(Exception, match="still holds"):
        one(spark, c.while_scan(lambda a: a < 1000, lambda a: a + 1, F.lit(9)))


def test_long_cells_are_scanned_in_parts(spark):
    df = spark.createDataFrame([(list(range(20_000)),)], "a array<long>")
    assert df.select(c.scan(lambda a, b: a + b, "a").alias("s")).first().s == np.cumsum(range(20_000)).tolist()
    assert one(spark, c.scan(lambda a, b: a + b, F.slice(arr(1), 1, 0))) == []


def test_closure_must_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError, match="not reached"):
        t.closure(edges, rounds=2)


def test_unequal_rows_are_a_length_error(spark):
    a, b = (spark.createDataFrame([(i, i) for i in range(n)], f"pos int, {x} int") for n, x in ((3, "x"), (4, "y")))
    with pytest.raises(Exception, match="length"):
        t.zip_rows(a, b).collect()


def test_ragged_shape(spark):
    assert one(spark, c.shape(F.array(arr(1, 2), arr(3)))) == [2] and one(spark, c.shape(F.array(arr(1, 2), arr(3, 4)))) == [2, 2]


def test_bins_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "a" if i % 10 else None if i % 20 else "b", float(x)) for i, x in enumerate(rng.integers(0, 50, 600))]
    cuts = [("a" if i % 3 else None, float(x)) for i, x in enumerate(rng.integers(0, 50, 80))]
    v, k = spark.createDataFrame(rows, "i long, k string, x double"), spark.createDataFrame(cuts, "k string, y double")
    want = sorted((i, sum(g == h and y < x for h, y in cuts)) for i, g, x in rows)
    for hot in (False, True):
        assert sorted((r.i, r.cell) for r in t.bin_below(v, k, "x", "y", ["k"], hot=hot).collect()) == want


@pytest.mark.parametrize("kind", ["lu", "ldu", "qr", "svd"])
def test_rebuilt_halves(spark, kind):
    """Odd multiples of 1/128 are halves at six digits: they go away from zero, whatever noise the factors bring."""
    a = (2 * np.random.default_rng(5).integers(-16, 17, (8, 8)) + 1) / 128 + 3 * np.eye(8)
    want = [[float(f"{np.sign(x) * np.floor(abs(x) * 1e6 + 0.5) / 1e6:.6f}") for x in r] for r in a]
    df = spark.createDataFrame([(a.tolist(),)], "m array<array<double>>")
    assert df.select(la.rebuilt(kind, "m", 6)).first()[0] == want
