"""Vector and matrix operators against dense arithmetic on small cases."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecon.operators import matrices as M
from sparkrecon.operators import vectors as V

RNG = np.random.default_rng(5)


def vec(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double")


def mat(spark, dense):
    cells = [(i, j, float(v)) for (i, j), v in np.ndenumerate(dense)]
    return spark.createDataFrame(cells, "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for i, j, v in df.select("i", "j", "v").collect():
        out[i, j] += v
    return out


def dense_vec(df, n):
    out = np.zeros(n)
    for k, v in df.select("k", "v").collect():
        out[k] += v
    return out


def test_reductions(spark):
    x = [3.0, -4.0, 0.0, 4.0]
    df = vec(spark, x)
    assert V.asum(df).first()[0] == 11
    assert V.iamax(df).first()[0] == 1
    assert V.dot(df, df).first()[0] == 41
    assert V.nrm2(df).first()[0] == pytest.approx(np.sqrt(41))


@pytest.mark.parametrize("scale", [1e-300, 1e-160, 1.0, 1e160, 1e300])
def test_norm_without_overflow(spark, scale):
    df = vec(spark, [3 * scale, 4 * scale])
    assert V.nrm2(df).first()[0] == pytest.approx(5 * scale, rel=1e-12)


def test_norm_of_mixed_and_empty(spark):
    assert V.nrm2(vec(spark, [3e200, 4e-200, 4e200])).first()[0] == pytest.approx(5e200)
    assert V.nrm2(vec(spark, [0.0, 0.0])).first()[0] == 0
    assert V.nrm2(vec(spark, []).filter("k < 0")).first()[0] == 0


def test_axpy_zero_leaves_y(spark, rows):
    x, y = vec(spark, [1, 2, 3]), vec(spark, [5, 6])
    assert rows(V.axpy(0.0, x, y)) == [(0, 5.0), (1, 6.0)]
    assert rows(V.axpy(2.0, x, y)) == [(0, 7.0), (1, 10.0), (2, 6.0)]


def test_stride(spark, rows):
    x = vec(spark, range(10))
    assert rows(V.stride(x, 3, 3)) == [(0, 0.0), (1, 3.0), (2, 6.0)]
    assert rows(V.stride(x, -3, 3)) == [(0, 6.0), (1, 3.0), (2, 0.0)]
    with pytest.raises(ValueError):
        V.stride(x, 0, 3)


@pytest.mark.parametrize("flag,want", [(-2, (1, 2)), (-1, (6.5, 11)), (0, (7, 5)), (1, (2.5, 7))])
def test_rotm(spark, flag, want):
    got = V.rotm(vec(spark, [1]), vec(spark, [2]), flag, (0.5, 3.0, 3.0, 4.0)).first()
    assert (got["x"], got["y"]) == want


@pytest.mark.parametrize("ta,tb", list(itertools.product("NTc", "nTC")))
def test_gemm_all_transposes(spark, ta, tb):
    a, b, c = RNG.normal(size=(3, 4)), RNG.normal(size=(4, 2)), RNG.normal(size=(3, 2))
    left = a if ta.upper() == "N" else a.T
    right = b if tb.upper() == "N" else b.T
    got = M.gemm(mat(spark, left), mat(spark, right), mat(spark, c), 2.0, -1.0, ta, tb)
    np.testing.assert_allclose(dense(got, (3, 2)), 2 * a @ b - c)


def test_gemm_shortcuts(spark):
    a, c = mat(spark, np.ones((2, 2))), mat(spark, np.full((2, 2), np.nan))
    np.testing.assert_allclose(dense(M.gemm(a, a, c, beta=0.0), (2, 2)), np.full((2, 2), 2.0))
    np.testing.assert_allclose(dense(M.gemm(a, a, a, alpha=0.0, beta=3.0), (2, 2)), np.full((2, 2), 3.0))
    assert M.gemm(a, a, alpha=0.0).count() == 0
    with pytest.raises(ValueError):
        M.gemm(a, a, ta="X")


def test_gemm_over_a_grid_of_hot_keys(spark):
    a, b = RNG.normal(size=(9, 3)), RNG.normal(size=(3, 8))
    np.testing.assert_allclose(dense(M.gemm(mat(spark, a), mat(spark, b), hot_rows=2), (9, 8)), a @ b)


@pytest.mark.parametrize("uplo", "UL")
def test_rank_updates_across_tiles(spark, monkeypatch, uplo):
    monkeypatch.setattr(M, "TILE", 3)
    n = 7
    x, y, a = RNG.normal(size=n), RNG.normal(size=n), RNG.normal(size=(n, n))
    half = np.triu if uplo == "U" else np.tril
    got = M.syr(0.5, vec(spark, x), mat(spark, a), n, uplo)
    np.testing.assert_allclose(dense(got, (n, n)), half(a + 0.5 * np.outer(x, x)))
    got = M.syr2(0.5, vec(spark, x), vec(spark, y), mat(spark, a), n, uplo)
    np.testing.assert_allclose(dense(got, (n, n)), half(a + 0.5 * (np.outer(x, y) + np.outer(y, x))))


def test_ger_rectangular(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 2)
    x, y, a = RNG.normal(size=3), RNG.normal(size=5), RNG.normal(size=(3, 5))
    got = M.ger(-2.0, vec(spark, x), vec(spark, y), mat(spark, a), 5)
    np.testing.assert_allclose(dense(got, (3, 5)), a - 2 * np.outer(x, y))


@pytest.mark.parametrize("uplo,trans", list(itertools.product("UL", "NT")))
def test_rank_k_updates(spark, uplo, trans):
    a, b, c = RNG.normal(size=(4, 3)), RNG.normal(size=(4, 3)), RNG.normal(size=(4, 4))
    half = np.triu if uplo == "U" else np.tril
    sa, sb = (a, b) if trans == "N" else (a.T, b.T)
    got = M.syrk(mat(spark, sa), mat(spark, c), 2.0, 0.5, trans, uplo)
    np.testing.assert_allclose(dense(got, (4, 4)), half(2 * a @ a.T + 0.5 * c))
    got = M.syr2k(mat(spark, sa), mat(spark, sb), mat(spark, c), 2.0, 0.5, trans, uplo)
    np.testing.assert_allclose(dense(got, (4, 4)), half(2 * (a @ b.T + b @ a.T) + 0.5 * c))


def test_gram_checks_width(spark):
    good = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>")
    np.testing.assert_allclose(dense(M.gram(good, "x", 2, 1.0, "U"), (2, 2)), [[10, 14], [0, 20]])
    np.testing.assert_allclose(dense(M.gram(good, "x", 2, 2.0, "L"), (2, 2)), [[20, 0], [28, 40]])
    bad = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "x array<double>")
    with pytest.raises(Exception, match="2 numbers"):
        M.gram(bad, "x", 2).collect()


@pytest.mark.parametrize("uplo", "UL")
def test_packed_round_trip(spark, rows, uplo):
    n = 6
    a = RNG.normal(size=(n, n))
    half = np.triu if uplo == "U" else np.tril
    packed = M.coo_to_packed(mat(spark, a), n, uplo)
    assert [p for p, _ in rows(packed)] and {p for p, _ in rows(packed)} == set(range(n * (n + 1) // 2))
    np.testing.assert_allclose(dense(M.packed_positions_to_coo(packed, n, uplo), (n, n)), half(a))
    order = [(i, j) for j in range(n) for i in range(n) if (i <= j if uplo == "U" else i >= j)]
    want = {p: a[i, j] for p, (i, j) in enumerate(order)}
    assert {p: v for p, v in rows(packed)} == want


def test_structured_products(spark):
    n = 5
    a, x = RNG.normal(size=(n, n)), RNG.normal(size=n)
    A, X = mat(spark, a), vec(spark, x)
    sym = np.triu(a) + np.triu(a, 1).T
    band = np.array([[v if abs(i - j) <= 1 else 0 for j, v in enumerate(r)] for i, r in enumerate(sym)])
    unit = np.tril(a, -1) + np.eye(n)
    np.testing.assert_allclose(dense_vec(M.symv(A, X, uplo="U"), n), sym @ x)
    np.testing.assert_allclose(dense_vec(M.sbmv(A, X, 1, uplo="U"), n), band @ x)
    np.testing.assert_allclose(dense_vec(M.trmv(A, X, "L", "T", unit=n), n), unit.T @ x)
    np.testing.assert_allclose(dense(M.trmm(A, A, 2.0, "R", "L", "T"), (n, n)), 2 * a @ np.tril(a).T)
    np.testing.assert_allclose(dense(M.symm(A, A, side="L", uplo="L"), (n, n)), (np.tril(a) + np.tril(a, -1).T) @ a)
    packed = M.coo_to_packed(A, n, "U")
    np.testing.assert_allclose(dense_vec(M.spmv(packed, X, n), n), sym @ x)
    np.testing.assert_allclose(dense_vec(M.tpmv(packed, X, n, "U"), n), np.triu(a) @ x)


def test_colmajor_round_trip(spark):
    df = spark.createDataFrame([("m", [float(v) for v in range(6)])], "id string, a array<double>")
    coo = M.colmajor_to_coo(df, "a", 2, ["id"])
    assert coo.filter("i = 2 and j = 3").first()["v"] == 5
    back = M.coo_to_colmajor(coo.filter("v <> 3"), 2, 3, ["id"]).first()["arr"]
    assert back == [0, 1, 2, 0, 4, 5]


def test_entry_outside_the_shape_is_an_error(spark):
    df = spark.createDataFrame([("m", 3, 1, 1.0)], "id string, i long, j long, v double")
    with pytest.raises(Exception, match="outside the matrix"):
        M.coo_to_colmajor(df, 2, 3, ["id"]).collect()


def test_norm_adds_many_small_values_to_an_ordinary_one(spark):
    edge, tiny = 2.0**-511, 2.0**-512
    x = spark.range(1_000_000).select(F.col("id").alias("k"), F.when(F.col("id") == 0, edge).otherwise(tiny).alias("v"))
    want = tiny * math.sqrt(4 + 999_999)
    assert math.isclose(V.nrm2(x).first()["nrm2"], want, rel_tol=1e-12)


def test_shapes_are_checked(spark):
    longer = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "a array<double>")
    with pytest.raises(Exception, match="outside the triangle"):
        M.packed_to_coo(longer, "a", 2).collect()
    x = spark.createDataFrame([(0, 1.0), (30, 1.0)], "k long, v double")
    y = spark.createDataFrame([(0, 1.0), (300, 1.0)], "k long, v double")
    a = spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double")
    for late in (x, y):
        with pytest.raises(Exception, match="outside the vector"):
            M.ger(1.0, x, late, a, 25).collect()
    with pytest.raises(Exception, match="outside the vector"):
        M.syr(1.0, x, a, 25).collect()


def test_large_matrix_to_column_major(spark):
    a = spark.range(256 * 256).select((F.col("id") % 256 + 1).alias("i"), (F.floor(F.col("id") / 256) + 1).alias("j"), F.col("id").cast("double").alias("v"))
    a = a.filter("v % 3 = 0").withColumn("g", F.lit(1))
    arr = M.coo_to_colmajor(a, 256, 256, ["g"]).first()["arr"]
    assert arr == [float(i) if i % 3 == 0 else 0.0 for i in range(256 * 256)]


def test_flat_arrays_shuffle_no_zeros(spark):
    """Repeated entries add up, absent and null ones are zero, and zeros are no rows of an exchange."""
    cells = [("a", 1, 1, 2.0), ("a", 1, 1, 3.0), ("a", 3, 2, -0.0), ("a", 2, 1, None), ("b", 3, 2, 7.0), (None, 1, 2, 1.0)]
    a = spark.createDataFrame(cells, "g string, i long, j long, v double")
    flat = M.coo_to_colmajor(a, 3, 2, ["g"])
    got = {r["g"]: [str(v) for v in r["arr"]] for r in flat.collect()}
    zero = ["0.0"] * 6
    assert got == {"a": ["5.0", *zero[1:]], "b": [*zero[1:], "7.0"], None: [*zero[:3], "1.0", *zero[4:]]}
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate" not in plan


def test_keyed_products_in_given_tasks(spark, rows):
    """A task of a keyed product has at most so many rows of a factor, however large the tables are."""
    a = spark.createDataFrame([(g, i, j, 1.0 + i * j) for g in range(5) for i in range(4) for j in range(4)], "g long, i long, j long, v double")
    x = spark.createDataFrame([(g, k, 2.0 + k) for g in range(5) for k in range(4)], "g long, k long, v double")
    cases = spark.createDataFrame([(g, g - 1.0, g - 2.0, "tN"[g % 2], "N", "C"[: g + 1]) for g in range(5)], "g long, alpha double, beta double, trans string, ta string, tb string")
    assert rows(M.keyed_gemv(cases, a, x, x, ["g"], tasks=6)) == rows(M.keyed_gemv(cases, a, x, x, ["g"]))
    assert rows(M.keyed_gemm(cases.replace("", "N"), a, a, a, ["g"], tasks=6)) == rows(M.keyed_gemm(cases.replace("", "N"), a, a, a, ["g"]))
    assert M._dealt(a, M.tasks_for(100 * M.ROWS_PER_TASK), ["g", "j"]).rdd.getNumPartitions() == 101
