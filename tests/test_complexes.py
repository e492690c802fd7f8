"""Complex operators and rotation set-up against numpy on small cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecon.functions.rotations import rotg
from sparkrecon.operators import complexes as C

RNG = np.random.default_rng(11)
N = 6


def values(*shape):
    return RNG.integers(-4, 5, shape) + 1j * RNG.integers(-4, 5, shape)


def vec(spark, x):
    return spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(x)], "k long, re double, im double")


def mat(spark, a):
    cells = [(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(cells, "i long, j long, re double, im double")


def dense(df, *shape):
    out = np.zeros(shape, dtype=complex)
    for *at, re, im in df.collect():
        out[tuple(at)] += complex(re, im)
    return out


def test_vectors(spark):
    x, y = values(N), values(N)
    X, Y = vec(spark, x), vec(spark, y)
    assert np.allclose(dense(C.zaxpy(2 - 3j, X, Y), N), y + (2 - 3j) * x)
    assert np.allclose(dense(C.zaxpy(0, X, Y), N), y)
    assert np.allclose(dense(C.zscal(1j, X), N), 1j * x)
    for got, want in ((C.zdotu(X, Y), (x * y).sum()), (C.zdotc(X, Y), np.vdot(x, y))):
        assert complex(*got.first()) == want
    assert C.izamax(X).first()["k"] == int(np.argmax(abs(x.real) + abs(x.imag)))
    assert tuple(C.zdotu(X.limit(0), Y).first()) == (0.0, 0.0) and C.izamax(X.limit(0)).first()["k"] is None


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_gemv_and_gemm(spark, hot_rows):
    ops = {"N": lambda a: a, "T": lambda a: a.T, "C": lambda a: a.conj().T}
    a, b, c, x, y = values(N, N), values(N, N), values(N, N), values(N), values(N)
    A, B, D, X, Y = mat(spark, a), mat(spark, b), mat(spark, c), vec(spark, x), vec(spark, y)
    for ta, f in ops.items():
        got = dense(C.zgemv(A, X, Y, 1 + 2j, -1j, ta, hot_rows), N)
        assert np.allclose(got, (1 + 2j) * f(a) @ x - 1j * y), ta
    for ta, tb in ("NC", "CN", "TT"):
        want = (2 - 1j) * ops[ta](a) @ ops[tb](b) + 1j * c
        assert np.allclose(dense(C.zgemm(A, B, D, 2 - 1j, 1j, ta, tb, hot_rows), N, N), want), (ta, tb)
    if hot_rows is None:
        assert np.allclose(dense(C.zgemm(A, B, ta="C", tile=4, split=2), N, N), a.conj().T @ b)
    with pytest.raises(ValueError):
        C.zgemv(A, X, trans="X")


def test_hermitian(spark):
    a, x, y = values(N, N), values(N), values(N)
    A, X, Y = mat(spark, a), vec(spark, x), vec(spark, y)
    assert np.allclose(dense(C.zgeru(1 + 1j, X, Y, A, N), N, N), a + (1 + 1j) * np.outer(x, y))
    assert np.allclose(dense(C.zgerc(1 + 1j, X, Y, A, N), N, N), a + (1 + 1j) * np.outer(x, y.conj()))
    real = a - 1j * np.diag(a.imag.diagonal())
    for uplo, half in (("U", np.triu), ("L", np.tril)):
        want = half(real + 2 * np.outer(x, x.conj()))
        assert np.allclose(dense(C.zher(2, X, A, N, uplo), N, N), want), uplo
        alpha = 1 - 2j
        want = half(real + alpha * np.outer(x, y.conj()) + alpha.conjugate() * np.outer(y, x.conj()))
        assert np.allclose(dense(C.zher2(alpha, X, Y, A, N, uplo), N, N), want), uplo
        strict = half(a, 1 if uplo == "U" else -1)
        whole = strict + strict.conj().T + np.diag(a.real.diagonal())
        assert np.allclose(dense(C.zhemv(A, X, 1j, uplo), N), 1j * whole @ x), uplo


def test_rotations(spark):
    pairs = [(3.0, 4.0), (4.0, -3.0), (-5.0, 1.0), (0.0, 2.0), (2.0, 0.0), (0.0, 0.0), (1e200, 1e200), (None, 1.0)]
    rows = spark.createDataFrame(pairs, "a double, b double").select("a", "b", rotg(F.col("a"), F.col("b")).alias("g")).collect()
    for r in rows:
        a, b, g = r["a"], r["b"], r["g"]
        if a is None:
            assert g["c"] is None and g["s"] is None
            continue
        scale = max(abs(a), abs(b), 1.0)
        assert abs(g["c"] * a / scale + g["s"] * b / scale - g["r"] / scale) < 1e-12
        assert abs(g["c"] * b / scale - g["s"] * a / scale) < 1e-12
    by = {(r["a"], r["b"]): r["g"] for r in rows}
    assert by[0.0, 2.0]["z"] == 1.0 and by[2.0, 0.0]["z"] == 0.0 and tuple(by[0.0, 0.0]) == (0.0, 0.0, 1.0, 0.0)
    assert by[3.0, 4.0]["r"] == 5.0 and abs(by[3.0, 4.0]["z"] - 5 / 3) < 1e-12 and by[-5.0, 1.0]["r"] < 0


def test_tiles_are_put_together_in_tasks(spark, rows):
    """Repeated coordinates, an odd side and a given number of tasks; an entry is one row until it is in its tile."""
    cells = [(i, j, float(i + 1), float(j - i)) for i in range(9) for j in range(0, 9, 2)]
    a = spark.createDataFrame(cells + cells[::3], "i long, j long, re double, im double")
    want = rows(C.zgemm(a, a, ta="C"))
    for tile, tasks in ((5, 1), (4, 7), (5, None)):
        got = rows(C.zgemm(a, a, ta="C", tile=tile, tasks=tasks))
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
