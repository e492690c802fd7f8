"""Whitening against numpy's eigensolver, exact sums in Python, and the solver on hard matrices."""

from __future__ import annotations

import numpy as np
import pytest

from sparkrecon.llm import qd_solver, whitening

KIND = "vec_id long, embedding array<float>, n string, component string, at int, m int"


def table(spark, vectors, ids=None):
    rows = [(i, v, "clash", "clash", None, 1) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def whole(vectors) -> list[list[int]]:
    return [[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]


def check(rows, vectors, ids, components):
    x = whole(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    assert len(rows) == n * components
    out = {(r["vec_id"], r["component"]): r for r in rows}
    for k in range(components):
        want = y @ w[:, k] / np.sqrt(e[k])
        got = np.array([out[i, k + 1]["whitened"] for i in ids])
        want *= np.sign(want @ got)
        assert np.abs(got - want).max() < 1e-7
        assert all(abs(out[i, k + 1]["explained"] * e.sum() / e[k] - 1) < 1e-9 for i in ids)
    for i, v in zip(ids, x):
        assert out[i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums))
    assert {r["n"] for r in rows} == {n}
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


@pytest.mark.parametrize("n, d", [(400, 40), (60, 8), (5, 3)])
def test_equals_an_eigensolver(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + 3).tolist()
    rows = whitening.whiten(table(spark, vectors)).collect()
    check(rows, vectors, range(n), min(32, d))


def test_unsound_vectors_go(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((50, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, 2.0, 3.0, float("inf")]]
    rows = whitening.whiten(table(spark, good + bad)).collect()
    check(rows, good, range(50), 4)


def test_repeated_rows_and_missing_ids(spark):
    vectors = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.5, 0.25]]
    rows = whitening.whiten(table(spark, vectors, [7, 7, None, 8])).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted(
        (i, c) for i in ("7", "7", "None", "8") for c in (1, 2)
    )


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.integers(-3, 4, (30, 2)) @ rng.integers(-2, 3, (2, 6))).astype(float).tolist()
    rows = whitening.whiten(table(spark, vectors)).collect()
    check(rows, vectors, range(30), 2)
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(table(spark, [None, []])).collect() == []


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="several lengths"):
        whitening.whiten(table(spark, [[1.0], [1.0, 2.0]]))


def test_deviations_beyond_a_long():
    x = np.array([[1_000_000], [4_000_000_000]])
    n = 10**10
    out = whitening.deviations(x, n, np.array([10**16])).to_pylist()
    assert out == [0, None]


def _hard():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 48))
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    steps = np.repeat([9.0, 4.0, 1.0, 0.25], 12)
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11)) + 12) + np.eye(21, k=1) + np.eye(21, k=-1)
    return {
        "random": np.linalg.qr(x, mode="r"),
        "graded": np.linalg.qr(x * 0.6 ** np.arange(48), mode="r"),
        "graded the other way": np.linalg.qr(x * 0.6 ** np.arange(48)[::-1], mode="r"),
        "identity": np.eye(7),
        "ties": np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]),
        "orthogonal": 2 * turn,
        "clusters": np.diag(steps) @ turn,
        "near clusters": np.diag(steps * (1 + 1e-9 * np.arange(48))) @ turn,
        "low rank": np.linalg.qr(x[:, :9] @ rng.standard_normal((9, 48)), mode="r"),
        "wilkinson": np.linalg.cholesky(wilkinson).T,
        "one": np.array([[2.0]]),
    }


@pytest.mark.parametrize("name", list(_hard()))
def test_solver(name):
    a = _hard()[name]
    values, vectors, total = qd_solver.right_singular(a, 32)
    s = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(values) == min(32, int((s > 1e-20 * s[0]).sum())) or name.startswith("graded")
    assert np.abs(values - s[: len(values)]).max() < 1e-13 * s[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() < 1e-12 * s[0]
    assert abs(total / s.sum() - 1) < 1e-13


def test_small_singular_values_are_accurate():
    """A graded bidiagonal matrix defines its tiny singular values to full relative accuracy."""
    main, upper = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(11.0)
    got = qd_solver.dqds(main, upper)
    from fractions import Fraction

    # the product of the squares is the squared determinant, exactly
    exact = Fraction(1)
    for b in main:
        exact *= Fraction(float(b)) ** 2
    made = Fraction(1)
    for v in got:
        made *= Fraction(float(v))
    assert abs(float(made / exact) - 1) < 1e-13
