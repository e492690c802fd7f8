"""Tiled products, half products and triangular solves against dense arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecon.operators import blocks as B
from sparkrecon.operators import matrices as M
from sparkrecon.operators import solves as S
from tests.test_numeric import dense, dense_vec, mat, vec

RNG = np.random.default_rng(9)


def sparse(spark, a):
    """Only the nonzero entries."""
    return mat(spark, a).filter("v <> 0")


def holes(shape, share=0.3):
    return RNG.integers(-3, 4, shape) * (RNG.random(shape) < share)


def test_tiles_round_trip(spark, rows):
    a = holes((13, 9))
    full = sparse(spark, a).unionByName(sparse(spark, a))
    shifted = full.select((F.col("i") - 6).alias("i"), (F.col("j") - 20).alias("j"), "v")
    for side in (1, 4, 32):
        assert rows(B.entries(B.tiles(shifted, side), side)) == rows(M.coalesce_coo(shifted))
    assert B.tiles(full, 32).count() == 1


@pytest.mark.parametrize("ta, tb", [("N", "N"), ("T", "N"), ("N", "C"), ("T", "T")])
@pytest.mark.parametrize("split", [1, 3])
def test_tiled_gemm_equals_coordinates(spark, rows, ta, tb, split):
    """The same rows: sums of zero stay, places nothing adds to stay out."""
    a, b, c = holes((17, 17)), holes((17, 17)), holes((17, 17))
    args = (sparse(spark, a), sparse(spark, b), sparse(spark, c), 2.0, -1.0, ta, tb)
    assert rows(M.gemm(*args, tile=5, split=split)) == rows(M.gemm(*args))


def test_scalars_of_a_tiled_product(spark, rows):
    a, c = sparse(spark, holes((5, 5))), sparse(spark, holes((5, 5)))
    assert rows(M.gemm(a, a, c, 0.0, 2.0, tile=2)) == rows(M.gemm(a, a, c, 0.0, 2.0))
    assert M.gemm(a, a, c, 0.0, 0.0, tile=2).collect() == []
    assert M.gemm(a.limit(0), a, tile=2).collect() == []


def test_tiled_trmm_and_symm(spark):
    a, b, c = holes((11, 11), 0.8), holes((11, 11)), holes((11, 11))
    got = M.trmm(mat(spark, a), mat(spark, b), 2.0, "R", "U", "T", tile=4)
    assert np.allclose(dense(got, (11, 11)), 2 * b @ np.triu(a).T)
    got = M.symm(mat(spark, a), mat(spark, b), mat(spark, c), 1.0, 2.0, "L", "U", tile=4)
    full = np.triu(a) + np.triu(a, 1).T
    assert np.allclose(dense(got, (11, 11)), full @ b + 2 * c)


def test_a_task_passes_on_one_tile_per_place(spark):
    """600 inner indices: 21,600 scalar products become one partial tile per task."""
    a = spark.sql("SELECT id AS j, explode(sequence(0L, 5L)) AS i, 1.0D AS v FROM range(600)")
    t = B.tiles(a.select("i", "j", "v"), 8, 8).repartition(3)
    flipped = t.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "at", "v")
    turned = flipped.withColumn("at", F.transform("at", lambda p: (p % 8 * 8 + F.floor(p / 8)).cast("int")))
    parts = B.product(t, turned, 8, 8, 8)
    assert parts.count() <= parts.rdd.getNumPartitions()
    total = dense(B.entries(B.add_tiles(parts, 8), 8), (6, 6))
    assert (total == 600).all()


def test_sums_beyond_what_a_task_holds(spark, monkeypatch):
    a, b = holes((40, 40)), holes((40, 40))
    monkeypatch.setattr(B, "HELD_BYTES", 500)
    sums = B.Sums(2, 2)
    keys = RNG.integers(0, 4, (200, 2))
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    values = RNG.integers(1, 5, (200, 2, 2)).astype(float)
    found: dict = {}

    def take(batches):
        for batch in batches:
            for bi, bj, v in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                assert (bi, bj) not in found
                found[bi, bj] = v

    for i in range(0, 200, 7):
        if sums.full():
            take(B._flush_but(sums, tuple(keys[i].tolist())))
        sums.add(keys[i : i + 7], values[i : i + 7], np.ones_like(values[i : i + 7], dtype=np.float32))
    take(sums.flush())
    for k in {tuple(k) for k in keys.tolist()}:
        assert found[k] == values[(keys == k).all(axis=1)].sum(axis=0).reshape(-1).tolist()
    assert np.allclose(dense(M.gemm(sparse(spark, a), sparse(spark, b), tile=3), (40, 40)), a @ b)


@pytest.mark.parametrize("chunk", [1, 4, 256])
def test_half_of_the_pairs_is_formed(spark, chunk):
    sizes = {0: 1, 1: 2, 2: 9, 3: 30}
    rows = spark.createDataFrame([(k, i * 7, 1.0) for k, n in sizes.items() for i in range(n)], "k long, i long, x double")
    pairs = M.half_pairs(rows, chunk)
    assert pairs.count() == sum(n * (n + 1) // 2 for n in sizes.values())
    assert pairs.filter("p.i = q.i").count() == sum(sizes.values())


@pytest.mark.parametrize("chunk", [2, 256])
@pytest.mark.parametrize("trans, uplo", [("N", "U"), ("T", "L")])
def test_rank_updates_in_chunks(spark, chunk, trans, uplo):
    a, b, c = holes((9, 9), 0.7), holes((9, 9), 0.7), holes((9, 9))
    half = np.triu if uplo == "U" else np.tril
    oa, ob = (a, b) if trans == "N" else (a.T, b.T)
    got = M.syrk(sparse(spark, a), sparse(spark, c), 2.0, 0.5, trans, uplo, chunk)
    assert np.allclose(dense(got, (9, 9)), half(2 * oa @ oa.T + 0.5 * c))
    got = M.syr2k(sparse(spark, a), sparse(spark, b), sparse(spark, c), 2.0, 0.5, trans, uplo, chunk)
    assert np.allclose(dense(got, (9, 9)), half(2 * (oa @ ob.T + ob @ oa.T) + 0.5 * c))


def test_rank_updates_name_a_triangle(spark):
    a = mat(spark, holes((2, 2)))
    with pytest.raises(ValueError):
        M.syrk(a, uplo="X")


# --- solves -----------------------------------------------------------------------------


def heavy(n, share=1.0):
    a = RNG.integers(-3, 4, (n, n)) * (RNG.random((n, n)) < share)
    return a + np.diag(10 + np.abs(a).sum(axis=1))


@pytest.mark.parametrize("uplo, trans", [("L", "N"), ("L", "T"), ("U", "N"), ("U", "C")])
@pytest.mark.parametrize("unit", [False, True])
def test_trsv(spark, uplo, trans, unit):
    a, b = heavy(21) / 40, RNG.standard_normal(21)
    tri = np.tril(a) if uplo == "L" else np.triu(a)
    if unit:
        tri = tri - np.diag(np.diag(tri)) + np.eye(21)
    want = np.linalg.solve(tri if trans == "N" else tri.T, b)
    # the other triangle, and the diagonal when it counts as ones, are not read
    got = S.trsv(mat(spark, a), vec(spark, b), uplo, trans, unit, order=6)
    assert np.allclose(dense_vec(got, 21), want)
    assert got.count() == 21


@pytest.mark.parametrize("side, uplo, trans", [("L", "L", "N"), ("L", "U", "T"), ("R", "L", "T"), ("R", "U", "N"), ("R", "L", "N")])
def test_trsm(spark, side, uplo, trans):
    a, b = heavy(13, 0.6), RNG.standard_normal((13, 13)).round(2)
    tri = np.tril(a) if uplo == "L" else np.triu(a)
    op = tri if trans == "N" else tri.T
    want = np.linalg.solve(op, 2 * b) if side == "L" else np.linalg.solve(op.T, 2 * b.T).T
    got = S.trsm(mat(spark, a), mat(spark, b), 2.0, side, uplo, trans, order=5)
    assert np.allclose(dense(got, (13, 13)), want)


def test_tbsv_and_tpsv(spark):
    a, b = heavy(14), RNG.standard_normal(14)
    band = np.tril(np.triu(a, -2))
    assert np.allclose(dense_vec(S.tbsv(mat(spark, a), vec(spark, b), 2, "L", order=4), 14), np.linalg.solve(band, b))
    packed = M.coo_to_packed(mat(spark, np.triu(a)), 14, "U")
    got = S.tpsv(packed, vec(spark, b), 14, "U", "T", order=4)
    assert np.allclose(dense_vec(got, 14), np.linalg.solve(np.triu(a).T, b))


def rounds(spark, monkeypatch, a, b, order):
    seen = []
    settle = S._settle

    def counted(*args):
        seen.append(settle(*args))
        return seen[-1]

    monkeypatch.setattr(S, "_settle", counted)
    x = S.trsv(a, b, "L", order=order)
    return x, sum(1 for s in seen if s["settled"])


def test_rounds_follow_the_blocks(spark, monkeypatch):
    """A band takes one round per tile row; what needs no other tile row is solved in one round."""
    a, b = np.tril(np.triu(heavy(40), -1)), np.ones(40)
    x, n = rounds(spark, monkeypatch, sparse(spark, a), vec(spark, b), 10)
    assert n == 4 and np.allclose(dense_vec(x, 40), np.linalg.solve(a, b))


def test_apart_tile_rows_are_solved_together(spark, monkeypatch):
    a = np.kron(np.eye(4), np.tril(heavy(10)))
    a[25, 3] = 5
    x, n = rounds(spark, monkeypatch, sparse(spark, a), vec(spark, np.ones(40)), 10)
    assert n == 2 and np.allclose(dense_vec(x, 40), np.linalg.solve(a, np.ones(40)))


def test_sparse_right_hand_sides_and_odd_places(spark, rows):
    """Only what follows from the right-hand side is a row; indices may start anywhere."""
    a = spark.createDataFrame([(-3, -3, 2.0), (70, 70, 4.0), (70, -3, 1.0), (9, 9, 1.0), (200, 200, 5.0)], "i long, j long, v double")
    b = spark.createDataFrame([(-3, 6.0), (-3, 2.0)], "k long, v double")
    assert rows(S.trsv(a, b, "L", order=16)) == [(-3, 4.0), (70, -1.0)]
    assert S.trsv(a, b.limit(0), "L").collect() == []
    assert S.trsv(a.limit(0), b.limit(0), "L").collect() == []


@pytest.mark.parametrize("entry", [None, 0.0])
def test_singular_triangles(spark, entry):
    cells = [(0, 0, 1.0), (1, 0, 2.0), (2, 2, 1.0)] + ([(1, 1, entry)] if entry is not None else [])
    a = spark.createDataFrame(cells, "i long, j long, v double")
    with pytest.raises(Exception, match="singular"):
        S.trsv(a, vec(spark, [1, 1, 1]), "L").collect()
    assert dense_vec(S.trsv(a, vec(spark, [1, 1, 1]), "L", unit=True), 3).tolist() == [1, -1, 1]


def test_solve_flags(spark):
    a = mat(spark, np.eye(2))
    with pytest.raises(ValueError):
        S.trsm(a, a, side="X")
    with pytest.raises(ValueError):
        S.trsv(a, vec(spark, [1, 1]), trans="X")
    assert S.trsm(a, a, alpha=0.0).collect() == []


@pytest.mark.parametrize("uplo", ["L", "U"])
def test_rounds_do_not_grow_with_the_order(spark, monkeypatch, uplo):
    """40 tile rows in a chain take as many rounds as there are panels, in either direction."""
    monkeypatch.setattr(S, "PANELS", 3)
    a, b = np.triu(np.tril(heavy(80), 3), -3), RNG.standard_normal(80)
    a = np.tril(a) if uplo == "L" else np.triu(a)
    seen = []
    settle = S._settle
    monkeypatch.setattr(S, "_settle", lambda *args: seen.append(settle(*args)) or seen[-1])
    x = S.trsv(sparse(spark, a), vec(spark, b), uplo, order=2)
    assert sum(1 for s in seen if s["settled"]) == 3
    assert np.allclose(dense_vec(x, 80), np.linalg.solve(a, b))


@pytest.mark.parametrize("ta, tb", [("N", "T"), ("T", "N")])
def test_products_over_a_short_inner_index(spark, rows, monkeypatch, ta, tb):
    """The same rows as the coordinate form, and no part of the product in an exchange."""
    monkeypatch.setattr(B, "EDGE", 2)
    shape = (23, 5) if ta == "N" else (5, 23)
    a, b, c = holes(shape), holes(shape), holes((23, 23), 0.1)
    args = (sparse(spark, a), sparse(spark, b), sparse(spark, c), 2.0, -1.0, ta, tb)
    got = M.gemm(*args, tile=3, short=True)
    assert rows(got) == rows(M.gemm(*args))
    top = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in top and "Repartition" not in top[: top.index("MapInArrow")]
    assert rows(M.gemm(*args[:2], alpha=0.5, ta=ta, tb=tb, tile=3, short=True)) == rows(M.gemm(*args[:2], alpha=0.5, ta=ta, tb=tb))
    assert M.gemm(args[0].limit(0), *args[1:2], ta=ta, tb=tb, tile=3, short=True).collect() == []


def test_factors_of_a_short_product_are_stored_once(spark, rows, monkeypatch):
    """However many blocks the product has: each tile is stored once, one mark a group, and nothing is dealt out after that."""
    monkeypatch.setattr(B, "EDGE", 2)
    stored = []
    monkeypatch.setattr(B, "checkpoint", lambda df, keep=B.checkpoint: stored.append(keep(df)) or stored[-1])
    a, b, c = (sparse(spark, holes(shape, 0.9)) for shape in ((60, 5), (5, 60), (60, 60)))
    got = M.gemm(a, b, c, 2.0, -1.0, tile=3, short=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() >= B.TASKS
    groups = sum(t.rdd.getNumPartitions() for t in stored)
    assert sum(t.count() for t in stored) == sum(B.tiles(t, 3).count() for t in (a, b, c)) + groups
    assert rows(got) == rows(M.gemm(a, b, c, 2.0, -1.0))


@pytest.mark.parametrize("edge, rows_, tasks, bytes_", [(1, 1, 1, 1 << 26), (64, 128, 64, 500)])
def test_short_products_of_odd_places(spark, rows, monkeypatch, edge, rows_, tasks, bytes_):
    """Far apart and negative indices, inner indices on one side only, tiles of C where the product has none."""
    for name, value in (("EDGE", edge), ("ROWS", rows_), ("TASKS", tasks), ("HELD_BYTES", bytes_), ("SLICE_BYTES", 1000)):
        monkeypatch.setattr(B, name, value)
    a = spark.createDataFrame([(-70, 1, 2.0), (-70, 9, 1.0), (5, 1, 3.0), (10**12, 40, 4.0), (6, 9, -1.0), (6, 9, 3.0)], "i long, j long, v double")
    b = spark.createDataFrame([(1, -8, 5.0), (9, -8, -10.0), (9, 10**11, 1.0), (77, 3, 6.0), (2, 200, 1.0)], "i long, j long, v double")
    c = spark.createDataFrame([(-70, -8, 1.0), (5, 900, 2.0), (12345, -8, 3.0), (12345, 67890, 4.0), (5, 900, 1.0)], "i long, j long, v double")
    assert rows(M.gemm(a, b, c, 2.0, 3.0, tile=4, short=True)) == rows(M.gemm(a, b, c, 2.0, 3.0))
    assert rows(M.gemm(a, b.limit(0), c, 2.0, 3.0, tile=4, short=True)) == rows(M.gemm(a, b.limit(0), c, 2.0, 3.0))


def test_right_hand_sides_without_a_place(spark, rows):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 6.0), (None, 2.0)], "k long, v double")
    assert rows(S.trsv(a, b, "L")) == [(0, 3.0)]
