"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

1. Entries c become whole numbers ``floor(64 c) + 1000000``; one pass adds them up per dimension, exactly.
2. Each task reduces its centred rows to one triangular factor, block by block. Factors are merged in
   groups of ``FAN`` tasks, twice, so the driver gets one factor per ``FAN ** 2`` tasks.
3. The driver works on one matrix of dimension x dimension only: Householder reflections make it bidiagonal, dqds
   finds the singular values, twisted factorisations the directions (``qd_solver``).
4. A pass over the whitened rows measures how far their covariance is from the identity; then rows are written.

Rows whose vector is null or holds null or non-finite entries are dropped, empty vectors too. All others count, repeated
rows and rows without an id included. Vectors of several lengths are an error, and so are entries of 2^40 and more. Components
end at ``COMPONENTS``, at the dimension, or where the variance is zero to rounding (fewer rows than dimensions, equal rows): a
table with one distinct vector gives no rows, like an empty one. ``deviation`` is null where it does not fit a long.
Only ``vec_id`` and the vector are read, so further columns change nothing, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.qd_solver import right_singular
from sparkrecon.llm.words import column

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LIMIT = 2.0**40
BLOCK = 4_096
FAN = 64
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def grid(batch: pa.RecordBatch, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a sound vector, and their vectors as whole numbers."""
    array = column(batch, vector)
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = array.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    sound = lengths > 0
    sound[row[~np.isfinite(values)]] = False
    sizes = np.unique(lengths[sound])
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes.tolist()}")
    rows = np.flatnonzero(sound)
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    values = values[sound[row]].reshape(len(rows), -1)
    if np.abs(values).max() >= LIMIT:
        raise ValueError("entries of 2^40 and more do not fit the grid")
    return rows, np.floor(SCALE * values).astype(np.int64) + OFFSET


def totals(table: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number of sound vectors and their sums per dimension."""

    def add(batches):
        sums, n = None, 0
        for batch in batches:
            _, x = grid(batch, vector)
            if len(x):
                part = x.sum(axis=0)
                if sums is not None and len(part) != len(sums):
                    raise ValueError(f"vectors of several lengths: {sorted({len(part), len(sums)})}")
                sums, n = part if sums is None else sums + part, n + len(x)
        if sums is not None:
            d = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([d] * d), pa.array(range(d)), pa.array(sums), pa.array([n] * d)], ["d", "at", "s", "n"])

    parts = table.select(vector).mapInArrow(add, "d long, at long, s long, n long")
    rows = parts.groupBy("d", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # one row per dimension
    if len({r["d"] for r in rows}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted({r['d'] for r in rows})}")
    if not rows:
        return 0, np.zeros(0, np.int64)
    return rows[0]["n"], np.array([r["s"] for r in sorted(rows, key=lambda r: r["at"])], np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the whole part of the mean is taken off before anything is rounded."""
    whole = sums // n
    return (x - whole).astype(np.float64) - (sums - whole * n) / n


def _merged(parts: DataFrame, merge, levels: int = 2) -> list[np.ndarray]:
    """Matrices of all tasks (at, m), merged in groups of ``FAN`` and brought to the driver."""

    def run(table):
        order = np.argsort(np.array(table.column("at").to_pylist()), kind="stable")
        blobs = table.column("m").to_pylist()
        total = merge([_matrix(blobs[i]) for i in order])
        return pa.table({"at": pa.array([table.column("at")[0].as_py() // FAN], pa.int64()), "m": pa.array([_blob(total)], pa.binary())})

    for _ in range(levels):
        parts = parts.groupBy((F.col("at") / FAN).cast("long").alias("of")).applyInArrow(run, "at long, m binary")
    return [_matrix(r["m"]) for r in sorted(parts.collect(), key=lambda r: r["at"])]


def _blob(m: np.ndarray) -> bytes:
    return np.array(m.shape, "<i8").tobytes() + np.ascontiguousarray(m, "<f8").tobytes()


def _matrix(blob: bytes) -> np.ndarray:
    shape = np.frombuffer(blob, "<i8", 2)
    return np.frombuffer(blob, "<f8", offset=16).reshape(shape)


def _stacked(matrices: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of all rows."""
    total = matrices[0]
    for m in matrices[1:]:
        total = np.linalg.qr(np.vstack([total, m]), mode="r")
    return total


def triangular_factor(table: DataFrame, vector: str, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""

    def reduce(batches):
        factor = np.zeros((0, len(sums)))
        for batch in batches:
            _, x = grid(batch, vector)
            for i in range(0, len(x), BLOCK):
                factor = np.linalg.qr(np.vstack([factor, centred(x[i : i + BLOCK], n, sums)]), mode="r")
        if len(factor):
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_blob(factor)], pa.binary())], ["at", "m"])

    factors = _merged(table.select(vector).mapInArrow(reduce, "at long, m binary"), _stacked)
    whole = _stacked(factors)
    return np.linalg.qr(np.vstack([whole, np.zeros((len(sums), len(sums)))]), mode="r")


def identity_error(table: DataFrame, vector: str, n: int, sums: np.ndarray, project: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    k = project.shape[1]

    def reduce(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, x = grid(batch, vector)
            if len(x):
                w = centred(x, n, sums) @ project
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_blob(total)], pa.binary())], ["at", "m"])

    parts = _merged(table.select(vector).mapInArrow(reduce, "at long, m binary"), lambda ms: np.sum(ms, axis=0))
    total = np.sum(parts, axis=0) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sum over dimensions of (n x - sums)^2; null where it does not fit a long."""
    size = np.abs(x.astype(np.float64) * n - sums).max(initial=0.0)
    # the products themselves must fit too, also before the sums are taken off
    if size * size * x.shape[1] < 2.0**62 and float(np.abs(x).max(initial=0)) * n < 2.0**62:
        apart = n * x - sums
        return pa.array((apart * apart).sum(axis=1), pa.int64())
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per sound vector and component; see the module's head."""
    n, sums = totals(table, vector)
    if not n:
        return table.sparkSession.createDataFrame([], SCHEMA)
    values, vectors, trace = right_singular(triangular_factor(table, vector, n, sums), components)
    variances, k = values / n, len(values)
    if not k:
        return table.sparkSession.createDataFrame([], SCHEMA)
    project = vectors / np.sqrt(variances)
    error = identity_error(table, vector, n, sums, project)
    shares = values / trace

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(i, BLOCK)
                rows, x = grid(piece, vector)
                if not len(rows):
                    continue
                ids = column(piece, "vec_id").cast(pa.int64()).take(pa.array(np.repeat(rows, k)))
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * k, n, np.int64)),
                        deviations(x, n, sums).take(each),
                        pa.array((centred(x, n, sums) @ project).reshape(-1)),
                        pa.array(np.tile(shares, len(rows))),
                        pa.array(np.full(len(rows) * k, error)),
                    ],
                    [f.strip().split(" ")[0] for f in SCHEMA.split(",")],
                )

    return table.select("vec_id", vector).mapInArrow(run, SCHEMA)
