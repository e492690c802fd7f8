"""Vector operators. A vector is a table ``(k, v)``: position and value, absent means zero.

Complex vectors are ``(k, re, im)``. The ``grouped_`` forms take a leading group column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and scales of the three-accumulator norm (Blue 1978) for IEEE
# double precision.
NORM_SMALL_BELOW = 2.0**-511
NORM_LARGE_ABOVE = 2.0**486
NORM_SMALL_SCALE = 2.0**537
NORM_LARGE_SCALE = 2.0**-538


def vector(df: DataFrame, k: str | Column, v: str | Column) -> DataFrame:
    """Project any table to vector form, adding up repeated positions."""
    return (
        df.select(_col(k).alias("k"), _col(v).cast("double").alias("v"))
        .groupBy("k")
        .agg(F.sum("v").alias("v"))
    )


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scaled(x: DataFrame, factor: float) -> DataFrame:
    return x.select("k", (F.lit(float(factor)) * F.col("v")).alias("v"))


# --- reductions -----------------------------------------------------------------------


def asum(x: DataFrame) -> DataFrame:
    """Sum of absolute values."""
    return x.agg(_asum().alias("asum"))


def _asum() -> Column:
    return F.coalesce(F.sum(F.abs("v")), F.lit(0.0))


def zasum(x: DataFrame) -> DataFrame:
    """Sum of absolute real and imaginary parts."""
    return x.agg(F.coalesce(F.sum(F.abs("re") + F.abs("im")), F.lit(0.0)).alias("zasum"))


def norm_of(*values: Column) -> Column:
    """Aggregate expression: Euclidean norm over columns, safe from overflow and underflow.

    One pass with three accumulators for large, ordinary and small magnitudes, so partial
    sums combine before any shuffle and no global maximum is needed first.
    """

    def total(pick, scale: float) -> Column:
        terms = [F.when(pick(F.abs(c)), (c * scale) * (c * scale)).otherwise(0.0) for c in values]
        return F.coalesce(F.sum(reduce(lambda a, b: a + b, terms)), F.lit(0.0))

    large = total(lambda m: m > NORM_LARGE_ABOVE, NORM_LARGE_SCALE)
    small = total(lambda m: m < NORM_SMALL_BELOW, NORM_SMALL_SCALE)
    middle = total(
        lambda m: (m >= NORM_SMALL_BELOW) & (m <= NORM_LARGE_ABOVE),
        1.0,
    )
    with_large = F.sqrt(large + middle * NORM_LARGE_SCALE * NORM_LARGE_SCALE) / NORM_LARGE_SCALE
    # ordinary and small parts may matter together: combine them by the larger one
    ordinary, tiny = F.sqrt(middle), F.sqrt(small) / NORM_SMALL_SCALE
    more, less = F.greatest(ordinary, tiny), F.least(ordinary, tiny)
    return (
        F.when(large > 0, with_large)
        .when((middle > 0) & (small > 0), more * F.sqrt(1.0 + (less / more) * (less / more)))
        .when(middle > 0, ordinary)
        .otherwise(tiny)
    )


def nrm2(x: DataFrame) -> DataFrame:
    """Euclidean norm."""
    return x.agg(norm_of(F.col("v")).alias("nrm2"))


def znrm2(x: DataFrame) -> DataFrame:
    """Euclidean norm of a complex vector."""
    return x.agg(norm_of(F.col("re"), F.col("im")).alias("znrm2"))


def iamax(x: DataFrame) -> DataFrame:
    """Position of the first value with the largest magnitude."""
    return x.agg(_iamax().alias("k"))


def _iamax() -> Column:
    return F.min(F.struct((-F.abs("v")).alias("m"), F.col("k").alias("k")))["k"]


def _paired(x: DataFrame, y: DataFrame, keys: list[str], kind: str = "inner") -> DataFrame:
    left = x.select(*keys, F.col("v").alias("x"))
    right = y.select(*keys, F.col("v").alias("y"))
    return left.join(right, keys, kind)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Inner product. Positions missing on either side contribute nothing."""
    return _paired(x, y, ["k"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def dsdot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Inner product of single-precision inputs, multiplied and added in double precision."""

    def widened(c: str) -> Column:
        return F.col(c).cast("float").cast("double")

    return _paired(x, y, ["k"]).agg(
        F.coalesce(F.sum(widened("x") * widened("y")), F.lit(0.0)).alias("dsdot")
    )


# --- element-wise ---------------------------------------------------------------------


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + a*x. Both sides are stacked and added per position: one shuffle, no outer join."""
    if a == 0:
        return y.select("k", "v")
    return (
        _scaled(x, a).unionByName(y.select("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    )


def copy(x: DataFrame) -> DataFrame:
    return x.select("k", "v")


def swap(x: DataFrame, y: DataFrame) -> DataFrame:
    """Both vectors side by side after the exchange, as ``(k, x, y)``."""
    both = stacked_pair(x, y)
    return both.select("k", F.col("y").alias("x"), F.col("x").alias("y"))


def stacked_pair(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(k, x, y)`` over the union of positions, zero where a side has none."""
    left = x.select("k", F.col("v").alias("x"), F.lit(0.0).alias("y"))
    right = y.select("k", F.lit(0.0).alias("x"), F.col("v").alias("y"))
    return left.unionByName(right).groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def rot(x: DataFrame, y: DataFrame, c: float, s: float) -> DataFrame:
    """Plane rotation: (c*x + s*y, c*y - s*x)."""
    return stacked_pair(x, y).select(
        "k",
        (F.lit(c) * F.col("x") + F.lit(s) * F.col("y")).alias("x"),
        (F.lit(c) * F.col("y") - F.lit(s) * F.col("x")).alias("y"),
    )


def rotm(x: DataFrame, y: DataFrame, flag: int, h: tuple[float, float, float, float]) -> DataFrame:
    """Modified rotation. ``h`` is (h11, h21, h12, h22); ``flag`` says which entries it uses."""
    h11, h21, h12, h22 = h
    matrix = {
        -2: (1.0, 0.0, 0.0, 1.0),
        -1: (h11, h21, h12, h22),
        0: (1.0, h21, h12, 1.0),
        1: (h11, -1.0, 1.0, h22),
    }[int(flag)]
    a, b, c, d = (F.lit(float(e)) for e in matrix)
    return stacked_pair(x, y).select(
        "k",
        (a * F.col("x") + c * F.col("y")).alias("x"),
        (b * F.col("x") + d * F.col("y")).alias("y"),
    )


def scal(a: float, x: DataFrame) -> DataFrame:
    return _scaled(x, a)


def stride(x: DataFrame, inc: int, n: int) -> DataFrame:
    """Every ``inc``-th element from position 0, ``n`` of them, renumbered 0..n-1.

    A negative step walks the same elements backwards.
    """
    if inc == 0:
        raise ValueError("a step of zero is not allowed")
    step = abs(inc)
    index = (F.col("k") / F.lit(step)).cast("long")
    position = index if inc > 0 else F.lit(n - 1) - index
    return x.filter((F.col("k") >= 0) & (F.col("k") % step == 0) & (F.col("k") < n * step)).select(
        position.alias("k"), "v"
    )


# --- per group ------------------------------------------------------------------------


def grouped_asum(x: DataFrame, g: str) -> DataFrame:
    return x.groupBy(g).agg(_asum().alias("asum"))


def grouped_nrm2(x: DataFrame, g: str) -> DataFrame:
    return x.groupBy(g).agg(norm_of(F.col("v")).alias("nrm2"))


def grouped_iamax(x: DataFrame, g: str) -> DataFrame:
    return x.groupBy(g).agg(_iamax().alias("k"))


def grouped_dot(x: DataFrame, y: DataFrame, g: str) -> DataFrame:
    """Inner product per group; ``x`` and ``y`` are ``(g, k, v)``."""
    return (
        _paired(x, y, [g, "k"]).groupBy(g).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    )
