"""Complex vectors ``(k, re, im)`` and matrices ``(i, j, re, im)``; factors are Python complex numbers.

Absent means zero, repeated positions and coordinates stand for their sum, as in the real operators. The transpose flag
'C' conjugates, so it differs from 'T'. A product of two entries is one row with both parts, so a complex
operator shuffles as many rows as the real one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.operators import blocks
from sparkrecon.operators.matrices import TILE, _in_triangle
from sparkrecon.plans.joins import grid_join, skew_join

Pair = tuple[Column, Column]


def _pair(prefix: str = "") -> Pair:
    return F.col(f"{prefix}re"), F.col(f"{prefix}im")


def _times(x: Pair, y: Pair) -> Pair:
    return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]


def _constant(a: complex) -> Pair:
    a = complex(a)
    return F.lit(a.real), F.lit(a.imag)


def _conjugate(x: Pair) -> Pair:
    return x[0], -x[1]


def _named(x: Pair) -> list[Column]:
    return [x[0].alias("re"), x[1].alias("im")]


def _scaled(df: DataFrame, a: complex, keys: list[str]) -> DataFrame:
    return df.select(*keys, *_named(_pair() if a == 1 else _times(_constant(a), _pair())))


def _add(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


# --- vectors --------------------------------------------------------------------------


def zscal(a: complex, x: DataFrame) -> DataFrame:
    """a*x."""
    return x.select("k", *_named(_times(_constant(a), _pair())))


def zaxpy(a: complex, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + a*x, added per position in one shuffle."""
    if a == 0:
        return y.select("k", "re", "im")
    return _add([_scaled(x, a, ["k"]), y.select("k", "re", "im")], ["k"])


def _zdot(x: DataFrame, y: DataFrame, conjugate: bool) -> DataFrame:
    left = x.select("k", F.col("re").alias("x_re"), F.col("im").alias("x_im"))
    first = _conjugate(_pair("x_")) if conjugate else _pair("x_")
    re, im = _times(first, _pair())
    joined = left.join(y.select("k", "re", "im"), "k")
    return joined.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in ((re, "re"), (im, "im"))])


def zdotu(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of x*y."""
    return _zdot(x, y, False)


def zdotc(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of conj(x)*y."""
    return _zdot(x, y, True)


def izamax(x: DataFrame) -> DataFrame:
    """Position of the first value with the largest ``|re| + |im|``."""
    size = -(F.abs("re") + F.abs("im"))
    return x.agg(F.min(F.struct(size.alias("m"), F.col("k").alias("k")))["k"].alias("k"))


# --- products -------------------------------------------------------------------------


def op(a: DataFrame, trans: str) -> DataFrame:
    """op(A): 'N' as it is, 'T' transposed, 'C' transposed and conjugated."""
    flag = trans.upper()
    if flag == "N":
        return a.select("i", "j", "re", "im")
    if flag not in ("T", "C"):
        raise ValueError(f"bad transpose flag: {trans}")
    parts = _conjugate(_pair()) if flag == "C" else _pair()
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), *_named(parts))


def zgemv(
    a: DataFrame,
    x: DataFrame,
    y: DataFrame | None = None,
    alpha: complex = 1,
    beta: complex = 0,
    trans: str = "N",
    hot_rows: int | None = None,
) -> DataFrame:
    """alpha*op(A)*x + beta*y. ``y`` is not read when beta is zero; ``hot_rows`` salts columns with more rows."""
    parts = []
    if alpha != 0:
        rows = op(a, trans)
        vec = x.select(F.col("k").alias("j"), F.col("re").alias("x_re"), F.col("im").alias("x_im"))
        joined = rows.join(vec, "j") if hot_rows is None else skew_join(_add([rows], ["i", "j"]), vec, ["j"], "inner", hot_rows)
        product = joined.select(F.col("i").alias("k"), *_named(_times(_pair(), _pair("x_"))))
        parts.append(_scaled(product, alpha, ["k"]))
    if beta != 0 and y is not None:
        parts.append(_scaled(y, beta, ["k"]))
    if not parts:
        return x.select("k", "re", "im").limit(0)
    return _add(parts, ["k"])


def zhemv(a: DataFrame, x: DataFrame, alpha: complex = 1, uplo: str = "U") -> DataFrame:
    """alpha*A*x for a Hermitian matrix given by one triangle."""
    return zgemv(hermitian_view(a, uplo), x, alpha=alpha)


def hermitian_view(a: DataFrame, uplo: str) -> DataFrame:
    """The whole Hermitian matrix from one triangle; imaginary parts on the diagonal are not read."""
    half = a.select("i", "j", "re", "im").filter(_in_triangle(uplo.upper()))
    real = half.withColumn("im", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("im")))
    return real.unionByName(op(real.filter("i <> j"), "C"))


def zgemm(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame | None = None,
    alpha: complex = 1,
    beta: complex = 0,
    ta: str = "N",
    tb: str = "N",
    hot_rows: int | None = None,
    tile: int | None = None,
    split: int = 1,
    tasks: int | None = None,
) -> DataFrame:
    """alpha*op(A)*op(B) + beta*C. ``c`` is not read when beta is zero.

    Entries are joined on the inner index; ``hot_rows`` spreads inner indices with more rows over a grid. With ``tile`` the
    product is the real tiled one of twice the size: re and im are neighbouring rows of a factor with real entries. Its
    tiles are then put together in ``tasks`` tasks (``matrices.tasks_for``), or as many as Spark decides.
    """
    parts = []
    if alpha != 0:
        left, right = op(a, ta), op(b, tb)
        if tile is not None:
            product = _tiled(left, right, tile, split, tasks)
        else:
            if hot_rows is not None:
                left, right = _add([left], ["i", "j"]), _add([right], ["i", "j"])
            lefts = left.select(F.col("j").alias("k"), "i", F.col("re").alias("a_re"), F.col("im").alias("a_im"))
            rights = right.select(F.col("i").alias("k"), "j", "re", "im")
            if hot_rows is None:
                joined = lefts.join(rights, "k")
            else:
                joined = grid_join(lefts, rights, ["k"], ["i"], ["j"], hot_rows)
            product = joined.select("i", "j", *_named(_times(_pair("a_"), _pair())))
        parts.append(_scaled(product, alpha, ["i", "j"]))
    if beta != 0 and c is not None:
        parts.append(_scaled(c, beta, ["i", "j"]))
    if not parts:
        return a.select("i", "j", "re", "im").limit(0)
    return _add(parts, ["i", "j"])


def _tiled(a: DataFrame, b: DataFrame, tile: int, split: int, tasks: int | None) -> DataFrame:
    """A*B by one real product: [re -im; im re] per entry of A times [re; im] per entry of B.

    Entries are added up and brought to their tile as one row each, and only become real cells inside the tile's row; the
    side is even, so the cells of an entry are in one tile.
    """
    side = tile + tile % 2
    i, j, two = F.col("i"), F.col("j"), F.lit(2)

    def tiles(df: DataFrame, wide: Column, cells) -> DataFrame:
        placed = _add([df], ["i", "j"]).select(
            F.floor(two * i / side).cast("long").alias("bi"),
            F.floor(wide * j / side).cast("long").alias("bj"),
            (F.pmod(two * i, F.lit(side)) * side + F.pmod(wide * j, F.lit(side))).cast("int").alias("at"),
            *(F.col(c).cast("double") for c in ("re", "im")),
        )
        placed = placed if tasks is None else placed.repartition(tasks, "bi", "bj")
        held = placed.groupBy("bi", "bj").agg(F.collect_list(F.struct("at", "re", "im")).alias("es"))
        spread = lambda part: F.flatten(F.transform("es", lambda e: F.array(*[c[part] for c in cells(e)])))
        return held.select("bi", "bj", spread(0).alias("at"), spread(1).alias("v"))

    left = tiles(a, two, lambda e: [(e.at, e.re), (e.at + 1, -e.im), (e.at + side, e.im), (e.at + side + 1, e.re)])
    right = tiles(b, F.lit(1), lambda e: [(e.at, e.re), (e.at + side, e.im)])
    parts = blocks.product(left, right, side, side, side, 1.0, split)
    real = blocks.entries(blocks.add_tiles(parts, side), side)
    odd = F.pmod(i, F.lit(2)) == 1
    return real.select(
        F.floor(i / 2).cast("long").alias("i"),
        "j",
        F.when(odd, 0.0).otherwise(F.col("v")).alias("re"),
        F.when(odd, F.col("v")).otherwise(0.0).alias("im"),
    )


# --- rank updates ---------------------------------------------------------------------


def _chunks(x: DataFrame, name: str) -> DataFrame:
    single = _add([x.select("k", "re", "im")], ["k"])
    return single.groupBy(F.floor(F.col("k") / F.lit(TILE)).alias(f"b{name}")).agg(
        F.collect_list(F.struct("k", "re", "im")).alias(name)
    )


def _outer(x: DataFrame, y: DataFrame, alpha: complex, n: int, conjugate: bool, triangle: str | None = None) -> DataFrame:
    """alpha*x*y' or alpha*x*conj(y)' for column positions in [0, n): chunks meet by column tile."""
    last = F.lit((n - 1) // TILE).cast("long")
    if triangle == "L":
        first, last = F.lit(0).cast("long"), F.least(last, F.col("bx"))
    elif triangle == "U":
        first = F.col("bx")
    else:
        first = F.lit(0).cast("long")
    span = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    tiles = _chunks(x, "x").withColumn("by", F.explode(span)).join(_chunks(y, "y"), "by")
    cells = tiles.select(F.explode("x").alias("p"), "y").select("p", F.explode("y").alias("q"))
    right = (F.col("q.re"), F.col("q.im"))
    product = _times((F.col("p.re"), F.col("p.im")), _conjugate(right) if conjugate else right)
    out = cells.select(F.col("p.k").alias("i"), F.col("q.k").alias("j"), *_named(_times(_constant(alpha), product)))
    return out.filter(_in_triangle(triangle)) if triangle else out


def zgeru(alpha: complex, x: DataFrame, y: DataFrame, a: DataFrame, n: int) -> DataFrame:
    """A + alpha*x*y'. ``n`` is the number of columns; positions are 0-based."""
    parts = [_outer(x, y, alpha, n, False)] if alpha != 0 else []
    return _add([*parts, a.select("i", "j", "re", "im")], ["i", "j"])


def zgerc(alpha: complex, x: DataFrame, y: DataFrame, a: DataFrame, n: int) -> DataFrame:
    """A + alpha*x*conj(y)'."""
    parts = [_outer(x, y, alpha, n, True)] if alpha != 0 else []
    return _add([*parts, a.select("i", "j", "re", "im")], ["i", "j"])


def _hermitian(parts: list[DataFrame], a: DataFrame, flag: str) -> DataFrame:
    half = a.select("i", "j", "re", "im").filter(_in_triangle(flag))
    return _add([*parts, half], ["i", "j"]).withColumn(
        "im", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("im"))
    )


def zher(alpha: float, x: DataFrame, a: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """A + alpha*x*conj(x)' on one triangle, alpha real; the diagonal is real."""
    flag = uplo.upper()
    return _hermitian([_outer(x, x, alpha, n, True, flag)] if alpha != 0 else [], a, flag)


def zher2(alpha: complex, x: DataFrame, y: DataFrame, a: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """A + alpha*x*conj(y)' + conj(alpha)*y*conj(x)' on one triangle; the diagonal is real."""
    flag, alpha = uplo.upper(), complex(alpha)
    parts = [_outer(x, y, alpha, n, True, flag), _outer(y, x, alpha.conjugate(), n, True, flag)] if alpha != 0 else []
    return _hermitian(parts, a, flag)
