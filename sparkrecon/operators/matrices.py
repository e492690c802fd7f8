"""Matrix operators. A matrix is a table ``(i, j, v)``, absent means zero.

Repeated coordinates stand for their sum. Indices may start anywhere; the functions that
need a shape take it as an argument. Vectors are ``(k, v)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions.text import bound
from sparkrecon.operators import blocks
from sparkrecon.operators.vectors import _col
from sparkrecon.plans.joins import grid_join, skew_join

TILE = 256
ROWS_PER_TASK = 500_000


def matrix(df: DataFrame, i: str | Column, j: str | Column, v: str | Column) -> DataFrame:
    """Project any table to coordinate form, adding up repeated coordinates."""
    return coalesce_coo(df.select(_col(i).alias("i"), _col(j).alias("j"), _col(v).cast("double").alias("v")))


def coalesce_coo(a: DataFrame) -> DataFrame:
    """One row per coordinate."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def op(a: DataFrame, trans: str) -> DataFrame:
    """op(A) for a transpose flag; 'C' equals 'T' on real data."""
    flag = trans.upper()
    if flag == "N":
        return a.select("i", "j", "v")
    if flag in ("T", "C"):
        return transpose(a)
    raise ValueError(f"bad transpose flag: {trans}")


def _scaled(a: DataFrame, factor: float) -> DataFrame:
    if factor == 1:
        return a
    return a.withColumn("v", F.lit(float(factor)) * F.col("v"))


def _add(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of several tables of contributions in a single aggregation."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(F.sum("v").alias("v"))


# --- products -------------------------------------------------------------------------


def gemv(
    a: DataFrame,
    x: DataFrame,
    y: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    trans: str = "N",
    hot_rows: int | None = None,
) -> DataFrame:
    """alpha*op(A)*x + beta*y as ``(k, v)``. ``y`` is not read when beta is zero.

    Spark broadcasts the vector when its size, estimated or measured while running, allows it, and
    splits hot columns. ``hot_rows`` salts columns with more rows by hand, with A's repeated
    coordinates added first.
    """
    parts = []
    if alpha != 0:
        rows = op(a, trans)
        vec = x.select(F.col("k").alias("j"), F.col("v").alias("w"))
        if hot_rows is None:
            joined = rows.join(vec, "j")
        else:
            joined = skew_join(coalesce_coo(rows), vec, ["j"], "inner", hot_rows)
        parts.append(
            joined.select(F.col("i").alias("k"), (F.lit(float(alpha)) * F.col("v") * F.col("w")).alias("v"))
        )
    if beta != 0 and y is not None:
        parts.append(_scaled(y.select("k", "v"), beta))
    if not parts:
        return x.select("k", "v").limit(0)
    return _add(parts, ["k"])


def gemm(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    ta: str = "N",
    tb: str = "N",
    hot_rows: int | None = None,
    tile: int | None = None,
    split: int = 1,
    short: bool = False,
) -> DataFrame:
    """alpha*op(A)*op(B) + beta*C. ``c`` is not read when beta is zero.

    Without ``tile`` entries are joined: right for very sparse factors. With it the factors are cut into tiles of that
    side, which are joined, multiplied by numpy and added up per task (``blocks``): right when an inner index has
    many entries on both sides. ``split`` deals an inner tile that many tiles share over as many tasks; ``short`` is for an
    inner index of few tiles and a large product, which is then added up where it stays and not shuffled.
    """
    if tile is not None:
        return blocks.gemm(op(a, ta), op(b, tb), c, alpha, beta, tile, split, short)
    parts = []
    if alpha != 0:
        parts.append(_scaled(_products(op(a, ta), op(b, tb), hot_rows), alpha))
    if beta != 0 and c is not None:
        parts.append(_scaled(c.select("i", "j", "v"), beta))
    if not parts:
        return a.select("i", "j", "v").limit(0)
    return _add(parts, ["i", "j"])


def keyed_gemv(
    cases: DataFrame, a: DataFrame, x: DataFrame, y: DataFrame, keys: list[str], tasks: int | None = None
) -> DataFrame:
    """alpha*op(A)*x + beta*y for many cases in one plan, as ``(keys, k, v)``.

    ``cases`` has one row per case: keys, alpha, beta, trans. The others are tables of matrices and
    vectors with the same keys. A case with alpha zero does not read A, with beta zero not y. ``tasks`` deals the factors over
    so many tasks (:func:`tasks_for`): adaptive execution merges by bytes shuffled, and a task sorts and adds up many times those.
    """
    scale = cases.filter("alpha <> 0").select(*keys, "alpha", "trans")
    rows = a.join(scale, keys).select(
        *keys, *_flagged("trans", "k", "j"), (F.col("alpha") * F.col("v")).alias("v")
    )
    vec = x.select(*keys, F.col("k").alias("j"), F.col("v").alias("w"))
    on = [*keys, "j"]
    products = _dealt(rows, tasks, on).join(_dealt(vec, tasks, on), on)
    kept = y.join(cases.filter("beta <> 0").select(*keys, "beta"), keys)
    parts = [
        products.select(*keys, "k", (F.col("v") * F.col("w")).alias("v")),
        kept.select(*keys, "k", (F.col("beta") * F.col("v")).alias("v")),
    ]
    return _add(parts, [*keys, "k"])


def keyed_gemm(
    cases: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, keys: list[str], tasks: int | None = None
) -> DataFrame:
    """alpha*op(A)*op(B) + beta*C for many cases in one plan, as ``(keys, i, j, v)``.

    ``cases`` has one row per case: keys, alpha, beta, ta, tb; see :func:`keyed_gemv`, also for ``tasks``.
    """
    scale = cases.filter("alpha <> 0")
    lefts = a.join(scale.select(*keys, "alpha", "ta"), keys).select(
        *keys, *_flagged("ta", "i", "k"), (F.col("alpha") * F.col("v")).alias("va")
    )
    rights = b.join(scale.select(*keys, "tb"), keys).select(*keys, *_flagged("tb", "k", "j"), F.col("v").alias("vb"))
    on = [*keys, "k"]
    met = _dealt(lefts, tasks, on).join(_dealt(rights, tasks, on), on)
    kept = c.join(cases.filter("beta <> 0").select(*keys, "beta"), keys)
    parts = [
        met.select(*keys, "i", "j", (F.col("va") * F.col("vb")).alias("v")),
        kept.select(*keys, "i", "j", (F.col("beta") * F.col("v")).alias("v")),
    ]
    return _add(parts, [*keys, "i", "j"])


def tasks_for(rows: int) -> int:
    """Tasks for a factor of ``rows`` entries, ``ROWS_PER_TASK`` each."""
    return 1 + rows // ROWS_PER_TASK


def _dealt(df: DataFrame, tasks: int | None, on: list[str]) -> DataFrame:
    return df if tasks is None else df.repartition(tasks, *on)


def _flagged(flag: str, row: str, col: str) -> list[Column]:
    """Row and column index of op(A), where the flag is a column: N, T or C in either case."""
    plain = F.upper(flag) == "N"
    return [
        F.when(plain, F.col("i")).otherwise(F.col("j")).alias(row),
        F.when(plain, F.col("j")).otherwise(F.col("i")).alias(col),
    ]


def _products(a: DataFrame, b: DataFrame, hot_rows: int | None) -> DataFrame:
    """Partial products A(i,k)*B(k,j), not yet added up.

    Spark broadcasts a factor when its size, estimated or measured while running, allows it,
    and splits hot inner indices. With ``hot_rows`` repeated coordinates are added before the
    join, and an inner index with more rows on either side is spread over a grid of tasks.
    """
    if hot_rows is None:
        joined = _left_factor(a).join(_right_factor(b), "k")
    else:
        lefts, rights = _left_factor(coalesce_coo(a)), _right_factor(coalesce_coo(b))
        joined = grid_join(lefts, rights, ["k"], ["i"], ["j"], hot_rows)
    return joined.select("i", "j", (F.col("va") * F.col("vb")).alias("v"))


def _left_factor(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("k"), "i", F.col("v").alias("va"))


def _right_factor(b: DataFrame) -> DataFrame:
    return b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))


def _in_triangle(uplo: str) -> Column:
    flag = uplo.upper()
    if flag == "L":
        return F.col("i") >= F.col("j")
    if flag == "U":
        return F.col("i") <= F.col("j")
    raise ValueError(f"bad triangle flag: {uplo}")


CHUNK = 256


def syrk(
    a: DataFrame,
    c: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    trans: str = "N",
    uplo: str = "U",
    chunk: int = CHUNK,
) -> DataFrame:
    """One triangle of alpha*op(A)*op(A)' + beta*C. The other half is never formed.

    An inner index with n entries gives n(n+1)/2 products (:func:`_half_products`).
    """
    parts = []
    if alpha != 0:
        rows = coalesce_coo(op(a, trans)).select(F.col("j").alias("k"), "i", F.col("v").alias("x"))
        parts.append(_half_products(rows, lambda p, q: p["x"] * q["x"], alpha, uplo, chunk))
    if beta != 0 and c is not None:
        parts.append(_scaled(tri_view(c, uplo), beta))
    if not parts:
        return a.select("i", "j", "v").limit(0)
    return _add(parts, ["i", "j"])


def syr2k(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    trans: str = "N",
    uplo: str = "U",
    chunk: int = CHUNK,
) -> DataFrame:
    """One triangle of alpha*(op(A)*op(B)' + op(B)*op(A)') + beta*C.

    Both factors stand side by side per row and inner index, so both products come from one pass over the pairs. A
    pair with nothing in one factor on either side gives no entry.
    """
    parts = []
    if alpha != 0:
        none = F.lit(None).cast("double")
        sides = op(a, trans).withColumn("y", none).withColumnRenamed("v", "x")
        sides = sides.unionByName(op(b, trans).withColumn("x", none).withColumnRenamed("v", "y"))
        rows = sides.groupBy(F.col("j").alias("k"), "i").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        crossed = lambda p, q: _either(p["x"] * q["y"], p["y"] * q["x"])
        parts.append(_half_products(rows, crossed, alpha, uplo, chunk))
    if beta != 0 and c is not None:
        parts.append(_scaled(tri_view(c, uplo), beta))
    if not parts:
        return a.select("i", "j", "v").limit(0)
    return _add(parts, ["i", "j"])


def _either(one: Column, two: Column) -> Column:
    """The sum of what is there; null when neither is."""
    return F.coalesce(one + two, one, two)


def half_pairs(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Unordered pairs p, q of the rows of each inner index ``k``, a row with itself included, as structs.

    An inner index with more than ``chunk`` rows is dealt into chunks by a hash of i. Chunk pairs (c <= d) meet in
    rows of their own (key k, d), so a hot index is spread over many tasks, and inside such a row a chunk
    with itself only pairs an entry with those from its own position on: n(n+1)/2 pairs, not n * n.
    """
    dealt = F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks")
    hot = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select("k", dealt)
    chunks = F.coalesce("chunks", F.lit(1))
    placed = rows.join(hot, "k", "left").withColumn("chunks", chunks)
    placed = placed.withColumn("c", F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int"))
    entry = F.struct(*[F.col(n) for n in rows.columns if n != "k"])
    # dealt anew, as all rows of a hot index lie together after the join
    cut = placed.repartition("k", "c").groupBy("k", "c").agg(F.first("chunks").alias("chunks"), F.collect_list(entry).alias("es"))
    left = cut.select("k", "c", F.col("es").alias("ps"), F.explode(F.sequence("c", F.col("chunks") - 1)).alias("d"))
    met = left.join(cut.select("k", F.col("c").alias("d"), F.col("es").alias("qs")), ["k", "d"])
    each = met.select("c", "d", "qs", F.posexplode("ps").alias("at", "p"))
    rest = F.when(F.col("c") == F.col("d"), F.slice("qs", F.col("at") + 1, F.size("qs"))).otherwise(F.col("qs"))
    return each.select("p", F.explode(rest).alias("q"))


def _half_products(rows: DataFrame, times, alpha: float, uplo: str, chunk: int) -> DataFrame:
    """alpha times ``times`` of each unordered pair of entries of an inner index, in one triangle."""
    flag = uplo.upper()
    if flag not in ("L", "U"):
        raise ValueError(f"bad triangle flag: {uplo}")
    low, high = F.least("p.i", "q.i"), F.greatest("p.i", "q.i")
    value = F.lit(float(alpha)) * times(F.col("p"), F.col("q"))
    pairs = half_pairs(rows, chunk).select(
        (high if flag == "L" else low).alias("i"), (low if flag == "L" else high).alias("j"), value.alias("v")
    )
    return pairs.filter("v is not null")


def gram(df: DataFrame, arr: str, width: int, alpha: float = 1.0, uplo: str = "U") -> DataFrame:
    """One triangle of alpha*X'X where each row of X is an array of ``width`` numbers.

    Every task keeps one width-by-width sum over its rows and emits it once, so the shuffle
    carries ``width**2`` numbers per task and nothing per row. Entries are 0-based.
    """
    import numpy as np
    import pyarrow as pa

    upper = uplo.upper() == "U"

    def partial(batches):
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            column = batch.column(0)
            if column.null_count or not np.all(column.value_lengths().to_numpy() == width):
                raise ValueError(f"every row needs {width} numbers")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
            rows = flat.reshape(-1, width)
            total += rows.T @ rows
            seen = seen or len(rows) > 0
        if seen:
            i, j = np.triu_indices(width) if upper else np.tril_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                names=["i", "j", "v"],
            )

    sums = (
        df.select(arr)
        .mapInArrow(partial, "i int, j int, v double")
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
    )
    return _scaled(sums, alpha)


# --- outer products -------------------------------------------------------------------


def _chunks(x: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """Vector as rows of at most TILE entries: ``(b<name>, <name>)``; a position outside [0, n) is an error."""
    single = x.groupBy("k").agg(F.sum("v").alias("v"))
    if n is not None:
        outside = F.raise_error("position outside the vector").cast("double")
        single = single.withColumn("v", F.when(F.col("k").between(0, n - 1), F.col("v")).otherwise(outside))
    return single.groupBy(F.floor(F.col("k") / F.lit(TILE)).alias(f"b{name}")).agg(
        F.collect_list(F.struct("k", "v")).alias(name)
    )


def _outer(x: DataFrame, y: DataFrame, alpha: float, n: int, triangle: str | None = None) -> DataFrame:
    """alpha*x*y' for column positions in [0, n), tile by tile.

    Each chunk of ``x`` names the column tiles it meets and joins the chunks of ``y`` on the
    tile number; a tile multiplies two short arrays inside one row.
    """
    last = F.lit((n - 1) // TILE)
    first = F.lit(0)
    if triangle == "L":
        last = F.least(last, F.col("bx"))
    elif triangle == "U":
        first = F.least(F.col("bx"), last + 1)
    span = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    xs = _chunks(x, "x", n if triangle else None).withColumn("by", F.explode(span))
    ys = _chunks(y, "y", n)
    tiles = xs.join(ys, "by")
    cells = tiles.select(F.explode("x").alias("p"), "y").select("p", F.explode("y").alias("q"))
    out = cells.select(
        F.col("p.k").alias("i"),
        F.col("q.k").alias("j"),
        (F.lit(float(alpha)) * F.col("p.v") * F.col("q.v")).alias("v"),
    )
    return out.filter(_in_triangle(triangle)) if triangle else out


def ger(alpha: float, x: DataFrame, y: DataFrame, a: DataFrame, n: int) -> DataFrame:
    """A + alpha*x*y'. ``n`` is the number of columns; positions are 0-based."""
    if alpha == 0:
        return coalesce_coo(a)
    return _add([_outer(x, y, alpha, n), a.select("i", "j", "v")], ["i", "j"])


def syr(alpha: float, x: DataFrame, a: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """A + alpha*x*x' on one triangle."""
    flag = uplo.upper()
    if alpha == 0:
        return coalesce_coo(tri_view(a, flag))
    return _add([_outer(x, x, alpha, n, flag), tri_view(a, flag)], ["i", "j"])


def syr2(alpha: float, x: DataFrame, y: DataFrame, a: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """A + alpha*(x*y' + y*x') on one triangle."""
    flag = uplo.upper()
    if alpha == 0:
        return coalesce_coo(tri_view(a, flag))
    return _add(
        [_outer(x, y, alpha, n, flag), _outer(y, x, alpha, n, flag), tri_view(a, flag)], ["i", "j"]
    )


def spr(alpha: float, x: DataFrame, packed: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """``syr`` on a packed triangle ``(p, v)``; the result is packed as well."""
    return coo_to_packed(syr(alpha, x, packed_positions_to_coo(packed, n, uplo), n, uplo), n, uplo)


def spr2(alpha: float, x: DataFrame, y: DataFrame, packed: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """``syr2`` on a packed triangle ``(p, v)``; the result is packed as well."""
    full = packed_positions_to_coo(packed, n, uplo)
    return coo_to_packed(syr2(alpha, x, y, full, n, uplo), n, uplo)


# --- storage schemes ------------------------------------------------------------------


def colmajor_to_coo(df: DataFrame, arr: str, lda: int, keep: list[str] | None = None) -> DataFrame:
    """Flat column-major array column to coordinates, 1-based: position (j-1)*lda + (i-1)."""
    keep = keep or []
    return df.select(*keep, F.posexplode(arr).alias("p", "v")).select(
        *keep,
        (F.col("p") % lda + 1).cast("long").alias("i"),
        (F.floor(F.col("p") / lda) + 1).cast("long").alias("j"),
        F.col("v").cast("double").alias("v"),
    )


def coo_positions(a: DataFrame, lda: int, keep: list[str] | None = None) -> DataFrame:
    """1-based coordinates to column-major positions ``(p, v)``, one row per entry."""
    keep = keep or []
    return a.select(
        *keep, ((F.col("j") - 1) * lda + (F.col("i") - 1)).cast("long").alias("p"), "v"
    )


def coo_to_colmajor(a: DataFrame, lda: int, ncols: int, keys: list[str]) -> DataFrame:
    """Many small matrices, one flat column-major array each; absent entries become zero.

    An array holds ``lda * ncols`` numbers, which bounds the rows collected per key. For
    one large matrix use :func:`coo_positions`, which collects nothing. An entry outside
    the shape is an error.
    """
    inside = F.col("i").between(1, lda) & F.col("j").between(1, ncols)
    checked = F.when(inside, F.col("v")).otherwise(F.raise_error("entry outside the matrix").cast("double"))
    cells = coo_positions(a.withColumn("v", checked), lda, keys)
    single = cells.groupBy(*keys, "p").agg(F.coalesce(F.sum("v") + F.lit(0.0), F.lit(0.0)).alias("v"))
    held = single.groupBy(*keys).agg(F.collect_list(F.struct("p", F.lit(0).alias("absent"), "v")).alias("c"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(lda * ncols - 1).cast("long"))
    zeros = F.transform(slots, lambda p: F.struct(p.alias("p"), F.lit(1).alias("absent"), F.lit(0.0).alias("v")))

    def flat(ordered: Column) -> Column:
        # a zero stands right after the entry of its position, if there is one
        first = F.filter(ordered, lambda c, n: ~F.get(ordered, n - 1)["p"].eqNullSafe(c["p"]))
        return F.transform(first, lambda c: c["v"])

    # zeros are filled in inside the row of their matrix: only entries are shuffled
    return held.select(*keys, bound(F.array_sort(F.concat("c", zeros)), flat).alias("arr"))


def _triangle_size(r: Column) -> Column:
    return F.shiftright(r * (r + 1), 1)


def _triangle_root(p: Column) -> Column:
    """Largest r with r*(r+1)/2 <= p, corrected for rounding of the square root."""
    guess = F.floor((F.sqrt(F.lit(8.0) * p + 1) - 1) / 2)
    down = _triangle_size(guess) > p
    up = _triangle_size(guess + 1) <= p
    return F.when(down, guess - 1).when(up, guess + 1).otherwise(guess).cast("long")


def packed_positions_to_coo(
    packed: DataFrame, n: int, uplo: str = "U", keep: list[str] | None = None
) -> DataFrame:
    """Packed triangle ``(p, v)``, columns one after another, to 0-based coordinates.

    A position outside the triangle is an error.
    """
    keep = keep or []
    inside = F.col("p").between(0, n * (n + 1) // 2 - 1)
    outside = F.raise_error("packed position outside the triangle").cast("double")
    packed = packed.withColumn("v", F.when(inside, F.col("v")).otherwise(outside))
    if uplo.upper() == "U":
        j = _triangle_root(F.col("p"))
        i = F.col("p") - _triangle_size(j)
    else:
        back = F.lit(n * (n + 1) // 2 - 1) - F.col("p")
        r = _triangle_root(back)
        j = F.lit(n - 1) - r
        i = F.lit(n - 1) - (back - _triangle_size(r))
    return packed.select(*keep, i.cast("long").alias("i"), j.cast("long").alias("j"), "v")


def packed_to_coo(df: DataFrame, arr: str, n: int, uplo: str = "U", keep: list[str] | None = None) -> DataFrame:
    """Packed-triangle array column to 0-based coordinates; a longer array is an error."""
    keep = keep or []
    cells = df.select(*keep, F.posexplode(arr).alias("p", "v")).withColumn("v", F.col("v").cast("double"))
    return packed_positions_to_coo(cells, n, uplo, keep)


def coo_to_packed(a: DataFrame, n: int, uplo: str = "U") -> DataFrame:
    """0-based coordinates of one triangle to packed positions ``(p, v)``."""
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    if uplo.upper() == "U":
        p = i + _triangle_size(j)
    else:
        p = i + F.shiftright(j * (F.lit(2 * n - 1) - j), 1)
    return a.filter(_in_triangle(uplo)).select(p.cast("long").alias("p"), "v")


# --- structured views -----------------------------------------------------------------


def band_view(a: DataFrame, kl: int, ku: int) -> DataFrame:
    """Entries within ``kl`` sub-diagonals and ``ku`` super-diagonals."""
    return a.filter((F.col("j") - F.col("i") <= ku) & (F.col("i") - F.col("j") <= kl))


def sym_view(a: DataFrame, uplo: str = "U") -> DataFrame:
    """Full symmetric matrix from one stored triangle, in one pass over the rows."""
    stored = a.filter(_in_triangle(uplo))
    here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
    mirrored = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    places = F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, mirrored))
    return stored.select(F.explode(places).alias("c"), "v").select("c.i", "c.j", "v")


def tri_view(a: DataFrame, uplo: str = "U", unit: int | None = None) -> DataFrame:
    """One triangle. ``unit`` = order of the matrix puts ones on the diagonal, 0-based."""
    kept = tri_view_keyed(a, uplo).select("i", "j", "v")
    if unit is None:
        return kept
    ones = a.sparkSession.range(unit).select(
        F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")
    )
    return kept.filter(F.col("i") != F.col("j")).unionByName(ones)


def tri_view_keyed(a: DataFrame, uplo: str = "U") -> DataFrame:
    """One triangle of many matrices at once; key columns are kept."""
    return a.filter(_in_triangle(uplo))


# --- structured products --------------------------------------------------------------


def trmv(a: DataFrame, x: DataFrame, uplo: str = "U", trans: str = "N", unit: int | None = None) -> DataFrame:
    """Triangular matrix times vector."""
    return gemv(tri_view(a, uplo, unit), x, trans=trans)


def trmm(
    a: DataFrame,
    b: DataFrame,
    alpha: float = 1.0,
    side: str = "L",
    uplo: str = "U",
    trans: str = "N",
    unit: int | None = None,
    tile: int | None = None,
) -> DataFrame:
    """alpha*op(A)*B or alpha*B*op(A) with A triangular; ``tile`` as for :func:`gemm`."""
    tri = tri_view(a, uplo, unit)
    if side.upper() == "L":
        return gemm(tri, b, alpha=alpha, ta=trans, tile=tile)
    return gemm(b, tri, alpha=alpha, tb=trans, tile=tile)


def symv(
    a: DataFrame,
    x: DataFrame,
    y: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    uplo: str = "U",
) -> DataFrame:
    """Symmetric matrix, one stored triangle, times vector."""
    return gemv(sym_view(a, uplo), x, y, alpha, beta)


def symm(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    side: str = "L",
    uplo: str = "U",
    tile: int | None = None,
) -> DataFrame:
    """alpha*A*B + beta*C or alpha*B*A + beta*C with A symmetric; ``tile`` as for :func:`gemm`."""
    full = sym_view(a, uplo)
    if side.upper() == "L":
        return gemm(full, b, c, alpha, beta, tile=tile)
    return gemm(b, full, c, alpha, beta, tile=tile)


def gbmv(
    a: DataFrame,
    x: DataFrame,
    kl: int,
    ku: int,
    y: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    trans: str = "N",
) -> DataFrame:
    """Banded matrix times vector."""
    return gemv(band_view(a, kl, ku), x, y, alpha, beta, trans)


def sbmv(
    a: DataFrame,
    x: DataFrame,
    k: int,
    y: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    uplo: str = "U",
) -> DataFrame:
    """Symmetric banded matrix, one stored triangle, times vector."""
    return symv(band_view(a, k, k), x, y, alpha, beta, uplo)


def spmv(
    packed: DataFrame,
    x: DataFrame,
    n: int,
    y: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    uplo: str = "U",
) -> DataFrame:
    """Symmetric packed matrix ``(p, v)`` times vector."""
    return symv(packed_positions_to_coo(packed, n, uplo), x, y, alpha, beta, uplo)


def tbmv(
    a: DataFrame, x: DataFrame, k: int, uplo: str = "U", trans: str = "N", unit: int | None = None
) -> DataFrame:
    """Triangular banded matrix times vector."""
    return trmv(band_view(a, k, k), x, uplo, trans, unit)


def tpmv(
    packed: DataFrame, x: DataFrame, n: int, uplo: str = "U", trans: str = "N", unit: bool = False
) -> DataFrame:
    """Triangular packed matrix ``(p, v)`` times vector."""
    full = packed_positions_to_coo(packed, n, uplo)
    return trmv(full, x, uplo, trans, n if unit else None)
