"""Triangular solves by level-scheduled blocked substitution.

The triangle is cut into tiles of ``order`` x ``order``, and the tile rows into at most ``PANELS`` runs of about equal
length, the panels. A panel is ready when every panel it needs is solved. Each round takes all ready ones. A
task takes a panel and a tile column of right-hand sides and goes through the tile rows in order: it takes off what the
tiles beside the diagonal make of the values it has, then solves the diagonal tile. It reads a tile at a time
and holds the panel's values. The tiles below (in the same columns, of other panels) are then multiplied with the new
values by all tasks, and the products are taken off the right-hand sides of later panels. A round's values
and products are stored below the shared folder, so the plan stays short and a lost executor costs one round. A
tile is read and multiplied once.

There are at most ``PANELS`` rounds, whatever the order of the matrix: as many as the longest chain of panels, and one
when no panel needs another. With ``PANELS`` tile rows or fewer each is a panel.

Stored tables are laid out by panel, so that a round reads those that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.operators import blocks
from sparkrecon.operators.matrices import band_view, packed_positions_to_coo, transpose, tri_view
from sparkrecon.plans.lineage import scratch_path

ORDER = 64
#: Runs of tile rows that are solved one after another, at most.
PANELS = 16


def trsv(a: DataFrame, x: DataFrame, uplo: str = "U", trans: str = "N", unit: bool = False, order: int = ORDER) -> DataFrame:
    """x with op(A)*x = b, where A is one triangle and ``x`` holds b as ``(k, v)``.

    With ``unit`` the diagonal counts as ones and is not read. A zero or missing diagonal entry is an error
    (``singular``), for every row that A or b has. Rows are those of b and all that follow from them.
    """
    solved = _solve(_plain(a, uplo, trans, unit), _column(x), _forward(uplo, trans), unit, order, 1)
    return solved.select(F.col("i").alias("k"), "v")


def tbsv(
    a: DataFrame, x: DataFrame, k: int, uplo: str = "U", trans: str = "N", unit: bool = False, order: int = ORDER
) -> DataFrame:
    """:func:`trsv` with a triangular band of ``k`` diagonals beside the main one."""
    return trsv(band_view(a, k, k), x, uplo, trans, unit, order)


def tpsv(
    packed: DataFrame, x: DataFrame, n: int, uplo: str = "U", trans: str = "N", unit: bool = False, order: int = ORDER
) -> DataFrame:
    """:func:`trsv` with a packed triangle ``(p, v)``."""
    return trsv(packed_positions_to_coo(packed, n, uplo), x, uplo, trans, unit, order)


def trsm(
    a: DataFrame,
    b: DataFrame,
    alpha: float = 1.0,
    side: str = "L",
    uplo: str = "U",
    trans: str = "N",
    unit: bool = False,
    order: int = ORDER,
) -> DataFrame:
    """X with op(A)*X = alpha*B (side L) or X*op(A) = alpha*B (side R), A triangular."""
    if alpha == 0:
        return b.select("i", "j", "v").limit(0)
    scaled = b.select("i", "j", (F.lit(float(alpha)) * F.col("v")).alias("v"))
    if side.upper() == "L":
        return _solve(_plain(a, uplo, trans, unit), scaled, _forward(uplo, trans), unit, order, order)
    if side.upper() != "R":
        raise ValueError(f"bad side: {side}")
    # X*op(A) = B is op(A)'*X' = B'
    turned = "N" if trans.upper() in ("T", "C") else "T"
    return transpose(_solve(_plain(a, uplo, turned, unit), transpose(scaled), _forward(uplo, turned), unit, order, order))


def _plain(a: DataFrame, uplo: str, trans: str, unit: bool) -> DataFrame:
    """op(A) as a triangle, without its diagonal when that counts as ones."""
    if trans.upper() not in ("N", "T", "C"):
        raise ValueError(f"bad transpose flag: {trans}")
    kept = tri_view(a, uplo).select("i", "j", "v")
    kept = kept.filter("i <> j") if unit else kept
    return kept if trans.upper() == "N" else transpose(kept)


def _forward(uplo: str, trans: str) -> bool:
    """Whether op(A) is a lower triangle, solved from the first row on."""
    return (uplo.upper() == "L") == (trans.upper() == "N")


def _column(x: DataFrame) -> DataFrame:
    return x.select(F.col("k").alias("i"), F.lit(0).cast("long").alias("j"), "v")


def substitute(
    triangle: np.ndarray, has: np.ndarray, right: np.ndarray, given: np.ndarray, used: np.ndarray, forward: bool, unit: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Solve a stack of triangular tiles for a stack of right-hand sides; values and presence.

    ``used`` marks the rows that the matrix or the right-hand side has.
    """
    x, seen = right.copy(), given > 0
    order = triangle.shape[1]
    for r in range(order) if forward else range(order - 1, -1, -1):
        done = slice(0, r) if forward else slice(r + 1, order)
        row = triangle[:, r : r + 1, done]
        x[:, r] -= (row @ x[:, done])[:, 0]
        seen[:, r] |= (has[:, r : r + 1, done] @ seen[:, done].astype(np.float32))[:, 0] > 0
        if not unit:
            pivot = triangle[:, r, r]
            if np.any(used[:, r] & (pivot == 0)):
                raise ValueError("singular: zero or missing diagonal entry")
            x[:, r] /= np.where(pivot == 0, 1.0, pivot)[:, None]
    return x, seen


def _solve(a: DataFrame, b: DataFrame, forward: bool, unit: bool, order: int, width: int) -> DataFrame:
    spark = a.sparkSession
    folder = scratch_path(spark, "solve")

    def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
        schema = df.schema
        df.write.partitionBy(*parts).parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    cut = stored(blocks.tiles(a, order), "cut")
    # an entry without a place meets nothing; the triangle has none
    right = stored(blocks.tiles(b.filter("i is not null and j is not null"), order, width), "right")
    # rows of the matrix and of the right-hand sides: those that need a diagonal entry
    rows = stored(_rows(cut, right, order, width), "rows")
    panel = _panels(rows)
    tiles = stored(cut.select("*", panel("bi").alias("panel"), panel("bj").alias("source")), "tiles", "source", "panel")
    right.withColumn("panel", panel("bi")).write.partitionBy("panel").parquet(f"{folder}/parts/round=-1")

    # at most PANELS panels, so at most PANELS * PANELS rows
    needs: dict[int, set[int]] = {r["panel"]: set() for r in rows.select(panel("bi").alias("panel")).distinct().collect()}
    for r in tiles.filter("source <> panel").select("panel", "source").distinct().collect():
        needs[r["panel"]].add(r["source"])
    if not needs:
        return a.select("i", "j", "v").limit(0)
    solved: set[int] = set()
    level = 0
    while ready := _settle(needs, solved)["settled"]:
        parts = spark.read.schema(f"{blocks.SCHEMA}, round int, panel int").parquet(f"{folder}/parts")
        sides = parts.filter(F.col("panel").isin(ready)).select("panel", "bi", "bj", "at", "v")
        here = rows.withColumn("panel", panel("bi")).filter(F.col("panel").isin(ready))
        inside = tiles.filter(F.col("source").isin(ready) & (F.col("source") == F.col("panel")))
        found = _panel_rows(here, inside, sides, forward).mapInArrow(_solver(order, width, forward, unit), blocks.SCHEMA)
        found.withColumn("panel", panel("bi")).write.partitionBy("panel").parquet(f"{folder}/values/round={level}")
        solved.update(ready)
        if any(need & set(ready) for need in needs.values()):
            values = spark.read.schema(f"{blocks.SCHEMA}, panel int").parquet(f"{folder}/values/round={level}")
            below = tiles.filter(F.col("source").isin(ready) & (F.col("source") != F.col("panel")))
            update = blocks.product(below.select("bi", "bj", "at", "v"), values, order, order, width, alpha=-1.0)
            update.withColumn("panel", panel("bi")).write.partitionBy("panel").parquet(f"{folder}/parts/round={level}")
        level += 1
    values = spark.read.schema(f"{blocks.SCHEMA}, round int, panel int").parquet(f"{folder}/values")
    return blocks.entries(values, order, width)


def _rows(cut: DataFrame, right: DataFrame, order: int, width: int) -> DataFrame:
    """(bi, used): which rows of each tile row the matrix or the right-hand side has, as positions."""
    place = lambda p: p.cast("int")
    row = lambda cols: F.array_distinct(F.transform("at", lambda p: place(F.floor(p / cols))))
    column = F.array_distinct(F.transform("at", lambda p: place(p % order)))
    each = cut.select("bi", row(order).alias("used")).unionByName(cut.select(F.col("bj").alias("bi"), column.alias("used")))
    each = each.unionByName(right.select("bi", row(width).alias("used")))
    return each.select("bi", F.explode("used").alias("at")).groupBy("bi").agg(F.collect_set("at").alias("used"))


def _panels(rows: DataFrame) -> Callable[[str], Column]:
    """The panel of a tile row, numbered from the first row on: cuts tile rows into PANELS runs of about equal length."""
    steps = [i / PANELS for i in range(1, PANELS)]
    ends = rows.agg(F.percentile_approx("bi", steps).alias("e")).first()["e"] or []
    return lambda c: sum(((F.col(c) > int(e)).cast("int") for e in sorted(set(ends))), F.lit(0)).cast("int")


def _settle(needs: dict[int, set[int]], solved: set[int]) -> dict:
    """The panels that are left and need none but solved ones."""
    return {"settled": sorted(p for p, need in needs.items() if p not in solved and need <= solved)}


def _panel_rows(here: DataFrame, inside: DataFrame, sides: DataFrame, forward: bool) -> DataFrame:
    """What a panel is solved from, per tile column of right-hand sides, in the order of substitution.

    Per tile row: its used rows (part 0), its tiles (1), its right-hand sides (2). A panel without any right-hand side
    is gone through once, for its diagonal.
    """
    columns = sides.select("panel", F.col("bj").alias("col")).distinct()
    none = F.array().cast("array<double>")
    each = here.select("panel", "bi", F.lit(0).alias("part"), F.col("bi").alias("bk"), F.col("used").alias("at"), none.alias("v"))
    each = each.unionByName(inside.select("panel", "bi", F.lit(1).alias("part"), F.col("bj").alias("bk"), "at", "v"))
    each = each.join(columns, "panel", "left").withColumn("col", F.coalesce("col", F.lit(0).cast("long")))
    given = sides.select("panel", "bi", F.lit(2).alias("part"), F.col("bi").alias("bk"), "at", "v", F.col("bj").alias("col"))
    step = F.col("bi").asc() if forward else F.col("bi").desc()
    return each.unionByName(given).repartition("panel", "col").sortWithinPartitions("panel", "col", step, "part")


def _solver(order: int, width: int, forward: bool, unit: bool):
    """A task function: rows of :func:`_panel_rows` to solved tiles."""

    def spread(at: np.ndarray, v: np.ndarray, cols: int) -> tuple[np.ndarray, np.ndarray]:
        values, present = np.zeros(order * cols), np.zeros(order * cols, np.float32)
        values[at], present[at] = v, 1.0
        return values.reshape(order, cols), present.reshape(order, cols)

    def run(batches):
        held = max(1, blocks.SLICE_BYTES // (12 * order * width))
        panel, row, known, out = None, None, {}, []

        def close() -> None:
            """Solve the tile row that is complete; one without a right-hand side is solved by zeros, which are absent."""
            (_, col, bi), (triangle, has, right, given, used) = row
            x, seen = substitute(triangle[None], has[None], right[None], given[None], used[None], forward, unit)
            if seen.any():
                known[bi] = x[0], seen[0].astype(np.float32)
                out.append((bi, col, *known[bi]))

        def passed():
            keys = np.array([o[:2] for o in out], np.int64)
            yield blocks.tile_batch(keys, np.stack([o[2] for o in out]), np.stack([o[3] for o in out]))
            out.clear()

        for batch in batches:
            keys = blocks.places(batch, "panel", "col", "bi", "part", "bk").tolist()
            at, v = blocks.columns(batch, "at", "v")
            at_ends, v_ends = at.offsets.to_numpy(), v.offsets.to_numpy()
            at, v = at.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
            for r, (p, col, bi, part, bk) in enumerate(keys):
                cells, numbers = at[at_ends[r] : at_ends[r + 1]], v[v_ends[r] : v_ends[r + 1]]
                if part == 0:
                    if row is not None:
                        close()
                    if len(out) >= held:
                        yield from passed()
                    if panel != (p, col):
                        panel, known = (p, col), {}
                    used = np.zeros(order, bool)
                    used[cells] = True
                    empty = (np.zeros((order, n), t) for n in (order, width) for t in (float, np.float32))
                    row = (p, col, bi), [*empty, used]
                elif part == 1 and bk == bi:
                    row[1][0], row[1][1] = spread(cells, numbers, order)
                elif part == 1:
                    if bk in known:
                        values, present = spread(cells, numbers, order)
                        row[1][2] -= values @ known[bk][0]
                        row[1][3] += present @ known[bk][1]
                else:
                    values, present = spread(cells, numbers, width)
                    row[1][2] += values
                    row[1][3] += present
        if row is not None:
            close()
        if out:
            yield from passed()

    return run
