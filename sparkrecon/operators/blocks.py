"""Block matrices: a matrix cut into tiles, one row per tile that holds something.

A tile table is ``(bi, bj, at, v)``: tile row and column, positions ``row * cols + col`` inside the tile, values.
Absent positions are zero, as in coordinate form, and a tile may be full or hold one entry. Products join tiles,
not entries: one row per pair of tiles instead of one per scalar product, multiplied by numpy in
Arrow batches. Each task adds up what it has per output tile before anything is shuffled, so the
shuffle carries at most one row per output tile and task.

Tiles pay when they hold more than a few entries each: an inner index with many entries on both sides. For
very sparse factors the coordinate form in ``matrices`` moves less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.plans.lineage import checkpoint, drop_scratch, scratch_path

SIDE = 32
#: Bytes of tiles that a task spreads out at once, and of output tiles it keeps before it passes their sums on.
SLICE_BYTES, HELD_BYTES = 1 << 24, 1 << 26
_CELL = 12

#: For factors with a short inner index: tile columns that a task holds, tile rows it goes through at most while there are
#: more than ``TASKS`` tasks.
EDGE, ROWS, TASKS = 64, 128, 64
_MARK, _A, _B, _C = range(4)

SCHEMA = "bi long, bj long, at array<int>, v array<double>"


def tiles(a: DataFrame, rows: int = SIDE, cols: int | None = None) -> DataFrame:
    """Coordinates ``(i, j, v)`` to tiles of ``rows`` x ``cols``; repeated coordinates are added first."""
    cols = cols or rows
    summed = a.groupBy("i", "j").agg(F.sum("v").alias("v"))
    at = F.pmod(F.col("i"), F.lit(rows)) * cols + F.pmod(F.col("j"), F.lit(cols))
    cells = F.collect_list(F.struct(at.cast("int").alias("at"), F.col("v").cast("double").alias("v")))
    placed = summed.groupBy(_block("i", rows).alias("bi"), _block("j", cols).alias("bj")).agg(cells.alias("c"))
    return placed.select("bi", "bj", F.col("c.at").alias("at"), F.col("c.v").alias("v"))


def _block(index: str, side: int) -> Column:
    return F.floor(F.col(index) / F.lit(side)).cast("long")


def entries(t: DataFrame, rows: int = SIDE, cols: int | None = None) -> DataFrame:
    """Tiles back to coordinates ``(i, j, v)``."""
    cols = cols or rows
    cell = F.explode(F.arrays_zip("at", "v")).alias("c")
    return t.select("bi", "bj", cell).select(
        (F.col("bi") * rows + F.floor(F.col("c.at") / cols)).cast("long").alias("i"),
        (F.col("bj") * cols + F.col("c.at") % cols).cast("long").alias("j"),
        F.col("c.v").alias("v"),
    )


def dense(at: pa.ListArray, v: pa.ListArray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of each tile of a batch, as stacks of matrices."""
    m = len(at)
    sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(m) * (rows * cols), sizes) + at.flatten().to_numpy(zero_copy_only=False)
    values, present = np.zeros(m * rows * cols), np.zeros(m * rows * cols, np.float32)
    values[place] = v.flatten().to_numpy(zero_copy_only=False)
    present[place] = 1.0
    return values.reshape(m, rows, cols), present.reshape(m, rows, cols)


def slices(batch: pa.RecordBatch, cells: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose tiles, ``cells`` entries a row, may be spread out together."""
    step = max(1, SLICE_BYTES // (_CELL * cells))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def tile_batch(keys: np.ndarray, values: np.ndarray, present: np.ndarray) -> pa.RecordBatch:
    """A stack of matrices as tile rows; ``keys`` has a row (bi, bj) per matrix."""
    m, cells = len(keys), values.shape[1] * values.shape[2]
    flat, seen = values.reshape(m, cells), present.reshape(m, cells) > 0
    tile, at = np.nonzero(seen)
    ends = pa.array(np.searchsorted(tile, np.arange(m + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[:, 0], pa.int64()),
            pa.array(keys[:, 1], pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(flat[tile, at])),
        ],
        ["bi", "bj", "at", "v"],
    )


class Sums:
    """Sums of matrices per output tile; about ``HELD_BYTES`` of them are kept."""

    def __init__(self, rows: int, cols: int):
        self.shape, self.slot = (rows, cols), {}
        self.values = np.zeros((0, rows, cols))
        self.present = np.zeros((0, rows, cols), np.float32)

    def add(self, keys: np.ndarray, values: np.ndarray, present: np.ndarray) -> None:
        unique, inverse = np.unique(keys, axis=0, return_inverse=True)
        slots = np.array([self.slot.setdefault(k, len(self.slot)) for k in map(tuple, unique.tolist())], np.int64)
        if len(self.slot) > len(self.values):
            room = max(len(self.slot), 2 * len(self.values)) - len(self.values)
            self.values = np.concatenate([self.values, np.zeros((room, *self.shape))])
            self.present = np.concatenate([self.present, np.zeros((room, *self.shape), np.float32)])
        order = np.argsort(inverse.reshape(-1), kind="stable")
        first = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(unique)))
        self.values[slots] += np.add.reduceat(values[order], first, axis=0)
        self.present[slots] += np.add.reduceat(present[order], first, axis=0)

    def full(self) -> bool:
        return len(self.slot) * _CELL * self.shape[0] * self.shape[1] >= HELD_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys = np.array(list(self.slot), np.int64).reshape(-1, 2)
        step = max(1, SLICE_BYTES // (_CELL * self.shape[0] * self.shape[1]))
        for i in range(0, len(keys), step):
            part = slice(i, min(i + step, len(keys)))
            yield tile_batch(keys[part], self.values[part], self.present[part])
        self.__init__(*self.shape)


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def places(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns(batch, *names)], axis=1)


def partial_products(rows: int, inner: int, cols: int, alpha: float = 1.0) -> Callable:
    """A task function: pairs of tiles (bi, bj, a_at, a_v, b_at, b_v) to sums of their products per output tile."""

    def run(batches):
        sums = Sums(rows, cols)
        for batch in batches:
            for piece in slices(batch, max(rows * inner, inner * cols, rows * cols)):
                left, has_left = dense(*columns(piece, "a_at", "a_v"), rows, inner)
                right, has_right = dense(*columns(piece, "b_at", "b_v"), inner, cols)
                sums.add(places(piece, "bi", "bj"), alpha * (left @ right), has_left @ has_right)
                if sums.full():
                    yield from sums.flush()
        yield from sums.flush()

    return run


def add_tiles(parts: DataFrame, rows: int = SIDE, cols: int | None = None) -> DataFrame:
    """One tile per place: the sum of all that stand there.

    Rows of a place are neighbours in their partition, so a task holds a bounded number of tiles however many parts a
    place has.
    """
    cols = cols or rows

    def run(batches):
        sums = Sums(rows, cols)
        for batch in batches:
            for piece in slices(batch, rows * cols):
                keys = places(piece, "bi", "bj")
                values, present = dense(*columns(piece, "at", "v"), rows, cols)
                if sums.full():
                    # the place that this piece goes on with stays open
                    ahead = (int(keys[0, 0]), int(keys[0, 1]))
                    yield from _flush_but(sums, ahead)
                sums.add(keys, values, present)
        yield from sums.flush()

    sorted_ = parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return sorted_.mapInArrow(run, SCHEMA)


def _flush_but(sums: Sums, ahead: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    slot = sums.slot.get(ahead)
    kept = None if slot is None else (sums.values[slot].copy(), sums.present[slot].copy())
    if slot is not None:
        sums.present[slot] = 0.0
    for batch in sums.flush():
        # the open place has nothing present here
        yield batch.filter(pa.array(batch.column(2).value_lengths().to_numpy(zero_copy_only=False) > 0))
    if kept is not None:
        sums.add(np.array([ahead], np.int64), kept[0][None], kept[1][None])


def product(a: DataFrame, b: DataFrame, rows: int, inner: int, cols: int, alpha: float = 1.0, split: int = 1) -> DataFrame:
    """Partial tiles of alpha*A*B, at most one per output tile and task (or per ``HELD_BYTES`` of them).

    Tiles meet on the inner tile index. An inner tile that very many tiles of A have is dealt over
    ``split`` tasks by A's tile row, which repeats B's tiles as often; AQE splits what is left while running.
    """
    left = a.select("bi", F.col("bj").alias("bk"), F.col("at").alias("a_at"), F.col("v").alias("a_v"))
    right = b.select(F.col("bi").alias("bk"), "bj", F.col("at").alias("b_at"), F.col("v").alias("b_v"))
    on = ["bk"]
    if split > 1:
        left = left.withColumn("part", F.pmod(F.xxhash64("bi"), F.lit(split)).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
        on = ["bk", "part"]
    pairs = left.join(right, on).select("bi", "bj", "a_at", "a_v", "b_at", "b_v")
    return pairs.mapInArrow(partial_products(rows, inner, cols, alpha), SCHEMA)


def product_in_place(a: DataFrame, b: DataFrame, c: DataFrame | None, side: int = SIDE, alpha: float = 1.0) -> DataFrame:
    """Entries (i, j, v) of alpha*A*B + C, where neither the product nor copies of the factors are shuffled.

    Tile rows of A and C and tile columns of B are dealt into groups, each stored once. A task reads one group of either
    kind, holds the columns and goes through the rows, so what is written grows with the factors and only what is read
    with their product. For factors whose inner index is short, as a task holds whole tile columns of B, and a C that is
    sparse beside the product, as every group of columns reads it.
    """
    spark = a.sparkSession
    none = F.lit(None)
    lefts = a.select(F.lit(_A).alias("part"), F.col("bi").alias("m"), F.col("bj").alias("n"), "at", "v")
    if c is not None:
        lefts = lefts.unionByName(c.select(F.lit(_C).alias("part"), F.col("bi").alias("m"), F.col("bj").alias("n"), "at", "v"))
    rights = b.select(F.lit(_B).alias("part"), F.col("bj").alias("m"), F.col("bi").alias("n"), "at", "v")
    stored = [scratch_path(spark, "tiles") for _ in range(2)]
    for t, path in zip((lefts, rights), stored):
        t.write.parquet(path)
    lefts, rights = map(spark.read.parquet, stored)
    rows = lefts.agg(F.countDistinct("m")).first()[0]
    held, cols = rights.agg(F.count(F.lit(1)), F.countDistinct("m")).first()
    right_groups = max(1, -(-cols // EDGE), -(-held * side * side * _CELL // HELD_BYTES))
    left_groups = max(1, -(-rows // ROWS), min(rows, -(-TASKS // right_groups)))

    def dealt(t: DataFrame, groups: int) -> DataFrame:
        # every group starts with a row that stands for the group
        marks = spark.range(groups).select(
            F.col("id").cast("int").alias("g"),
            F.lit(_MARK).alias("part"),
            *(none.cast(kind).alias(name) for name, kind in t.dtypes if name != "part"),
        )
        placed = marks.unionByName(t.select(_group("m", groups).alias("g"), "*"))
        return checkpoint(placed.repartitionById(groups, "g").sortWithinPartitions(F.col("part") > _MARK, "m", "part", "n"))

    x, y = dealt(lefts, left_groups).alias("x"), dealt(rights, right_groups).alias("y")
    drop_scratch(spark, *stored)
    # the mark of the rows takes in the columns, and then the mark of the columns each row, all once
    takes_in = (F.col("x.part") == _MARK) & (F.col("y.part") > _MARK)
    in_group = (F.col("x.part") == _A) | ((F.col("x.part") == _C) & (_group("x.n", right_groups) == F.col("y.g")))
    pairs = x.hint("shuffle_replicate_nl").join(y, takes_in | ((F.col("y.part") == _MARK) & in_group))
    sent = (F.when(F.col("x.part") == _MARK, F.col(f"y.{n}")).otherwise(F.col(f"x.{n}")).alias(n) for n in ("part", "m", "n", "at", "v"))
    return pairs.select(*sent).mapInArrow(_row_sums(side, alpha), "i long, j long, v double")


def _group(index: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.col(index)), F.lit(groups)).cast("int")


def _row_sums(side: int, alpha: float) -> Callable:
    """A task function: tiles of B, then those of A and C tile row by tile row, to the entries of the tile rows."""

    def run(batches):
        taken, right, row, parts = [], None, None, []
        for batch in batches:
            for piece in slices(batch, side * side):
                values, present = dense(*columns(piece, "at", "v"), side, side)
                keys = places(piece, "part", "m", "n")
                first = int(np.searchsorted(keys[:, 0] != _B, True))
                if first:
                    taken.append((keys[:first, 1:], values[:first], present[:first]))
                for part, m, n, x, has in zip(*keys[first:].T.tolist(), values[first:], present[first:]):
                    if right is None:
                        right, taken = _Right(taken, side), []
                    if m != row:
                        yield from right.entries(row, parts, alpha)
                        row, parts = m, []
                    if part == _C and n not in right.slot:
                        # nothing of the product stands here
                        yield _entries(m * side, n * side + np.arange(side), x, has)
                    else:
                        parts.append((part, n, x, has))
        if right is not None:
            yield from right.entries(row, parts, alpha)

    return run


class _Right:
    """Tile columns of B, laid side by side for each inner tile."""

    def __init__(self, taken: list, side: int):
        keys, values, present = (
            map(np.concatenate, zip(*taken))
            if taken
            else (np.zeros((0, 2), np.int64), np.zeros((0, side, side)), np.zeros((0, side, side), np.float32))
        )
        at, slots = np.unique(keys[:, 0], return_inverse=True)
        self.side, self.slot = side, {m: k for k, m in enumerate(at.tolist())}
        self.j = (at[:, None] * side + np.arange(side)).reshape(-1)
        self.inner = {}
        for n in np.unique(keys[:, 1]).tolist():
            own = np.flatnonzero(keys[:, 1] == n)
            beside = (t[own].transpose(1, 0, 2).reshape(side, -1) for t in (values, present))
            self.inner[n] = (slots.reshape(-1)[own], *beside)

    def entries(self, row: int | None, parts: list, alpha: float) -> Iterator[pa.RecordBatch]:
        """What the tiles of a tile row of A and C add up to."""
        side, many = self.side, len(self.slot)
        if not parts or not many:
            return
        sums, seen = np.zeros((side, many, side)), np.zeros((side, many, side), np.float32)
        for part, n, x, has in parts:
            if part == _C:
                sums[:, self.slot[n]] += x
                seen[:, self.slot[n]] += has
            elif n in self.inner:
                slots, values, present = self.inner[n]
                at = slice(None) if len(slots) == many and np.all(slots[1:] > slots[:-1]) else slots
                sums[:, at] += alpha * (x @ values).reshape(side, -1, side)
                seen[:, at] += (has @ present).reshape(side, -1, side)
        yield _entries(row * side, self.j, sums.reshape(side, -1), seen.reshape(side, -1))


def _entries(top: int, j: np.ndarray, values: np.ndarray, present: np.ndarray) -> pa.RecordBatch:
    """Entries of some rows from ``top`` on, in the columns ``j``."""
    r, at = np.nonzero(present > 0)
    return pa.RecordBatch.from_arrays([pa.array(top + r), pa.array(j[at]), pa.array(values[r, at])], ["i", "j", "v"])


def gemm(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame | None = None,
    alpha: float = 1.0,
    beta: float = 0.0,
    side: int = SIDE,
    split: int = 1,
    short: bool = False,
) -> DataFrame:
    """alpha*A*B + beta*C of coordinate tables, multiplied in tiles; the result is in coordinates.

    It has the rows that the coordinate form has: a sum of zero is a row, a place nothing adds to is none. ``short`` says
    that the inner index has few tiles and the product many: see :func:`product_in_place`.
    """
    if short and alpha != 0:
        kept = None
        if beta != 0 and c is not None:
            kept = tiles(c.select("i", "j", (F.lit(float(beta)) * F.col("v")).alias("v")), side)
        return product_in_place(tiles(a, side), tiles(b, side), kept, side, alpha)
    parts = None
    if alpha != 0:
        parts = product(tiles(a, side), tiles(b, side), side, side, side, alpha, split)
    if beta != 0 and c is not None:
        kept = tiles(c.select("i", "j", (F.lit(float(beta)) * F.col("v")).alias("v")), side)
        parts = kept if parts is None else parts.unionByName(kept)
    if parts is None:
        return a.select("i", "j", "v").limit(0)
    return entries(add_tiles(parts, side), side)
