"""Running sums and maxima, and ordered concatenation, without one task per key.

A plain window ``partitionBy(key).orderBy(pos)`` puts all rows of a key into one task. Here
positions are cut into blocks of ``BLOCK``: the window runs per (key, block), the block
totals are scanned per key (``rows / BLOCK`` of them), and the totals join back on
(key, block), which is the partitioning the rows already have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add inclusive running sums (0 when nothing seen) and running maxima (null likewise).

    ``pos`` is an integer, unique within ``keys``.
    """
    sums, maxima = sums or {}, maxima or {}
    blocked = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)))
    inside = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocked.select(
        "*",
        *[F.sum(F.coalesce(c.cast("long"), F.lit(0))).over(inside).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.max(c).over(inside).alias(f"_l_{n}") for n, c in maxima.items()],
    )
    totals = blocked.groupBy(*keys, "_blk").agg(
        *[F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_blk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxima],
    )
    joined = local.join(offsets, [*keys, "_blk"], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n in maxima],
    )


def ordered_concat(
    df: DataFrame,
    keys: list[str],
    pos: str,
    text: str,
    sep: str,
    out: str,
    block: int = 4_096,
) -> DataFrame:
    """One string per key: ``text`` in ``pos`` order joined by ``sep``.

    Pieces are joined per (key, block of positions) first, so a task sorts at most
    ``block`` rows; only the finished pieces meet in the final cell.
    """
    pieces = (
        df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)))
        .groupBy(*keys, "_blk")
        .agg(_joined(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")), sep).alias("_piece"))
    )
    return pieces.groupBy(*keys).agg(
        _joined(F.struct(F.col("_blk").alias("p"), F.col("_piece").alias("t")), sep).alias(out)
    )


def _joined(item: Column, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(item))
    return F.array_join(F.transform(ordered, lambda e: e["t"]), sep)
