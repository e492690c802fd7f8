"""Joins that stay safe when one key holds a large share of all rows.

``lookup_join``  big side against a lookup side: broadcast by hand only when the caller has counted
                 the lookup side; otherwise Spark decides by estimated or measured bytes.
``skew_join``    hash join; hot left keys are spread over several tasks, the matching
                 right rows are repeated once per task.
``grid_join``    both sides may be hot on the same key: the pair space of a hot key is cut
                 into a grid of tasks.

Salting never changes the result: each matching pair meets in exactly one task. A hot key has more than
``hot_rows`` rows and more than one in ``MOST_HOT`` of all rows, so a table of any size has fewer than ``MOST_HOT`` hot keys
and their list can be broadcast. No query plan is built by running a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 2_000_000
MOST_HOT = 100_000
NULL_SLOTS = 4_096


def hot_keys(df: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """``on`` + ``_n`` for the keys with more than ``hot_rows`` rows, fewer than ``MOST_HOT`` of them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    share = df.agg(F.count(F.lit(1)).alias("_all")).scalar() / MOST_HOT
    return counts.filter((F.col("_n") > hot_rows) & (F.col("_n") > share))


def _spread(n: Column, hot_rows: int) -> Column:
    return F.ceil(n / F.lit(hot_rows)).cast("int")


def _slot(on: list[str], columns: list[str], spread: Column) -> Column:
    """Deterministic slot in [0, spread) so that a recomputed task repeats its choice.

    Rows with a null key match nothing, so they may go to any slot.
    """
    unmatched = F.lit(False)
    for key in on:
        unmatched = unmatched | F.col(key).isNull()
    hashed = F.xxhash64(*[F.col(c) for c in columns])
    slots = F.when(unmatched, F.lit(NULL_SLOTS)).otherwise(F.coalesce(spread, F.lit(1)))
    return F.pmod(hashed, slots.cast("long")).cast("int")


def _slots(spread: Column) -> Column:
    return F.sequence(F.lit(0), F.coalesce(spread, F.lit(1)) - 1)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join with the hot keys of ``left`` salted by the other columns of ``left``.

    Rows that are equal in every column share a slot; aggregate such copies first.

    ``how`` is inner, left, left_semi or left_anti: the kinds for which repeating the
    right side once per slot keeps the result unchanged.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join kind not supported: {how}")
    hot = spread_of(left, on, hot_rows)
    return salt_many(left, on, hot).join(salt_one(right, on, hot), [*on, "_slot"], how).drop("_slot")


def spread_of(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``on`` + ``_s``: into how many slots each hot key is cut."""
    return hot_keys(df, on, hot_rows).select(*on, _spread(F.col("_n"), hot_rows).alias("_s"))


def salt_many(df: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Add ``_slot`` to the side whose hot keys are spread."""
    others = [c for c in df.columns if c not in on] or list(on)
    return (
        df.join(F.broadcast(hot), on, "left").withColumn("_slot", _slot(on, others, F.col("_s"))).drop("_s")
    )


def salt_one(df: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Add ``_slot`` to the other side: one copy of a row per slot of its key."""
    return (
        df.join(F.broadcast(hot), on, "left").withColumn("_slot", F.explode(_slots(F.col("_s")))).drop("_s")
    )


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_rows: int | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Join ``big`` to a lookup table.

    ``small_rows`` is the size of a lookup table of narrow rows that was counted already; up to
    ``BROADCAST_ROWS`` it is broadcast. ``hot_rows`` salts keys with more rows by hand. Without either,
    Spark chooses by estimated or measured bytes and splits hot keys while running.
    """
    if small_rows is not None and small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if hot_rows is None:
        return big.join(small, on, how)
    return skew_join(big, small, on, how, hot_rows)


def grid_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_by: list[str],
    right_by: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner equi-join for keys that are hot on both sides.

    A hot key with ``a`` left and ``b`` right slots becomes ``a * b`` independent tasks;
    left rows are repeated ``b`` times, right rows ``a`` times.
    """
    hot_left = hot_keys(left, on, hot_rows).select(*on, _spread(F.col("_n"), hot_rows).alias("_a"))
    hot_right = hot_keys(right, on, hot_rows).select(*on, _spread(F.col("_n"), hot_rows).alias("_b"))
    lefts = (
        left.join(F.broadcast(hot_left), on, "left")
        .join(F.broadcast(hot_right), on, "left")
        .withColumn("_la", _slot(on, left_by, F.col("_a")))
        .withColumn("_lb", F.explode(_slots(F.col("_b"))))
        .drop("_a", "_b")
    )
    rights = (
        right.join(F.broadcast(hot_left), on, "left")
        .join(F.broadcast(hot_right), on, "left")
        .withColumn("_lb", _slot(on, right_by, F.col("_b")))
        .withColumn("_la", F.explode(_slots(F.col("_a"))))
        .drop("_a", "_b")
    )
    return lefts.join(rights, [*on, "_la", "_lb"], "inner").drop("_la", "_lb")
