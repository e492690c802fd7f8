"""Timing expressions. A measurement of zero counts as missing, like null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def measured(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def ms_per_call(total_ms: Column, reps: Column) -> Column:
    return F.try_divide(total_ms, reps)


def speedup(base_ms: Column, cand_ms: Column) -> Column:
    """Base time over candidate time; null when either is missing."""
    return F.try_divide(measured(base_ms), measured(cand_ms))


def bench_summary(
    base_ms: Column,
    cand_ms: Column,
    error: Column,
    base_name: str = "Baseline",
    cand_name: str = "Candidate",
) -> Column:
    """One-line outcome of a timing run."""
    base, cand, ratio = measured(base_ms), measured(cand_ms), speedup(base_ms, cand_ms)
    both = F.format_string(
        f"{base_name}: %.3f ms  |  {cand_name}: %.3f ms  |  {cand_name} is %.2fx %s than {base_name}",
        base,
        cand,
        F.abs(F.coalesce(ratio, F.lit(1.0))),
        F.when(ratio >= 1, "faster").otherwise("slower"),
    )
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("Benchmark failed: "), error))
        .when(base.isNotNull() & cand.isNotNull(), both)
        .when(base.isNotNull(), F.format_string(f"{base_name}: %.3f ms  |  {cand_name}: N/A", base))
        .otherwise("Incomplete benchmark data.")
    )
