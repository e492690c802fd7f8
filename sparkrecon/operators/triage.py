"""Triage of results: what failed, what to run again, and attempts so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.operators.selection import ordered_dedupe
from sparkrecon.plans.joins import lookup_join

# Fixed value: how often a function is run again at most.
MAX_RETRIES = 3


def _without(df: DataFrame, exhausted: DataFrame | None) -> DataFrame:
    if exhausted is None:
        return df
    names = exhausted.select(F.lower("fn").alias("fn")).distinct()
    return lookup_join(df, names, ["fn"], "left_anti")


def failed_accuracy(acc: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """Lower-case names, with ``ord``, whose check did not pass."""
    failed = acc.filter(~F.col("passed")).select(F.lower("fn").alias("fn"), "ord")
    return _without(failed, exhausted).select("fn", "ord")


def failed_bench(bench: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """Lower-case names, with ``ord``, whose candidate gave no time and no message.

    A slow candidate has not failed.
    """
    silent = F.col("cand_ms").isNull() & (F.coalesce("error", F.lit("")) == "")
    failed = bench.filter(silent).select(F.lower("fn").alias("fn"), "ord")
    return _without(failed, exhausted).select("fn", "ord")


def retry_set(acc: DataFrame, bench: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """``(fn, source, ord)``: accuracy failures, then timing failures, no name twice."""
    first = failed_accuracy(acc, exhausted).withColumn("source", F.lit(0))
    second = failed_bench(bench, exhausted).withColumn("source", F.lit(1))
    both = first.unionByName(second).withColumn("at", F.struct("source", "ord"))
    return ordered_dedupe(both, "fn", "at").select("fn", "at.source", "at.ord")


def attempt_ledger(attempts: DataFrame, fields: list[str], max_retries: int = MAX_RETRIES) -> DataFrame:
    """Latest attempt per function with the retries spent: ``(fn, *fields, retries)``.

    ``attempts`` is ``(fn, attempt, …)`` with attempts numbered from 0. The latest row is an
    aggregate, combined before the shuffle, so a function with very many attempts is no
    bottleneck.
    """
    latest = F.max(F.struct(F.col("attempt"), *[F.col(c) for c in fields]))
    return (
        attempts.groupBy("fn")
        .agg(latest.alias("_last"))
        .select(
            "fn",
            *[F.col(f"_last.{c}").alias(c) for c in fields],
            F.least(F.col("_last.attempt"), F.lit(max_retries)).alias("retries"),
        )
    )


def isolate_errors(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Add one empty result row per failed strategy, so the others still report.

    ``results`` is ``(strategy, fn, build_ok, test_ok, …)``, ``failures`` is
    ``(strategy, error)``.
    """
    rows = results if "error" in results.columns else results.withColumn("error", F.lit(None).cast("string"))
    failed = failures.select("strategy", F.lit(False).alias("build_ok"), F.lit(False).alias("test_ok"), "error")
    return rows.unionByName(failed, allowMissingColumns=True)
