"""Numeric reconciliation of a reference output with a candidate output.

An output is ``(fn, case, pos, v)``: which function, which test case, which position. The
two sides are stacked and aggregated per position instead of outer-joined, so one shuffle
pairs them and repeated positions are noticed rather than multiplied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.plans.joins import lookup_join
from sparkrecon.plans.lineage import checkpoint

# Largest accepted absolute error, final and early check.
TOLERANCE = 1e-10
EARLY_TOLERANCE = 1e-6

KEYS = ["fn", "case", "pos"]


def align(ref: DataFrame, cand: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, ref, cand, n_ref, n_cand``: both values per position, null where absent.

    A row without a position stands for a void output: it is no value at all.
    """
    keys = keys or KEYS
    none = F.lit(None).cast("double")
    ref, cand = (side.filter(F.col(keys[-1]).isNotNull()) for side in (ref, cand))
    left = ref.select(*keys, F.col("v").alias("ref"), none.alias("cand"), F.lit(1).alias("r"), F.lit(0).alias("c"))
    right = cand.select(*keys, none.alias("ref"), F.col("v").alias("cand"), F.lit(0).alias("r"), F.lit(1).alias("c"))
    return (
        left.unionByName(right)
        .groupBy(*keys)
        .agg(
            F.max("ref").alias("ref"),
            F.max("cand").alias("cand"),
            F.sum("r").alias("n_ref"),
            F.sum("c").alias("n_cand"),
        )
    )


def case_errors(aligned: DataFrame, tol: float = TOLERANCE, keys: list[str] | None = None) -> DataFrame:
    """Per case: lengths, pairing status, largest and mean absolute error, ok.

    Errors are null unless the sides have the same length and pair up completely. NaN is
    larger than any number, so a NaN makes the case fail; so does a null at a real position
    (``n_null`` counts those positions).
    """
    keys = keys or ["fn", "case"]
    err = F.abs(F.col("cand") - F.col("ref"))
    counted = aligned.groupBy(*keys).agg(
        F.sum("n_ref").alias("n_ref"),
        F.sum("n_cand").alias("n_cand"),
        F.sum(F.when((F.col("n_ref") == 1) & (F.col("n_cand") == 1), 1).otherwise(0)).alias("n_pair"),
        F.sum(F.when((F.col("n_ref") > 0) & (F.col("n_cand") > 0) & err.isNull(), 1).otherwise(0)).alias("n_null"),
        F.max(err).alias("_max"),
        F.avg(err).alias("_mean"),
    )
    status = (
        F.when(F.col("n_ref") == 0, "NO_REFERENCE")
        .when(F.col("n_cand") == 0, "NO_CANDIDATE")
        .when(
            (F.col("n_ref") != F.col("n_cand")) | (F.col("n_pair") != F.col("n_ref")),
            "LENGTH_MISMATCH",
        )
        .otherwise("COMPARED")
    )
    compared = F.col("status") == "COMPARED"
    return counted.withColumn("status", status).select(
        *keys,
        "n_ref",
        "n_cand",
        "status",
        F.when(compared, F.col("_max")).alias("max_err"),
        F.when(compared, F.col("_mean")).alias("mean_err"),
        F.when(compared, F.col("n_null")).alias("n_null"),
        F.when(compared, F.coalesce((F.col("_max") <= tol) & (F.col("n_null") == 0), F.lit(False))).alias("ok"),
    )


def function_verdict(cases: DataFrame, key: str = "fn") -> DataFrame:
    """Per function: cases, failures, worst error, mean of the case maxima, verdict state.

    With nothing compared the verdict is a soft pass if the reference produced anything.
    """
    rolled = cases.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum(F.when(F.col("ok") == F.lit(False), 1).otherwise(0)).alias("n_failed"),
        F.count(F.when(F.col("status") == "COMPARED", 1)).alias("n_compared"),
        F.count(F.when(F.col("n_ref") > 0, 1)).alias("n_with_ref"),
        F.max("max_err").alias("max_err"),
        F.avg("max_err").alias("mean_err"),
    )
    return rolled.withColumn("state", verdict_state()).withColumn(
        "passed", F.col("state").isin("PASS", "SKIPPED_PASS")
    )


def verdict_state() -> Column:
    """PASS / FAIL when something was compared, SKIPPED_PASS / SKIPPED_FAIL otherwise."""
    return (
        F.when((F.col("n_compared") > 0) & (F.col("n_failed") == 0), "PASS")
        .when(F.col("n_compared") > 0, "FAIL")
        .when(F.col("n_with_ref") > 0, "SKIPPED_PASS")
        .otherwise("SKIPPED_FAIL")
    )


def scenario_verdict(cases: DataFrame, runs: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """One verdict per row of ``runs``: ``(fn, case, ref_ran, cand_ran)``.

    Unlike :func:`function_verdict`, a length mismatch fails here.
    """
    seen = cases.select("fn", "case", "n_ref", "n_cand", "max_err", "mean_err", "n_null", "status")
    joined = runs.join(seen, ["fn", "case"], "left")
    n_ref, n_cand = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_ref", "n_cand"))
    ref_ran = F.coalesce(F.col("ref_ran"), F.lit(False))
    cand_ran = F.coalesce(F.col("cand_ran"), F.lit(False))
    state = (
        F.when(~ref_ran, "FAIL_NO_REFERENCE")
        .when((n_ref == 0) & ((~cand_ran) | (n_cand == 0)), "PASS_NO_OUTPUT")
        .when(~cand_ran, "SOFT_PASS")
        .when((n_ref != n_cand) | (F.col("status") != "COMPARED"), "FAIL_LENGTH")
        .when((F.col("max_err") <= tol) & (F.col("n_null") == 0), "PASS")
        .otherwise("FAIL")
    )
    judged = state.isin("PASS", "FAIL")
    return joined.select(
        F.concat_ws("::", F.upper("fn"), "case").alias("label"),
        state.alias("state"),
        state.isin("PASS", "PASS_NO_OUTPUT", "SOFT_PASS").alias("passed"),
        F.when(judged, F.col("max_err")).alias("max_err"),
        F.when(judged, F.col("mean_err")).alias("mean_err"),
    )


def unchanged_check(inputs: DataFrame, outputs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per case: did the output stay equal to the input at every position, bit for bit?"""
    both = align(inputs, outputs, keys)
    same = F.col("ref").eqNullSafe(F.col("cand")) & (F.col("n_ref") == F.col("n_cand"))
    by = (keys or KEYS)[:-1]
    return both.groupBy(*by).agg(F.bool_and(same).alias("unchanged"))


def coverage(refs: DataFrame, cands: DataFrame, key: str = "fn") -> DataFrame:
    """Names present on both sides, compared in lower case, sorted."""
    left = refs.select(F.lower(key).alias(key))
    right = cands.select(F.lower(key).alias(key))
    return left.intersect(right).orderBy(key)


def reference_health(expected: DataFrame, ref: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Expected cases for which the reference side produced nothing."""
    keys = keys or ["fn", "case"]
    ref = ref.filter(F.col("pos").isNotNull()) if "pos" in ref.columns else ref
    return lookup_join(expected.select(*keys).distinct(), ref.select(*keys).distinct(), keys, "left_anti")


def dual_run(
    df: DataFrame,
    ref_fn: Callable[[DataFrame], DataFrame],
    cand_fn: Callable[[DataFrame], DataFrame],
    tol: float = TOLERANCE,
) -> DataFrame:
    """Give one input to two implementations and return the verdict per function.

    The input is worked out once and stored below the shared folder; both implementations read what is stored.
    """
    df = checkpoint(df)
    return function_verdict(case_errors(align(ref_fn(df), cand_fn(df)), tol))


def tolerance_tier(err: Column) -> Column:
    """Band of an error: strict, early or fail; null stays null."""
    return (
        F.when(err.isNull(), F.lit(None).cast("string"))
        .when(err <= TOLERANCE, "strict")
        .when(err <= EARLY_TOLERANCE, "early")
        .otherwise("fail")
    )
