"""Comparison reports: roll-ups per strategy, summaries per function, rendered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions.text import escape_html
from sparkrecon.functions.timing import measured

# Marks in reports.
YES, NO, NONE = "✅", "❌", "—"
NOT_AVAILABLE = "N/A"

# Strategies that are compared.
STRATEGIES = [1, 2, 3]


def mark(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), YES).otherwise(NO)


def accuracy_state() -> Column:
    """Aggregate: no rows, or whether every measured row passed; true when none was measured."""
    measured_pass = F.bool_and(F.when(F.col("max_abs_error").isNotNull(), F.col("passed")))
    return (
        F.when(F.count("passed") == 0, NONE)
        .when(F.coalesce(measured_pass, F.lit(True)), YES)
        .otherwise(NO)
    )


def strategy_overview(runs: DataFrame, acc: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per strategy: build, tests, accuracy, worst error, mean speedup.

    ``runs`` is ``(strategy, build_ok, test_ok, error, n_conversions)``. A strategy that ended
    with an error and no conversions shows as failed throughout.
    """
    accuracy = acc.groupBy("strategy").agg(
        accuracy_state().alias("accuracy"), F.max("max_abs_error").alias("max_err")
    )
    timing = bench.groupBy("strategy").agg(F.avg(measured(F.col("speedup"))).alias("avg_speedup"))
    broken = (F.coalesce("error", F.lit("")) != "") & (F.coalesce("n_conversions", F.lit(0)) == 0)
    return (
        runs.join(accuracy, "strategy", "left")
        .join(timing, "strategy", "left")
        .select(
            "strategy",
            F.when(broken, NO).otherwise(mark(F.col("build_ok"))).alias("build"),
            F.when(broken, NO).otherwise(mark(F.col("test_ok"))).alias("tests"),
            F.when(broken, NO).otherwise(F.coalesce("accuracy", F.lit(NONE))).alias("accuracy"),
            F.when(~broken, F.col("max_err")).alias("max_err"),
            F.when(~broken, F.col("avg_speedup")).alias("avg_speedup"),
        )
    )


def function_summary(conversions: DataFrame, acc: DataFrame, bench: DataFrame) -> DataFrame:
    """Conversions with their accuracy mark and speedup, matched on the upper-case name."""
    checks = acc.select(F.upper("fn").alias("fn"), "passed", "max_abs_error").groupBy("fn").agg(
        F.bool_and("passed").alias("passed"), F.max("max_abs_error").alias("max_abs_error")
    )
    times = bench.select(F.upper("fn").alias("fn"), "speedup").groupBy("fn").agg(F.max("speedup").alias("speedup"))
    return (
        conversions.select(F.upper("fn").alias("fn"), "success")
        .join(checks, "fn", "left")
        .join(times, "fn", "left")
        .select(
            "fn",
            mark(F.col("success")).alias("converted"),
            F.when(F.col("max_abs_error").isNotNull(), mark(F.col("passed"))).otherwise(NONE).alias("accuracy"),
            times_text(F.col("speedup"), NONE).alias("speedup"),
        )
    )


def side_by_side(results: DataFrame, strategies: list[int] | None = None) -> DataFrame:
    """One row per function, one group of columns per strategy."""
    return (
        results.groupBy("fn")
        .pivot("strategy", strategies or STRATEGIES)
        .agg(
            F.bool_and("passed").alias("passed"),
            F.max("max_abs_error").alias("max_err"),
            F.max("speedup").alias("speedup"),
        )
    )


def flatten_messages(conversions: DataFrame) -> DataFrame:
    """``(fn, kind, round, message)``: warnings, numbered compiler errors, notes if present."""
    note = F.when(
        F.coalesce("error", F.lit("")) != "",
        F.array(_message("note", F.lit(None).cast("int"), F.col("error"))),
    ).otherwise(F.expr("array()"))
    nothing = F.array().cast("array<string>")  # a null list must not lose the others
    warnings = F.transform(F.coalesce("warnings", nothing), lambda w: _message("warning", F.lit(None).cast("int"), w))
    errors = F.transform(F.coalesce("compiler_errors", nothing), lambda e, n: _message("compiler_error", n + 1, e))
    return conversions.select("fn", F.explode(F.concat(warnings, errors, note)).alias("_m")).select(
        "fn", "_m.kind", "_m.round", "_m.message"
    )


def _message(kind: str, number: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("round"), text.alias("message"))


# --- rendering ------------------------------------------------------------------------


def error_text(c: Column, absent: str = NOT_AVAILABLE) -> Column:
    return _formatted("%.2e", c, absent)


def ms_text(c: Column, absent: str = NOT_AVAILABLE) -> Column:
    return _formatted("%.3f", measured(c), absent)


def times_text(c: Column, absent: str = NOT_AVAILABLE) -> Column:
    return _formatted("%.2f×", measured(c), absent)


def _formatted(pattern: str, c: Column, absent: str) -> Column:
    return F.when(c.isNull(), F.lit(absent)).otherwise(F.format_string(pattern, c))


def render_row(cells: list[Column], fmt: str = "md") -> Column:
    """One table row as Markdown or, with cells escaped, as HTML."""
    if fmt == "md":
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    if fmt == "html":
        joined = F.concat_ws("", *[F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>")) for c in cells])
        return F.concat(F.lit("<tr>"), joined, F.lit("</tr>"))
    raise ValueError(f"unknown format: {fmt}")


def accuracy_cells() -> list[Column]:
    """Cells of an accuracy table row."""
    return [
        F.concat(F.lit("`"), F.col("fn"), F.lit("`")),
        F.col("num_test_cases").cast("string"),
        F.col("failed_cases").cast("string"),
        error_text(F.col("max_abs_error")),
        error_text(F.col("mean_abs_error")),
        mark(F.col("passed")),
    ]


def timing_cells() -> list[Column]:
    """Cells of a timing table row."""
    return [
        F.concat(F.lit("`"), F.col("fn"), F.lit("`")),
        ms_text(F.col("base_ms")),
        ms_text(F.col("cand_ms")),
        times_text(F.col("speedup")),
    ]


def render_rows(df: DataFrame, cells: list[Column], fmt: str = "md", keep: list[str] | None = None) -> DataFrame:
    """``(keep, line)`` with one rendered line per row."""
    return df.select(*(keep or []), render_row(cells, fmt).alias("line"))
