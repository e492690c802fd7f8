"""Triage and comparison reports over results derived from lineitem, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.functions import text as X
from sparkrecon.functions import timing as M
from sparkrecon.operators import report as P
from sparkrecon.operators import triage as T
from sparkrecon.queries.registry import registrar, rounded

QUERIES: dict = {}
query = registrar(QUERIES)

# Accuracy results: function = supplier, strategy from the line number. Lines without tax
# were not measured. Errors follow the first order, so results are mixed over the whole table.
ACC = """(SELECT 'Fn_' || l_suppkey AS fn, l_linenumber % 3 + 1 AS strategy, min(l_orderkey) AS ord,
    count(*) % 3 > 0 AS passed, CASE WHEN min(l_orderkey) % 4 = 0 THEN NULL ELSE (min(l_orderkey) % 9) * 1e-10 END AS max_abs_error,
    CASE WHEN min(l_orderkey) % 4 = 0 THEN NULL ELSE (min(l_orderkey) % 9) * 1e-11 END AS mean_abs_error,
    count(*) AS num_test_cases, count(*) FILTER (l_quantity = 50) AS failed_cases
  FROM lineitem GROUP BY 1, 2)"""
# Timing results: function = user, strategy from the user number.
BENCH = """(SELECT 'fn_' || user_id AS fn, user_id % 3 + 1 AS strategy, min(event_id) AS ord,
    max(value) FILTER (event_type = 'click') AS base_ms, max(value) FILTER (event_type = 'view' AND value > 100) AS cand_ms,
    CASE WHEN max(value) > 250 THEN 'timed out' END AS error FROM events GROUP BY 1, 2)"""
SPEED = "CASE WHEN base_ms <> 0 AND cand_ms <> 0 THEN base_ms / cand_ms END"
# Functions given up: those with a large opening order.
EXHAUSTED = "(SELECT DISTINCT 'FN_' || c_custkey AS fn FROM customer WHERE c_nationkey < 3)"


def acc(t):
    unmeasured = F.min("l_orderkey") % 4 == 0
    return t.lineitem.groupBy(
        F.concat(F.lit("Fn_"), "l_suppkey").alias("fn"), (F.col("l_linenumber") % 3 + 1).alias("strategy")
    ).agg(
        F.min("l_orderkey").alias("ord"),
        (F.count(F.lit(1)) % 3 > 0).alias("passed"),
        F.when(~unmeasured, (F.min("l_orderkey") % 9) * 1e-10).alias("max_abs_error"),
        F.when(~unmeasured, (F.min("l_orderkey") % 9) * 1e-11).alias("mean_abs_error"),
        F.count(F.lit(1)).alias("num_test_cases"),
        F.count(F.when(F.col("l_quantity") == 50, 1)).alias("failed_cases"),
    )


def bench(t):
    kind, value = F.col("event_type"), F.col("value")
    return t.events.groupBy(
        F.concat(F.lit("fn_"), "user_id").alias("fn"), (F.col("user_id") % 3 + 1).cast("int").alias("strategy")
    ).agg(
        F.min("event_id").alias("ord"),
        F.max(F.when(kind == "click", value)).alias("base_ms"),
        F.max(F.when((kind == "view") & (value > 100), value)).alias("cand_ms"),
        F.when(F.max("value") > 250, "timed out").alias("error"),
    )


def timed(t):
    return bench(t).withColumn("speedup", M.speedup(F.col("base_ms"), F.col("cand_ms")))


def exhausted(t):
    return t.customer.filter(F.col("c_nationkey") < 3).select(F.concat(F.lit("FN_"), "c_custkey").alias("fn"))


FAILED_ACC = f"SELECT lower(fn) AS fn, ord FROM {ACC} WHERE NOT passed AND lower(fn) NOT IN (SELECT lower(fn) FROM {EXHAUSTED})"
FAILED_BENCH = f"""SELECT lower(fn) AS fn, ord FROM {BENCH} WHERE cand_ms IS NULL AND coalesce(error, '') = ''
    AND lower(fn) NOT IN (SELECT lower(fn) FROM {EXHAUSTED})"""


@query("failed_accuracy", FAILED_ACC)
def failed_accuracy(t):
    return T.failed_accuracy(acc(t), exhausted(t))


@query("failed_bench", FAILED_BENCH)
def failed_bench(t):
    return T.failed_bench(bench(t), exhausted(t))


@query(
    "retry_set",
    f"""SELECT fn, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY source, ord) AS rn FROM (
          SELECT *, 0 AS source FROM ({FAILED_ACC}) a UNION ALL SELECT *, 1 FROM ({FAILED_BENCH}) b) u) s WHERE rn = 1""",
)
def retry_set(t):
    return T.retry_set(acc(t), bench(t), exhausted(t))


@query(
    "attempt_ledger",
    """SELECT fn, event_type, value, CAST(least(attempt, 3) AS INTEGER) AS retries FROM (
         SELECT user_id AS fn, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS last,
           date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS attempt FROM events) s WHERE last = 1""",
)
def attempt_ledger(t):
    """Attempts of a user are its events; the attempt number is the day they fall on."""
    attempts = t.events.select(
        F.col("user_id").alias("fn"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("attempt"),
        "event_id",
        "event_type",
        "value",
    )
    return T.attempt_ledger(attempts, ["event_id", "event_type", "value"]).drop("event_id")


@query(
    "ms_per_call",
    "SELECT event_id, value * 1000 / nullif(user_id % 5 * 10, 0) AS ms FROM events",
)
def ms_per_call(t):
    return t.events.select(
        "event_id", M.ms_per_call(F.col("value") * 1000, F.col("user_id") % 5 * 10).alias("ms")
    )


@query(
    "speedup",
    """SELECT event_id, CASE WHEN base <> 0 AND cand <> 0 THEN base / cand END AS speedup
       FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 0.0 WHEN 'view' THEN NULL ELSE value END AS base,
               CAST(user_id % 10 AS DOUBLE) AS cand FROM events) s""",
)
def speedup(t):
    kind = F.col("event_type")
    base = F.when(kind == "click", 0.0).when(kind == "view", F.lit(None)).otherwise(F.col("value"))
    cand = (F.col("user_id") % 10).cast("double")
    return t.events.select("event_id", M.speedup(base, cand).alias("speedup"))


@query(
    "bench_summary",
    f"""SELECT fn, CASE WHEN coalesce(error, '') <> '' THEN 'Benchmark failed: ' || error
          WHEN base_ms <> 0 AND cand_ms <> 0 THEN printf('Baseline: %.3f ms  |  Candidate: %.3f ms  |  Candidate is %.2fx %s than Baseline',
            base_ms, cand_ms, {SPEED}, CASE WHEN {SPEED} >= 1 THEN 'faster' ELSE 'slower' END)
          WHEN base_ms <> 0 THEN printf('Baseline: %.3f ms  |  Candidate: N/A', base_ms)
          ELSE 'Incomplete benchmark data.' END AS summary FROM {BENCH}""",
)
def bench_summary(t):
    columns = (F.col("base_ms"), F.col("cand_ms"), F.col("error"))
    return bench(t).select("fn", M.bench_summary(*columns).alias("summary"))


# Runs per strategy, from order states; strategy 3 ended with an error.
RUNS = """(SELECT strategy, bool_or(o_orderstatus = 'F') AS build_ok, bool_and(o_totalprice > 1000) AS test_ok,
    CASE WHEN strategy = 3 THEN 'service down' END AS error, count(*) FILTER (strategy < 3) AS n_conversions
  FROM (SELECT *, o_custkey % 4 + 1 AS strategy FROM orders) o GROUP BY 1)"""


def runs(t):
    return (
        t.orders.withColumn("strategy", (F.col("o_custkey") % 4 + 1).cast("int"))
        .groupBy("strategy")
        .agg(
            F.bool_or(F.col("o_orderstatus") == "F").alias("build_ok"),
            F.bool_and(F.col("o_totalprice") > 1000).alias("test_ok"),
            F.max(F.when(F.col("strategy") == 3, "service down")).alias("error"),
            F.count(F.when(F.col("strategy") < 3, 1)).alias("n_conversions"),
        )
    )


STATE = """CASE WHEN count(*) = 0 THEN '—' WHEN coalesce(bool_and(passed) FILTER (max_abs_error IS NOT NULL), true)
    THEN '✅' ELSE '❌' END"""


@query(
    "strategy_overview",
    f"""SELECT CAST(r.strategy AS INTEGER) AS strategy, CASE WHEN broken THEN '❌' WHEN build_ok THEN '✅' ELSE '❌' END AS build,
          CASE WHEN broken THEN '❌' WHEN test_ok THEN '✅' ELSE '❌' END AS tests,
          CASE WHEN broken THEN '❌' ELSE coalesce(accuracy, '—') END AS accuracy,
          CASE WHEN NOT broken THEN max_err END AS max_err,
          CASE WHEN NOT broken THEN round(avg_speedup, 6) END AS avg_speedup
        FROM (SELECT *, coalesce(error, '') <> '' AND n_conversions = 0 AS broken FROM {RUNS}) r
        LEFT JOIN (SELECT strategy, {STATE} AS accuracy, max(max_abs_error) AS max_err FROM {ACC} GROUP BY 1) a USING (strategy)
        LEFT JOIN (SELECT strategy, avg({SPEED}) AS avg_speedup FROM {BENCH} GROUP BY 1) b USING (strategy)""",
)
def strategy_overview(t):
    return rounded(P.strategy_overview(runs(t), acc(t), timed(t)), 6, "avg_speedup")


@query("accuracy_state", f"SELECT fn, {STATE} AS state FROM {ACC} GROUP BY 1")
def accuracy_state(t):
    return acc(t).groupBy("fn").agg(P.accuracy_state().alias("state"))


@query(
    "function_summary",
    f"""SELECT upper('Fn_' || c.c_custkey) AS fn, CASE WHEN c_acctbal > 0 THEN '✅' ELSE '❌' END AS converted,
          CASE WHEN max_err IS NULL THEN '—' WHEN passed THEN '✅' ELSE '❌' END AS accuracy,
          CASE WHEN speedup IS NULL THEN '—' ELSE printf('%.2f×', speedup) END AS speedup
        FROM customer c
        LEFT JOIN (SELECT upper(fn) AS fn, bool_and(passed) AS passed, max(max_abs_error) AS max_err FROM {ACC} GROUP BY 1) a
          ON a.fn = upper('Fn_' || c.c_custkey)
        LEFT JOIN (SELECT upper(fn) AS fn, max({SPEED}) AS speedup FROM {BENCH} GROUP BY 1) b ON b.fn = upper('Fn_' || c.c_custkey)""",
)
def function_summary(t):
    conversions = t.customer.select(
        F.concat(F.lit("Fn_"), "c_custkey").alias("fn"), (F.col("c_acctbal") > 0).alias("success")
    )
    return P.function_summary(conversions, acc(t), timed(t))


def _side(i: int) -> str:
    return f"""bool_and(passed) FILTER (strategy = {i}) AS "{i}_passed", max(max_abs_error) FILTER (strategy = {i}) AS "{i}_max_err",
        max(num_test_cases / 4) FILTER (strategy = {i}) AS "{i}_speedup" """


@query("side_by_side", f"SELECT fn, {', '.join(_side(i) for i in (1, 2, 3))} FROM {ACC} GROUP BY 1")
def side_by_side(t):
    return P.side_by_side(acc(t).withColumn("speedup", F.col("num_test_cases") / 4))


@query(
    "flatten_messages",
    """SELECT fn, 'warning' AS kind, NULL AS round, unnest(w) AS message FROM
         (SELECT conv_id * 100 + turn AS fn, string_split(text, chr(10)) AS w FROM conversations WHERE role = 'user') a
       UNION ALL SELECT fn, 'compiler_error', CAST(unnest(range(1, len(e) + 1)) AS INTEGER), unnest(e) FROM
         (SELECT conv_id * 100 + turn AS fn, string_split(text, chr(10)) AS e FROM conversations WHERE role = 'assistant') b
       UNION ALL SELECT conv_id * 100 + turn, 'note', NULL, text FROM conversations WHERE role = 'system'""",
)
def flatten_messages(t):
    role, lines = F.col("role"), F.split("text", "\n")
    none = F.array().cast("array<string>")
    conversions = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("fn"),
        F.when(role == "user", lines).otherwise(none).alias("warnings"),
        F.when(role == "assistant", lines).otherwise(none).alias("compiler_errors"),
        F.when(role == "system", F.col("text")).alias("error"),
    )
    return P.flatten_messages(conversions)


E2 = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE printf('%.2e', {0}) END"


@query(
    "render_rows",
    f"""SELECT fn, strategy, '| `' || fn || '` | ' || num_test_cases || ' | ' || failed_cases || ' | ' || {E2.format('max_abs_error')} ||
          ' | ' || {E2.format('mean_abs_error')} || ' | ' || CASE WHEN passed THEN '✅' ELSE '❌' END || ' |' AS line FROM {ACC}""",
)
def render_rows(t):
    return P.render_rows(acc(t), P.accuracy_cells(), "md", ["fn", "strategy"])


@query(
    "render_rows_html",
    """SELECT page_id, '<tr><td>' || replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
         '''', '&#x27;') || '</td><td>' || replace(url, '&', '&amp;') || '</td></tr>' AS line FROM pages""",
)
def render_rows_html(t):
    return P.render_rows(t.pages, [F.col("html"), F.col("url")], "html", ["page_id"])


@query(
    "run_stamp",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey % 86400) END AS stamp FROM orders""",
)
def run_stamp(t):
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400), "yyyyMMdd_HHmmss")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("report-"), stamp)).otherwise(
        F.concat(F.lit("report_"), stamp)
    )
    return t.orders.select("o_orderkey", X.run_stamp(name).alias("stamp"))


@query(
    "error_isolation",
    f"""SELECT fn, CAST(strategy AS INTEGER) AS strategy, passed, true AS build_ok, true AS test_ok, NULL AS error FROM {ACC} WHERE strategy < 3
        UNION ALL SELECT NULL, CAST(strategy AS INTEGER), NULL, false, false, error FROM {RUNS} WHERE error IS NOT NULL""",
)
def error_isolation(t):
    done = acc(t).filter(F.col("strategy") < 3).select(
        "fn", "strategy", "passed", F.lit(True).alias("build_ok"), F.lit(True).alias("test_ok")
    )
    failures = runs(t).filter(F.col("error").isNotNull()).select("strategy", "error")
    return T.isolate_errors(done, failures)
