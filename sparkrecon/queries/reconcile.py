"""Reconciliation of two computations of the same prices, with disagreements by nation.

A function is a supplier, a case is a line number, a position is an order. The candidate
disagrees in ways chosen by the supplier's nation, so that every verdict is reached.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.operators import reconcile as R
from sparkrecon.queries.registry import registrar, rounded

QUERIES: dict = {}
query = registrar(QUERIES)

BASE = """(SELECT 'supplier_' || l_suppkey AS fn, 'line_' || l_linenumber AS "case", l_orderkey AS pos,
    s_nationkey AS nation, l_linenumber AS line, max(l_extendedprice) AS v, max(l_tax) AS tax,
    max(l_discount) AS disc FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4, 5)"""
# Nation 13 has a void reference at line 2, nation 14 a void candidate at line 3 and nation 12 null values.
REF = f"""(SELECT fn, "case", pos, v FROM {BASE} WHERE nation <> 8 AND NOT (nation = 9 AND line <= 3)
    AND NOT (nation = 13 AND line = 2))"""
CAND = f"""(SELECT fn, "case", pos, CASE WHEN nation < 5 AND line = 7 THEN v + 1e-6
      WHEN nation = 5 AND line = 1 AND tax = 0.08 THEN CAST('NaN' AS DOUBLE)
      WHEN nation = 10 THEN v + 4e-11 WHEN nation = 11 AND line = 2 THEN v + 1e-3
      WHEN nation = 12 AND (line = 1 OR line = 2 AND tax = 0.08) THEN NULL ELSE v END AS v
    FROM {BASE} WHERE nation <> 7 AND NOT (nation = 9 AND line <= 3) AND NOT (nation = 6 AND disc = 0.1)
    AND NOT (nation = 14 AND line = 3))"""
ALIGNED = f"""(SELECT coalesce(r.fn, c.fn) AS fn, coalesce(r."case", c."case") AS "case", coalesce(r.pos, c.pos) AS pos,
    r.v AS ref, c.v AS cand, CAST(r.fn IS NOT NULL AS BIGINT) AS n_ref, CAST(c.fn IS NOT NULL AS BIGINT) AS n_cand
    FROM {REF} r FULL JOIN {CAND} c ON r.fn = c.fn AND r."case" = c."case" AND r.pos = c.pos)"""
CASES = f"""(SELECT fn, "case", n_ref, n_cand, status,
    CASE WHEN status = 'COMPARED' THEN mx END AS max_err, CASE WHEN status = 'COMPARED' THEN mn END AS mean_err,
    CASE WHEN status = 'COMPARED' THEN n_null END AS n_null,
    CASE WHEN status = 'COMPARED' THEN coalesce(mx <= 1e-10, false) AND n_null = 0 END AS ok
  FROM (SELECT *, CASE WHEN n_ref = 0 THEN 'NO_REFERENCE' WHEN n_cand = 0 THEN 'NO_CANDIDATE'
          WHEN n_ref <> n_cand OR n_pair <> n_ref THEN 'LENGTH_MISMATCH' ELSE 'COMPARED' END AS status
        FROM (SELECT fn, "case", CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_cand) AS BIGINT) AS n_cand,
                sum(n_ref * n_cand) AS n_pair,
                CAST(count(*) FILTER (n_ref > 0 AND n_cand > 0 AND abs(cand - ref) IS NULL) AS BIGINT) AS n_null, max(abs(cand - ref)) AS mx, avg(abs(cand - ref)) AS mn
              FROM {ALIGNED} GROUP BY 1, 2) s) t)"""
FUNCTIONS = f"""(SELECT fn, n_cases, n_failed, n_compared, n_with_ref, max_err, mean_err,
    CASE WHEN n_compared > 0 AND n_failed = 0 THEN 'PASS' WHEN n_compared > 0 THEN 'FAIL'
         WHEN n_with_ref > 0 THEN 'SKIPPED_PASS' ELSE 'SKIPPED_FAIL' END AS state
  FROM (SELECT fn, count(*) AS n_cases, count(*) FILTER (ok = false) AS n_failed,
          count(*) FILTER (status = 'COMPARED') AS n_compared, count(*) FILTER (n_ref > 0) AS n_with_ref,
          max(max_err) AS max_err, avg(max_err) AS mean_err FROM {CASES} GROUP BY 1) s)"""
RUNS = """(SELECT DISTINCT 'supplier_' || l_suppkey AS fn, 'line_' || l_linenumber AS "case",
    s_nationkey <> 8 AS ref_ran, s_nationkey <> 7 AS cand_ran
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def lines(t):
    """Prices with the supplier's nation, the shared input of both computations."""
    priced = t.lineitem.groupBy("l_suppkey", "l_linenumber", "l_orderkey").agg(
        F.max("l_extendedprice").alias("v"), F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc")
    )
    return priced.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("supplier_"), F.col("l_suppkey")).alias("fn"),
        F.concat(F.lit("line_"), F.col("l_linenumber")).alias("case"),
        F.col("l_orderkey").alias("pos"),
        F.col("s_nationkey").alias("nation"),
        F.col("l_linenumber").alias("line"),
        "v",
        "tax",
        "disc",
    )


def void(rows, here):
    """Rows of the chosen cases without position and value: the case's output is void."""
    return rows.select(
        "fn", "case", F.when(~here, F.col("pos")).alias("pos"), F.when(~here, F.col("v")).alias("v")
    )


def reference(base):
    kept = (F.col("nation") != 8) & ~((F.col("nation") == 9) & (F.col("line") <= 3))
    return void(base.filter(kept), (F.col("nation") == 13) & (F.col("line") == 2))


def candidate(base):
    nation, line, v = F.col("nation"), F.col("line"), F.col("v")
    kept = (
        (nation != 7)
        & ~((nation == 9) & (line <= 3))
        & ~((nation == 6) & (F.col("disc") == 0.1))
    )
    value = (
        F.when((nation < 5) & (line == 7), v + 1e-6)
        .when((nation == 5) & (line == 1) & (F.col("tax") == 0.08), F.lit(float("nan")))
        .when(nation == 10, v + 4e-11)
        .when((nation == 11) & (line == 2), v + 1e-3)
        .when((nation == 12) & ((line == 1) | ((line == 2) & (F.col("tax") == 0.08))), F.lit(None))
        .otherwise(v)
    )
    return void(base.filter(kept).withColumn("v", value), (nation == 14) & (line == 3))


def aligned(t):
    base = lines(t)
    return R.align(reference(base), candidate(base))


def cases(t):
    return R.case_errors(aligned(t))


def runs(t):
    return (
        t.lineitem.select("l_suppkey", "l_linenumber")
        .distinct()
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("supplier_"), F.col("l_suppkey")).alias("fn"),
            F.concat(F.lit("line_"), F.col("l_linenumber")).alias("case"),
            (F.col("s_nationkey") != 8).alias("ref_ran"),
            (F.col("s_nationkey") != 7).alias("cand_ran"),
        )
    )


@query("align", f"SELECT * FROM {ALIGNED}")
def align(t):
    return aligned(t)


@query(
    "case_errors",
    f'SELECT fn, "case", n_ref, n_cand, status, max_err, round(mean_err, 9) AS mean_err, n_null, ok FROM {CASES}',
)
def case_errors(t):
    return rounded(cases(t), 9, "mean_err")


@query(
    "function_verdict",
    f"""SELECT fn, n_cases, n_failed, n_compared, n_with_ref, max_err, round(mean_err, 9) AS mean_err, state,
          state IN ('PASS', 'SKIPPED_PASS') AS passed FROM {FUNCTIONS}""",
)
def function_verdict(t):
    return rounded(R.function_verdict(cases(t)), 9, "mean_err")


@query("verdict_state", f"SELECT state, count(*) AS n, CAST(sum(n_cases) AS BIGINT) AS n_cases FROM {FUNCTIONS} GROUP BY 1")
def verdict_state(t):
    verdicts = R.function_verdict(cases(t))
    return verdicts.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("n_cases").alias("n_cases"))


@query(
    "scenario_verdict",
    f"""SELECT label, state, state IN ('PASS', 'PASS_NO_OUTPUT', 'SOFT_PASS') AS passed,
          CASE WHEN state IN ('PASS', 'FAIL') THEN max_err END AS max_err,
          CASE WHEN state IN ('PASS', 'FAIL') THEN round(mean_err, 9) END AS mean_err
        FROM (SELECT upper(r.fn) || '::' || r."case" AS label, max_err, mean_err,
                CASE WHEN NOT ref_ran THEN 'FAIL_NO_REFERENCE'
                     WHEN coalesce(n_ref, 0) = 0 AND (NOT cand_ran OR coalesce(n_cand, 0) = 0) THEN 'PASS_NO_OUTPUT'
                     WHEN NOT cand_ran THEN 'SOFT_PASS'
                     WHEN coalesce(n_ref, 0) <> coalesce(n_cand, 0) OR status <> 'COMPARED' THEN 'FAIL_LENGTH'
                     WHEN max_err <= 1e-10 AND n_null = 0 THEN 'PASS' ELSE 'FAIL' END AS state
              FROM {RUNS} r LEFT JOIN {CASES} c ON r.fn = c.fn AND r."case" = c."case") s""",
)
def scenario_verdict(t):
    return rounded(R.scenario_verdict(cases(t), runs(t)), 9, "mean_err")


@query(
    "unchanged_check",
    f"""SELECT fn, "case", bool_and(ref IS NOT DISTINCT FROM cand AND n_ref = n_cand) AS unchanged
        FROM {ALIGNED} GROUP BY 1, 2""",
)
def unchanged_check(t):
    base = lines(t)
    return R.unchanged_check(reference(base), candidate(base))


@query("coverage", f"SELECT DISTINCT fn FROM {REF} WHERE fn IN (SELECT fn FROM {CAND}) ORDER BY fn")
def coverage(t):
    base = lines(t)
    return R.coverage(reference(base), candidate(base))


@query(
    "reference_health",
    f"""SELECT fn, "case" FROM {RUNS} EXCEPT SELECT fn, "case" FROM {REF}""",
)
def reference_health(t):
    return R.reference_health(runs(t), reference(lines(t)))


@query(
    "dual_run",
    f"""SELECT fn, n_cases, n_failed, n_compared, n_with_ref, max_err, round(mean_err, 9) AS mean_err, state,
          state IN ('PASS', 'SKIPPED_PASS') AS passed FROM {FUNCTIONS}""",
)
def dual_run(t):
    return rounded(R.dual_run(lines(t), reference, candidate), 9, "mean_err")


@query(
    "tolerance_tier",
    f"""SELECT fn, "case", CASE WHEN max_err IS NULL THEN NULL WHEN max_err <= 1e-10 THEN 'strict'
          WHEN max_err <= 1e-6 THEN 'early' ELSE 'fail' END AS tier FROM {CASES}""",
)
def tolerance_tier(t):
    return cases(t).select("fn", "case", R.tolerance_tier(F.col("max_err")).alias("tier"))
