"""Scenario matrix over parts as routine instances, parameter rows from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.functions import checks
from sparkrecon.functions.text import dims_label as label_of
from sparkrecon.operators import catalogue as K
from sparkrecon.operators import scenarios as S
from sparkrecon.queries.registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

# Every part is one routine instance: a catalogue name or a name outside it.
NAMES = K.CATALOGUE + ["ZGJERC", "zgerc", "Dgemm", "unknown", "cher2", "sdsdot"]
ARGS = ["M", "N", "K", "LDA", "incx", "NRHS", "KL", "KB", "P", "Q", "WORK"]


def _sql_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


ROUTINES = f"""(SELECT p_partkey, list_extract({_sql_list(NAMES)}, (p_size % {len(NAMES)}) + 1) AS fn FROM part)"""
LEVELS = f"""(SELECT p_partkey, fn, CASE WHEN lower(fn) IN {_in(K.KNOWN_LEVEL_1)} THEN 1
    WHEN lower(fn) IN {_in(K.KNOWN_LEVEL_2)} THEN 2 ELSE 3 END AS level FROM {ROUTINES})"""


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else str(v)


def _scenario_values() -> str:
    rows = []
    for level, name, seed, dims, reals, flags, noop, bad in K.scenario_rows():
        label = ", ".join(f"{k}={v}" for k, v in sorted(dims.items()))
        cells = [level, name, seed, label, *[dims.get(k) for k in ("M", "N", "K", "LDA", "INCX")]]
        cells += [reals.get(k) for k in ("ALPHA", "BETA")] + [flags.get("TRANSA"), noop, bad]
        rows.append("(" + ", ".join(_value(c) for c in cells) + ")")
    return (
        "(SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(level, scenario, seed, label, m, n, k, lda, incx, "
        "alpha, beta, transa, expects_noop, invalid_input))"
    )


SCENARIOS = _scenario_values()


def routines(t):
    names = F.array(*[F.lit(n) for n in NAMES])
    return t.part.select("p_partkey", "p_retailprice", F.get(names, F.col("p_size") % len(NAMES)).alias("fn"))


@query("classify_level", f"SELECT * FROM {LEVELS}")
def classify_level(t):
    return S.classify_level(routines(t).select("p_partkey", "fn"))


@query(
    "expand_matrix",
    f"""SELECT p_partkey, fn, level, scenario, seed, label, expects_noop, invalid_input
        FROM {LEVELS} JOIN {SCENARIOS} USING (level)""",
)
def expand_matrix(t):
    leveled = S.classify_level(routines(t).select("p_partkey", "fn"))
    return S.expand_matrix(leveled, K.scenario_table(t.spark)).select(
        "p_partkey", "fn", "level", "scenario", "seed", label_of(F.col("dim_overrides")).alias("label"),
        "expects_noop", "invalid_input",
    )


def _dims_case(table: dict) -> str:
    return "CASE upper(arg) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 4 END"


@query(
    "assign_dims",
    f"""SELECT p_partkey, arg, {_dims_case(K.DIM_DEFAULTS)} AS base, {_dims_case(K.BENCH_DIM_DEFAULTS)} AS bench
        FROM (SELECT p_partkey, p_size, list_extract({_sql_list(ARGS)}, (p_size % {len(ARGS)}) + 1) AS arg, p_type FROM part) s
        WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size >= 10""",
)
def assign_dims(t):
    args = F.array(*[F.lit(a) for a in ARGS])
    declared = t.part.select(
        "p_partkey",
        F.get(args, F.col("p_size") % len(ARGS)).alias("arg"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "INTEGER").otherwise("DOUBLE PRECISION").alias("ftype"),
        F.when(F.col("p_size") < 10, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")).alias("dims"),
    )
    return S.assign_dims(declared).select("p_partkey", "arg", "base", "bench")


@query(
    "apply_overrides",
    f"""SELECT p_partkey, scenario, coalesce(m, 4) AS m, coalesce(n, 4) AS n, k, coalesce(lda, 4) AS lda, incx,
          coalesce(CAST(alpha AS DOUBLE), p_retailprice) AS alpha, coalesce(CAST(beta AS DOUBLE), CAST(0.5 AS DOUBLE)) AS beta, false AS has_da,
          coalesce(transa, 'N') AS transa, 'N' AS transb_or_n
        FROM {LEVELS} JOIN part USING (p_partkey) JOIN {SCENARIOS} USING (level)""",
)
def apply_overrides(t):
    """``K`` and ``INCX`` are absent from the base sizes, ``DA`` from the base scalars."""
    leveled = S.classify_level(routines(t))
    cases = S.expand_matrix(leveled, K.scenario_table(t.spark))
    base = cases.withColumns(
        {
            "dims": F.create_map(F.lit("M"), F.lit(4), F.lit("N"), F.lit(4), F.lit("LDA"), F.lit(4)),
            "floats": F.create_map(F.lit("ALPHA"), F.col("p_retailprice"), F.lit("BETA"), F.lit(0.5)),
            "chars": F.array(F.lit("TRANSA"), F.lit("SIDE")),
        }
    )
    merged = S.apply_overrides(base)

    def at(m: str, key: str):
        return F.try_element_at(F.col(m), F.lit(key))

    return merged.select(
        "p_partkey",
        "scenario",
        at("dims", "M").alias("m"),
        at("dims", "N").alias("n"),
        at("dims", "K").alias("k"),
        at("dims", "LDA").alias("lda"),
        at("dims", "INCX").alias("incx"),
        at("floats", "ALPHA").alias("alpha"),
        at("floats", "BETA").alias("beta"),
        F.map_contains_key("floats", "DA").alias("has_da"),
        at("chars", "TRANSA").alias("transa"),
        at("chars", "SIDE").alias("transb_or_n"),
    )


@query(
    "array_size",
    """SELECT p_partkey,
          CAST(CASE WHEN p_size < 10 THEN p_size * 4 WHEN p_size < 20 THEN p_size * 3 WHEN p_size < 30 THEN 7
               WHEN p_size < 40 THEN 4 * p_size ELSE 1 END AS BIGINT) AS n,
          CAST(greatest(CASE WHEN p_size < 10 THEN p_size * 4 WHEN p_size < 20 THEN p_size * 3 WHEN p_size < 30 THEN 7
               WHEN p_size < 40 THEN 4 * p_size ELSE 1 END, 1 + (p_size - 1) * 3) AS BIGINT) AS n_strided
        FROM part""",
)
def array_size(t):
    size = F.col("p_size")
    dims = (
        F.when(size < 10, F.array(F.lit("LDA"), F.lit("*")))
        .when(size < 20, F.array(F.lit(" lda "), F.lit("3")))
        .when(size < 30, F.array(F.lit("7")))
        .when(size < 40, F.array(F.lit("2*N"), F.lit("LDA")))
        .otherwise(F.array().cast("array<string>"))
    )
    assigned = F.create_map(F.lit("LDA"), size)
    least = S.strided_length(size, F.lit(-3)).cast("long")
    return t.part.select(
        "p_partkey",
        S.array_size(dims, assigned).alias("n"),
        S.array_size(dims, assigned, least=least).alias("n_strided"),
    )


P = S.HASH_PRIME


@query(
    "generate_dataset",
    f"""WITH specs AS (
          SELECT c_custkey, 0 AS arg_ord, 'scalar' AS kind, 1 AS size FROM customer
          UNION ALL SELECT c_custkey, 1, 'array', c_nationkey FROM customer
          UNION ALL SELECT c_custkey, 2, 'array', 2 * c_nationkey FROM customer),
        cells AS (SELECT c_custkey, arg_ord, kind, unnest(range(size)) AS pos FROM specs),
        mixed AS (SELECT *, (c_custkey % {P} * {S.HASH_A} + arg_ord * {S.HASH_B} + 1) % {P} AS h FROM cells),
        owned AS (SELECT *, h * (h % {S.HASH_FOLD} + 1) % {P} * {S.HASH_A} % {P} AS o FROM mixed),
        placed AS (SELECT *, (o * (pos % {P} % {S.HASH_FOLD} + 1) + pos % {P} * {S.HASH_C} + o) % {P} AS q FROM owned),
        squared AS (SELECT *, q * (q % {S.HASH_FOLD} + 1) % {P} * {S.HASH_A} % {P} AS g FROM placed)
        SELECT c_custkey, arg_ord, pos, CASE kind WHEN 'scalar' THEN 0.5::DOUBLE + 1.5::DOUBLE * (g::DOUBLE / {P}.0::DOUBLE)
               ELSE -1::DOUBLE + 2::DOUBLE * (g::DOUBLE / {P}.0::DOUBLE) END AS v FROM squared""",
)
def generate_dataset(t):
    spec = F.explode(
        F.array(
            F.struct(F.lit(0).alias("arg_ord"), F.lit("scalar").alias("kind"), F.lit(1).alias("size")),
            F.struct(F.lit(1).alias("arg_ord"), F.lit("array").alias("kind"), F.col("c_nationkey").alias("size")),
            F.struct(F.lit(2).alias("arg_ord"), F.lit("array").alias("kind"), (F.col("c_nationkey") * 2).alias("size")),
        )
    )
    specs = t.customer.select("c_custkey", F.col("c_custkey").alias("seed"), spec.alias("s")).select(
        "c_custkey", "seed", "s.*"
    )
    return S.generate_dataset(specs, ["c_custkey"], chunk=16)


# Arguments of every customer: name, declared type, dimensions.
INPUT_ARGS = [
    ("TRANS", "CHARACTER", []),
    ("N", "INTEGER", []),
    ("ALPHA", "DOUBLE PRECISION", []),
    ("A", "REAL", [" lda ", "*"]),
    ("INCX", "INTEGER", []),
    ("FLAG", "LOGICAL", []),
    ("IDX", "INTEGER", ["N"]),
    ("X", "DOUBLE PRECISION", ["N"]),
    ("B", "REAL", ["2*N", "3"]),
]


@query(
    "generate_inputs",
    f"""WITH args AS (
          SELECT c_custkey, c_nationkey AS n, unnest(range({len(INPUT_ARGS)})) AS arg_ord FROM customer),
        sized AS (SELECT *, list_extract({_sql_list([a for a, _, _ in INPUT_ARGS])}, arg_ord + 1) AS arg,
            list_extract(['character', 'integer', 'real', 'reals', 'integer', 'logical', 'none', 'reals', 'reals'], arg_ord + 1) AS kind,
            CASE arg_ord WHEN 3 THEN (n + 1) * 5 WHEN 7 THEN n WHEN 8 THEN 15 ELSE 1 END AS size FROM args),
        cells AS (SELECT *, unnest(CASE WHEN kind = 'reals' AND size = 0 THEN [NULL] ELSE range(size) END) AS pos FROM sized),
        mixed AS (SELECT *, (c_custkey % {P} * {S.HASH_A} + arg_ord * {S.HASH_B} + 1) % {P} AS h FROM cells),
        owned AS (SELECT *, h * (h % {S.HASH_FOLD} + 1) % {P} * {S.HASH_A} % {P} AS o FROM mixed),
        placed AS (SELECT *, (o * (pos % {P} % {S.HASH_FOLD} + 1) + pos % {P} * {S.HASH_C} + o) % {P} AS q FROM owned),
        drawn AS (SELECT *, (q * (q % {S.HASH_FOLD} + 1) % {P} * {S.HASH_A} % {P})::DOUBLE / {P}.0::DOUBLE AS u FROM placed)
        SELECT c_custkey, CAST(arg_ord AS INTEGER) AS arg_ord, arg, kind, CASE kind WHEN 'none' THEN NULL ELSE pos END AS pos,
          CASE WHEN kind = 'reals' THEN -1::DOUBLE + 2::DOUBLE * u
               WHEN kind = 'real' THEN CASE WHEN c_custkey % 5 = 0 THEN 0::DOUBLE ELSE 0.5::DOUBLE + 1.5::DOUBLE * u END END AS dbl,
          CASE arg WHEN 'N' THEN CAST(n AS INTEGER) WHEN 'INCX' THEN 4 END AS "int",
          CASE kind WHEN 'character' THEN 'N' END AS chr, CASE kind WHEN 'logical' THEN false END AS bool FROM drawn""",
)
def generate_inputs(t):
    """Sizes by nation; every fifth customer's scalar is set to zero by a scenario."""
    declared = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("arg_ord"),
                    F.lit(arg).alias("arg"),
                    F.lit(ftype).alias("ftype"),
                    F.array(*map(F.lit, dims)).cast("array<string>").alias("dims"),
                )
                for n, (arg, ftype, dims) in enumerate(INPUT_ARGS)
            ]
        )
    )
    nation = F.col("c_nationkey").cast("int")
    args = t.customer.select(
        "c_custkey",
        F.col("c_custkey").alias("seed"),
        F.create_map(F.lit("N"), nation, F.lit("LDA"), nation + 1).alias("assigned"),
        F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("ALPHA"), F.lit(0.0))).alias("floats"),
        declared.alias("d"),
    ).select("c_custkey", "seed", "assigned", "floats", "d.*")
    return S.generate_inputs(args, ["c_custkey"], star_fallback=5, chunk=16)


@query(
    "dims_label",
    "SELECT p_partkey, 'K=' || p_size || ', LDA=' || p_partkey || ', M=256' AS label FROM part",
)
def dims_label(t):
    dims = F.create_map(
        F.lit("M"), F.lit(256).cast("long"), F.lit("LDA"), F.col("p_partkey"), F.lit("K"), F.col("p_size").cast("long")
    )
    return t.part.select("p_partkey", label_of(dims).alias("label"))


# Orders as argument lists of a matrix product.
TA = "CASE o_orderstatus WHEN 'O' THEN 'n' WHEN 'F' THEN 'T' ELSE substr(o_orderpriority, 3, 1) END"
TB = "CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE 'N' END"
PARAMS = f"""(SELECT o_orderkey, {TA} AS ta, {TB} AS tb, o_custkey - 3 AS m, o_orderkey % 50 - 1 AS n,
    o_orderkey % 11 - 1 AS k, o_custkey + o_orderkey % 3 - 4 AS lda, o_orderkey % 13 AS ldb, o_custkey - 2 AS ldc,
    CASE o_orderstatus WHEN 'P' THEN 0.0 ELSE 2.0 END AS alpha,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 ELSE 0.0 END AS beta FROM orders)"""


def params(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        F.when(status == "O", "n").when(status == "F", "T").otherwise(F.substring(priority, 3, 1)).alias("ta"),
        F.when(cust % 7 == 0, "x").otherwise("N").alias("tb"),
        (cust - 3).alias("m"),
        (key % 50 - 1).alias("n"),
        (key % 11 - 1).alias("k"),
        (cust + key % 3 - 4).alias("lda"),
        (key % 13).alias("ldb"),
        (cust - 2).alias("ldc"),
        F.when(status == "P", 0.0).otherwise(2.0).alias("alpha"),
        F.when(F.substring(priority, 1, 1) == "1", 1.0).otherwise(0.0).alias("beta"),
    )


@query(
    "flag_eq",
    f"SELECT o_orderkey, upper(ta) = upper(tb) AS same FROM {PARAMS}",
)
def flag_eq(t):
    return params(t).select("o_orderkey", checks.flag_eq(F.col("ta"), F.col("tb")).alias("same"))


@query(
    "validate_params",
    f"""SELECT o_orderkey, CASE WHEN upper(ta) NOT IN ('N', 'T', 'C') THEN 1
          WHEN upper(tb) NOT IN ('N', 'T', 'C') THEN 2 WHEN m < 0 THEN 3 WHEN n < 0 THEN 4 WHEN k < 0 THEN 5
          WHEN lda < greatest(1, CASE WHEN upper(ta) = 'N' THEN m ELSE k END) THEN 8
          WHEN ldb < greatest(1, CASE WHEN upper(tb) = 'N' THEN k ELSE n END) THEN 10
          WHEN ldc < greatest(1, m) THEN 13 ELSE 0 END AS info FROM {PARAMS}""",
)
def validate_params(t):
    names = ("ta", "tb", "m", "n", "k", "lda", "ldb", "ldc")
    return params(t).select("o_orderkey", checks.validate_params(*[F.col(c) for c in names]).alias("info"))


@query(
    "quick_return",
    f"""SELECT o_orderkey, m = 0 OR n = 0 OR ((alpha = 0 OR k = 0) AND beta = 1) AS returns FROM {PARAMS}""",
)
def quick_return(t):
    names = ("m", "n", "k", "alpha", "beta")
    return params(t).select("o_orderkey", checks.quick_return(*[F.col(c) for c in names]).alias("returns"))
