"""Scenario matrix, sizes, overrides, generated inputs, parameter checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkrecon.functions.checks import quick_return, validate_params
from sparkrecon.operators import catalogue as K
from sparkrecon.operators import scenarios as S
from sparkrecon.operators.selection import parse_selection


def test_matrix_has_663_cases(spark):
    assert (len(K.LEVEL_1), len(K.LEVEL_2), len(K.LEVEL_3)) == (15, 16, 6)
    fns = spark.createDataFrame([(n,) for n in K.CATALOGUE], "fn string")
    cases = S.expand_matrix(S.classify_level(fns), K.scenario_table(spark))
    assert cases.count() == 663
    per_level = {r["level"]: r["n"] for r in K.scenario_table(spark).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert per_level == {1: 15, 2: 18, 3: 25}


def test_levels_from_a_table(spark, rows):
    fns = spark.createDataFrame([("A",), ("b",), ("zgerc",)], "fn string")
    levels = spark.createDataFrame([("a", 1), ("b", 2)], "name string, level int")
    assert rows(S.classify_level(fns, levels=levels), "fn", "level") == [("A", 1), ("b", 2), ("zgerc", 3)]
    assert rows(S.classify_level(fns)) == [("A", 3), ("b", 3), ("zgerc", 3)]


def test_sizes(spark):
    dims = F.create_map(F.lit("LDA"), F.lit(6))
    row = spark.range(1).select(
        S.array_size(F.array(F.lit("lda"), F.lit("*")), dims).alias("star"),
        S.array_size(F.array(F.lit("N+1")), dims).alias("unknown"),
        S.array_size(F.array().cast("array<string>"), dims).alias("scalar"),
        S.array_size(F.array(F.lit("*")), dims, F.lit(9)).alias("fallback"),
        S.strided_length(F.lit(4), F.lit(-3)).alias("span"),
        S.default_dim(F.lit("nrhs")).alias("base"),
        S.default_dim(F.lit("nrhs"), bench=True).alias("bench"),
        S.default_dim(F.lit("zz"), bench=True).alias("other"),
    ).first()
    assert row.asDict() == {
        "star": 24, "unknown": 4, "scalar": 1, "fallback": 9, "span": 10, "base": 2, "bench": 64, "other": 4
    }


def test_override_rules(spark):
    df = spark.createDataFrame(
        [({"M": 4}, {"ALPHA": 1.5}, ["TRANSA", "SIDE"], {"M": 0, "INCX": 2}, {"ALPHA": 0.0, "DA": 9.0}, {"TRANSA": "T"})],
        "dims map<string,int>, floats map<string,double>, chars array<string>, dim_overrides map<string,int>, "
        "float_overrides map<string,double>, char_overrides map<string,string>",
    )
    row = S.apply_overrides(df).first()
    assert row["dims"] == {"M": 0, "INCX": 2}
    assert row["floats"] == {"ALPHA": 0.0}
    assert row["chars"] == {"TRANSA": "T", "SIDE": "N"}


def test_generated_inputs(spark):
    specs = spark.createDataFrame(
        [("f", 3, 0, "scalar", 1), ("f", 3, 1, "array", 1000), ("f", 3, 2, "array", 0)],
        "fn string, seed long, arg_ord int, kind string, size int",
    )
    first = S.generate_dataset(specs, ["fn"], chunk=64)
    again = S.generate_dataset(specs, ["fn"], chunk=1000)
    assert first.count() == 1001
    assert first.exceptAll(again).count() == 0
    stats = first.groupBy("arg_ord").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.countDistinct("v").alias("n")
    ).orderBy("arg_ord").collect()
    assert 0.5 <= stats[0]["lo"] <= 2.0
    assert -1 <= stats[1]["lo"] < -0.9 and 0.9 < stats[1]["hi"] <= 1 and abs(stats[1]["mean"]) < 0.1
    assert stats[1]["n"] > 990
    other = S.generate_dataset(specs.withColumn("seed", F.lit(4).cast("long")), ["fn"])
    assert other.intersect(first).count() == 0


PARAM_ROWS = [
    ("N", "N", 4, 4, 4, 4, 4, 4, 0), ("X", "Y", -1, 4, 4, 4, 4, 4, 1), ("t", "Y", -1, 4, 4, 4, 4, 4, 2),
    ("C", "T", -1, -1, 4, 4, 4, 4, 3), ("N", "N", 4, -1, -1, 4, 4, 4, 4), ("N", "N", 4, 4, -1, 4, 4, 4, 5),
    ("N", "N", 4, 4, 4, 3, 1, 4, 8), ("T", "N", 9, 4, 4, 4, 4, 9, 0), ("N", "N", 4, 4, 4, 4, 3, 3, 10),
    ("N", "T", 4, 2, 4, 4, 2, 4, 0), ("N", "N", 4, 4, 4, 4, 4, 3, 13), ("N", "N", 0, 0, 0, 0, 1, 1, 8),
]


def test_validate_params(spark):
    df = spark.createDataFrame(PARAM_ROWS, "ta string, tb string, m int, n int, k int, lda int, ldb int, ldc int, want int")
    code = validate_params(*[F.col(c) for c in ("ta", "tb", "m", "n", "k", "lda", "ldb", "ldc")])
    assert df.filter(code != F.col("want")).count() == 0


def test_quick_return(spark):
    data = [
        (0, 4, 4, 1.0, 0.0, True), (4, 0, 4, 1.0, 0.0, True), (4, 4, 0, 1.0, 1.0, True), (4, 4, 4, 0.0, 1.0, True),
        (4, 4, 0, 1.0, 0.0, False), (4, 4, 4, 0.0, 0.0, False), (4, 4, 4, 1.0, 1.0, False),
    ]
    df = spark.createDataFrame(data, "m int, n int, k int, alpha double, beta double, want boolean")
    got = quick_return(*[F.col(c) for c in ("m", "n", "k", "alpha", "beta")])
    assert df.filter(got != F.col("want")).count() == 0


def test_parse_selection(spark):
    data = [("3", 3), (" 99 ", 37), ("0", 1), ("-4", 1), ("Dgemm, ,DDOT,", 2), ("", 0), ("3x", 1)]
    df = spark.createDataFrame(data, "raw string, n int")
    assert df.filter(F.size(parse_selection(F.col("raw"))) != F.col("n")).count() == 0


def test_inputs_of_every_type(spark):
    sizes = {"N": 3, "LDA": 2}
    declared = [
        ("TRANS", "CHARACTER", []), ("n", "INTEGER", []), ("K", "INTEGER", []), ("ALPHA", "REAL", []),
        ("A", "DOUBLE PRECISION", ["LDA", "*"]), ("X", "REAL", ["N"]), ("E", "REAL", ["0"]), ("UP", "LOGICAL", []),
        ("IDX", "INTEGER", ["N"]), ("C", "CHARACTER", ["N"]), ("BETA", "REAL", []),
    ]
    shape = "fn string, seed long, arg_ord int, arg string, ftype string, dims array<string>, assigned map<string,int>, floats map<string,double>"
    rows = [("f", 9, n, *d, sizes, {"BETA": 0.25, "ZETA": 1.0}) for n, d in enumerate(declared)]
    args = spark.createDataFrame(rows, shape)
    got = S.generate_inputs(args, ["fn"], star_fallback=5, chunk=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["arg"], []).append(r)
    # no argument is lost
    assert {a for a, *_ in declared} == set(by)
    assert [(by[a][0]["kind"], by[a][0]["int"]) for a in ("n", "K")] == [("integer", 3), ("integer", 4)]
    assert (by["TRANS"][0]["chr"], by["UP"][0]["bool"], by["BETA"][0]["dbl"]) == ("N", False, 0.25)
    assert 0.5 <= by["ALPHA"][0]["dbl"] < 2.0
    assert sorted(r["pos"] for r in by["A"]) == list(range(10)) and all(-1 <= r["dbl"] < 1 for r in by["A"])
    assert len(by["X"]) == 3 and len({r["dbl"] for r in by["X"] + by["A"]}) == 13
    assert [(r["kind"], r["pos"], r["dbl"]) for r in by["E"]] == [("reals", None, None)]
    assert [(r["kind"], r["pos"], r["int"], r["chr"]) for r in by["IDX"] + by["C"]] == [("none", None, None, None)] * 2
    for r in got:
        assert sum(r[c] is not None for c in ("dbl", "int", "chr", "bool")) == (r["pos"] is not None)

    numbers = S.real_values(S.generate_inputs(args, ["fn"], 5), ["fn"]).orderBy("arg_ord", "pos").collect()
    assert [r["arg_ord"] for r in numbers] == [3] + [4] * 10 + [5] * 3 + [10]
    again = {(r["arg_ord"], r["pos"]): r["dbl"] for r in got}
    assert all(again[r["arg_ord"], r["pos"]] == r["v"] for r in numbers)
    for bad in ("COMPLEX", None):
        with pytest.raises(Exception, match="no values for type"):
            S.generate_inputs(args.withColumn("ftype", F.lit(bad).cast("string")), ["fn"]).collect()


def test_real_arguments_go_to_value_files(spark):
    from sparkrecon.plans.lineage import scratch_path
    from sparkrecon.sources import text as IO

    rows = [(f, 5, n, a, k, d, {"N": 4}) for f in "fg" for n, (a, k, d) in enumerate([("X", "REAL", ["N"]), ("N", "INTEGER", []), ("B", "REAL", [])])]
    args = spark.createDataFrame(rows, "fn string, seed long, arg_ord int, arg string, ftype string, dims array<string>, assigned map<string,int>")
    numbers = S.real_values(S.generate_inputs(args, ["fn"]), ["fn"])
    path = scratch_path(spark, "inputs")
    IO.write_values(numbers, path, ["fn"])
    back = IO.read_values(spark, path, "*.txt").groupBy(F.regexp_extract("file", "fn=([^/]+)", 1).alias("fn"))
    got = back.agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("r")).orderBy("fn").collect()
    want = [[r["v"] for r in numbers.filter(F.col("fn") == f).orderBy("arg_ord", "pos").collect()] for f in "fg"]
    assert [[c["v"] for c in r["r"]] for r in got] == want and len(want[0]) == 5


@pytest.mark.parametrize("kind, size, said", [("matrix", 3, "unknown kind"), (None, 3, "unknown kind"), ("array", None, "without a size")])
def test_specs_that_say_too_little(spark, kind, size, said):
    specs = spark.createDataFrame([("f", 1, 0, kind, size)], "fn string, seed long, arg_ord int, kind string, size long")
    with pytest.raises(Exception, match=said):
        S.generate_dataset(specs, ["fn"]).collect()
