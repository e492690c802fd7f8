"""Every verdict state on inline outputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkrecon.operators import reconcile as R

SCHEMA = "fn string, case string, pos long, v double"
NAN = float("nan")


@pytest.fixture(scope="module")
def sides(spark):
    ref = [
        ("exact", "a", 0, 1.0), ("exact", "a", 1, 2.0), ("exact", "b", 0, 3.0),
        ("close", "a", 0, 1.0), ("close", "b", 0, 1.0),
        ("off", "a", 0, 1.0), ("off", "b", 0, 1.0),
        ("nan", "a", 0, 1.0), ("nan", "a", 1, 1.0),
        ("short", "a", 0, 1.0), ("short", "a", 1, 1.0),
        ("shifted", "a", 0, 1.0),
        ("nocand", "a", 0, 1.0),
        ("twice", "a", 0, 1.0), ("twice", "a", 0, 1.0),
    ]
    cand = [
        ("exact", "a", 0, 1.0), ("exact", "a", 1, 2.0), ("exact", "b", 0, 3.0),
        ("close", "a", 0, 1.0 + 5e-11), ("close", "b", 0, 1.0),
        ("off", "a", 0, 1.0 + 1e-7), ("off", "b", 0, 1.0),
        ("nan", "a", 0, NAN), ("nan", "a", 1, 1.0),
        ("short", "a", 0, 1.0),
        ("shifted", "a", 1, 1.0),
        ("noref", "a", 0, 1.0),
        ("twice", "a", 0, 1.0), ("twice", "a", 1, 1.0),
    ]
    return spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(cand, SCHEMA)


@pytest.fixture(scope="module")
def cases(sides):
    return R.case_errors(R.align(*sides)).cache()


def test_case_status(cases):
    status = {(r["fn"], r["case"]): r["status"] for r in cases.collect()}
    assert status[("exact", "a")] == status[("nan", "a")] == "COMPARED"
    assert status[("short", "a")] == status[("shifted", "a")] == status[("twice", "a")] == "LENGTH_MISMATCH"
    assert status[("nocand", "a")] == "NO_CANDIDATE"
    assert status[("noref", "a")] == "NO_REFERENCE"


def test_function_states(cases):
    got = {r["fn"]: r for r in R.function_verdict(cases).collect()}
    assert {f: r["state"] for f, r in got.items()} == {
        "exact": "PASS", "close": "PASS", "off": "FAIL", "nan": "FAIL", "short": "SKIPPED_PASS",
        "shifted": "SKIPPED_PASS", "nocand": "SKIPPED_PASS", "noref": "SKIPPED_FAIL", "twice": "SKIPPED_PASS",
    }
    assert got["off"]["n_failed"] == 1 and got["off"]["n_cases"] == 2
    # The mean is taken over the case maxima, not over elements.
    assert got["off"]["mean_err"] == pytest.approx(got["off"]["max_err"] / 2)
    assert got["nan"]["passed"] is False


def test_scenario_states(spark, cases):
    runs = spark.createDataFrame(
        [
            ("exact", "a", True, True), ("off", "a", True, True), ("nan", "a", True, True),
            ("short", "a", True, True), ("nocand", "a", True, False), ("nocand", "z", True, True),
            ("noref", "a", False, True), ("empty", "a", True, True), ("empty", "b", True, False),
            ("absent", "a", False, False),
        ],
        "fn string, case string, ref_ran boolean, cand_ran boolean",
    )
    got = {r["label"]: (r["state"], r["passed"]) for r in R.scenario_verdict(cases, runs).collect()}
    assert got == {
        "EXACT::a": ("PASS", True), "OFF::a": ("FAIL", False), "NAN::a": ("FAIL", False),
        "SHORT::a": ("FAIL_LENGTH", False), "NOCAND::a": ("SOFT_PASS", True),
        "NOCAND::z": ("PASS_NO_OUTPUT", True), "NOREF::a": ("FAIL_NO_REFERENCE", False),
        "EMPTY::a": ("PASS_NO_OUTPUT", True), "EMPTY::b": ("PASS_NO_OUTPUT", True),
        "ABSENT::a": ("FAIL_NO_REFERENCE", False),
    }


def test_unchanged_is_exact(spark, sides):
    ref, _ = sides
    same = {tuple(r)[:2]: r["unchanged"] for r in R.unchanged_check(ref.filter("fn <> 'twice'"), ref.filter("fn <> 'twice'")).collect()}
    assert all(same.values())
    moved = ref.withColumn("v", F.col("v") + 1e-15)
    assert not any(r["unchanged"] for r in R.unchanged_check(ref.filter("fn = 'exact'"), moved.filter("fn = 'exact'")).collect())


def test_health_coverage_and_dual_run(sides, rows):
    ref, cand = sides
    expected = ref.select("fn", "case").unionByName(cand.select("fn", "case"))
    assert rows(R.reference_health(expected, ref)) == [("noref", "a")]
    assert [r["fn"] for r in R.coverage(ref, cand).collect()] == [
        "close", "exact", "nan", "off", "shifted", "short", "twice"
    ]
    base = ref.filter("fn = 'exact'")
    out = R.dual_run(base, lambda d: d, lambda d: d.withColumn("v", F.col("v") * 1.0))
    assert out.first()["state"] == "PASS"


def test_tolerance_tier(spark, rows):
    df = spark.createDataFrame([(0, 1e-10), (1, 1e-6), (2, 2e-6), (3, NAN), (4, None)], "n int, e double")
    assert rows(df.select("n", R.tolerance_tier(F.col("e")))) == [
        (0, "strict"), (1, "early"), (2, "fail"), (3, "fail"), (4, None)
    ]


def test_nulls_fail_and_void_outputs_count_as_none(spark):
    ref = [("one", "a", 0, 1.0), ("one", "a", 1, 2.0), ("all", "a", 0, 1.0), ("void", "a", 0, 1.0), ("noref", "a", None, None)]
    cand = [("one", "a", 0, 1.0), ("one", "a", 1, None), ("all", "a", 0, None), ("void", "a", None, None), ("noref", "a", 0, 1.0)]
    cases = R.case_errors(R.align(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(cand, SCHEMA)))
    got = {r["fn"]: (r["status"], r["ok"]) for r in cases.collect()}
    assert got["one"] == got["all"] == ("COMPARED", False)
    assert got["void"] == ("NO_CANDIDATE", None) and got["noref"] == ("NO_REFERENCE", None)
    states = {r["fn"]: r["state"] for r in R.function_verdict(cases).collect()}
    assert states == {"one": "FAIL", "all": "FAIL", "void": "SKIPPED_PASS", "noref": "SKIPPED_FAIL"}
    runs = spark.createDataFrame([("one", "a", True, True), ("all", "a", True, True)], "fn string, case string, ref_ran boolean, cand_ran boolean")
    assert {r["state"] for r in R.scenario_verdict(cases, runs).collect()} == {"FAIL"}
