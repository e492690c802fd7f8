"""Fixed values of the routine catalogue: names, levels, default sizes, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published routine names by level.
LEVEL_1 = (
    "dasum daxpy dcopy ddot dnrm2 drot drotg drotm drotmg dscal dsdot dswap dzasum dznrm2 idamax"
).split()
LEVEL_2 = (
    "dgbmv dgemv dger dsbmv dspmv dspr dspr2 dsymv dsyr dsyr2 dtbmv dtbsv dtpmv dtpsv dtrmv dtrsv"
).split()
LEVEL_3 = "dgemm dsymm dsyr2k dsyrk dtrmm dtrsm".split()
CATALOGUE = LEVEL_1 + LEVEL_2 + LEVEL_3

# Every name that counts as level 1 or level 2; any other name is level 3.
KNOWN_LEVEL_1 = (
    "daxpy saxpy zaxpy caxpy ddot sdot dsdot sdsdot dnrm2 snrm2 dznrm2 scnrm2 "
    "dasum sasum dzasum scasum dscal sscal zdscal zscal dcopy scopy zcopy ccopy "
    "dswap sswap zswap cswap drot srot zdrot csrot drotg srotg drotm srotm drotmg srotmg "
    "idamax isamax izamax icamax"
).split()
KNOWN_LEVEL_2 = (
    "dgemv sgemv zgemv cgemv dgbmv sgbmv zgbmv cgbmv dsymv ssymv dsbmv ssbmv dspmv sspmv "
    "dtrmv strmv ztrmv ctrmv dtbmv stbmv ztbmv ctbmv dtpmv stpmv ztpmv ctpmv "
    "dtrsv strsv ztrsv ctrsv dtbsv stbsv ztbsv ctbsv dtpsv stpsv ztpsv ctpsv "
    "dger sger zgeru zgjerc cgeru cgerc dsyr ssyr zher cher dspr sspr zhpr chpr "
    "dsyr2 ssyr2 zher2 cher2 dspr2 sspr2 zhpr2 chpr2"
).split()

# Size of each integer argument in checks, and in timing runs.
DIM_DEFAULTS = {
    "M": 4, "N": 4, "K": 4, "LDA": 4, "LDB": 4, "LDC": 4, "LDE": 4, "LDF": 4,
    "INCX": 1, "INCY": 1, "INC": 1, "NRHS": 2, "KL": 1, "KU": 1, "KB": 4, "P": 3, "Q": 3,
}
BENCH_DIM_DEFAULTS = {
    "M": 256, "N": 256, "K": 256, "LDA": 256, "LDB": 256, "LDC": 256, "LDE": 256, "LDF": 256,
    "INCX": 1, "INCY": 1, "INC": 1, "NRHS": 64, "KL": 32, "KU": 32, "KB": 256, "P": 128, "Q": 128,
}
DIM_FALLBACK = 4

# Test scenarios as (name, sizes, scalars, flags, expects no-op, invalid input).
# Five random-seed scenarios come first on every level; their seeds are 0 to 4.
RANDOM_SEEDS = 5
SCENARIOS = {
    1: [
        ("n_zero", {"N": 0}, {}, {}, True, False),
        ("n_one", {"N": 1}, {}, {}, False, False),
        ("n_large", {"N": 32}, {}, {}, False, False),
        ("alpha_zero", {}, {"DA": 0.0, "ALPHA": 0.0}, {}, True, False),
        ("alpha_neg_one", {}, {"DA": -1.0, "ALPHA": -1.0}, {}, False, False),
        ("alpha_large", {}, {"DA": 1000.0, "ALPHA": 1000.0}, {}, False, False),
        ("stride_2", {"N": 4, "INCX": 2, "INCY": 2}, {}, {}, False, False),
        ("stride_3", {"N": 3, "INCX": 3, "INCY": 3}, {}, {}, False, False),
        ("invalid_incx_zero", {"INCX": 0}, {}, {}, True, True),
        ("invalid_incy_zero", {"INCY": 0}, {}, {}, True, True),
    ],
    2: [
        ("m_zero", {"M": 0}, {}, {}, True, False),
        ("n_zero", {"N": 0}, {}, {}, True, False),
        ("square_1x1", {"M": 1, "N": 1, "LDA": 1}, {}, {}, False, False),
        ("square_8x8", {"M": 8, "N": 8, "LDA": 8}, {}, {}, False, False),
        ("alpha_zero", {}, {"ALPHA": 0.0}, {}, False, False),
        ("beta_zero", {}, {"BETA": 0.0}, {}, False, False),
        ("unit_beta", {}, {"BETA": 1.0}, {}, False, False),
        ("alpha_zero_beta_zero", {}, {"ALPHA": 0.0, "BETA": 0.0}, {}, False, False),
        ("trans_n", {}, {}, {"TRANS": "N"}, False, False),
        ("trans_t", {}, {}, {"TRANS": "T"}, False, False),
        ("invalid_m_neg", {"M": -1}, {}, {}, True, True),
        ("invalid_n_neg", {"N": -1}, {}, {}, True, True),
        ("invalid_lda_small", {"LDA": 0}, {}, {}, True, True),
    ],
    3: [
        ("m_zero", {"M": 0}, {}, {}, True, False),
        ("n_zero", {"N": 0}, {}, {}, True, False),
        ("k_zero", {"K": 0}, {}, {}, False, False),
        ("square_1x1", {"M": 1, "N": 1, "K": 1, "LDA": 1, "LDB": 1, "LDC": 1}, {}, {}, False, False),
        ("square_8x8", {"M": 8, "N": 8, "K": 8, "LDA": 8, "LDB": 8, "LDC": 8}, {}, {}, False, False),
        ("rectangular_4x6_k2", {"M": 4, "N": 6, "K": 2, "LDA": 4, "LDB": 2, "LDC": 4}, {}, {}, False, False),
        ("alpha_zero", {}, {"ALPHA": 0.0}, {}, False, False),
        ("beta_zero", {}, {"BETA": 0.0}, {}, False, False),
        ("unit_beta", {}, {"BETA": 1.0}, {}, False, False),
        ("alpha_zero_beta_zero", {}, {"ALPHA": 0.0, "BETA": 0.0}, {}, False, False),
        ("alpha_zero_unit_beta", {}, {"ALPHA": 0.0, "BETA": 1.0}, {}, True, False),
        ("alpha_neg_one", {}, {"ALPHA": -1.0}, {}, False, False),
        ("trans_a", {"M": 4, "N": 4, "K": 4, "LDA": 4, "LDB": 4, "LDC": 4}, {}, {"TRANSA": "T"}, False, False),
        ("trans_b", {"M": 4, "N": 4, "K": 4, "LDA": 4, "LDB": 4, "LDC": 4}, {}, {"TRANSB": "T"}, False, False),
        (
            "trans_both",
            {"M": 4, "N": 4, "K": 4, "LDA": 4, "LDB": 4, "LDC": 4},
            {},
            {"TRANSA": "T", "TRANSB": "T"},
            False,
            False,
        ),
        ("invalid_transa", {}, {}, {"TRANSA": "X"}, True, True),
        ("invalid_m_neg", {"M": -1}, {}, {}, True, True),
        ("invalid_n_neg", {"N": -1}, {}, {}, True, True),
        ("invalid_k_neg", {"K": -1}, {}, {}, True, True),
        ("invalid_lda_small", {"LDA": 0}, {}, {}, True, True),
    ],
}

SCENARIO_SCHEMA = (
    "level int, scenario string, seed int, dim_overrides map<string,int>, "
    "float_overrides map<string,double>, char_overrides map<string,string>, "
    "expects_noop boolean, invalid_input boolean"
)


def scenario_rows() -> list[tuple]:
    """The scenario table as Python rows in ``SCENARIO_SCHEMA`` order."""
    rows = []
    for level, named in SCENARIOS.items():
        rows += [(level, f"random_seed_{s}", s, {}, {}, {}, False, False) for s in range(RANDOM_SEEDS)]
        rows += [(level, name, 0, dims, reals, flags, noop, bad) for name, dims, reals, flags, noop, bad in named]
    return rows


def scenario_table(spark: SparkSession) -> DataFrame:
    """The built-in scenarios; pass your own table of this schema to replace them."""
    return spark.createDataFrame(scenario_rows(), SCENARIO_SCHEMA)
