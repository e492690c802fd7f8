"""Argument checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_eq(a: Column, b: Column) -> Column:
    """Same letter, ignoring case."""
    return F.upper(a) == F.upper(b)


def validate_params(
    ta: Column, tb: Column, m: Column, n: Column, k: Column, lda: Column, ldb: Column, ldc: Column
) -> Column:
    """Code of the first bad argument of a matrix product, 0 if all are good.

    The codes are argument positions; a leading dimension must hold the rows of the matrix
    as stored.
    """
    rows_a = F.when(flag_eq(ta, F.lit("N")), m).otherwise(k)
    rows_b = F.when(flag_eq(tb, F.lit("N")), k).otherwise(n)
    one = F.lit(1)
    return (
        F.when(~F.upper(ta).isin("N", "T", "C"), 1)
        .when(~F.upper(tb).isin("N", "T", "C"), 2)
        .when(m < 0, 3)
        .when(n < 0, 4)
        .when(k < 0, 5)
        .when(lda < F.greatest(one, rows_a), 8)
        .when(ldb < F.greatest(one, rows_b), 10)
        .when(ldc < F.greatest(one, m), 13)
        .otherwise(0)
    )


def quick_return(m: Column, n: Column, k: Column, alpha: Column, beta: Column) -> Column:
    """True when a matrix product leaves its output as it is."""
    nothing_added = ((alpha == 0) | (k == 0)) & (beta == 1)
    return (m == 0) | (n == 0) | nothing_added
