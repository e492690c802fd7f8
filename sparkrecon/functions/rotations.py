"""Rotation set-up as column expressions, so that a table of pairs gets one rotation per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotg(a: Column, b: Column) -> Column:
    """Struct r, z, c, s of the plane rotation that turns (a, b) into (r, 0).

    r has the sign of the larger of the two, of b when they tie. z packs the rotation: s when a is the larger, else 1/c,
    or 1 when c is zero. (0, 0) gives r = z = s = 0 and c = 1. Null in either gives null fields.
    """
    a, b = a.cast("double"), b.cast("double")
    a_leads = F.abs(a) > F.abs(b)
    size = F.hypot(a, b)
    r = F.when(F.when(a_leads, a).otherwise(b) < 0, -size).otherwise(size)
    zero = size == 0
    c = F.when(zero, F.lit(1.0)).otherwise(F.try_divide(a, r))
    s = F.when(zero, F.lit(0.0)).otherwise(F.try_divide(b, r))
    z = F.when(zero, F.lit(0.0)).when(a_leads, s).when(c != 0, F.try_divide(F.lit(1.0), c)).when(c == 0, F.lit(1.0))
    return F.struct(r.alias("r"), z.alias("z"), c.alias("c"), s.alias("s"))
