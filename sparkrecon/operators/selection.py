"""Choosing rows: selections, first-wins de-duplication, source resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.operators.catalogue import CATALOGUE
from sparkrecon.plans.joins import lookup_join

# Fixed value: a download this short or shorter is no source file.
MIN_DOWNLOAD_BYTES = 100


def parse_selection(raw: Column, catalogue: list[str] | None = None) -> Column:
    """Array of lower-case names a request stands for.

    An integer N takes the first N names of the catalogue, at least one and at most all;
    anything else is a comma-separated list.
    """
    names = [n.lower() for n in (catalogue or CATALOGUE)]
    known = F.array(*[F.lit(n) for n in names])
    text = F.trim(raw)
    # of any length: digits beyond nine are more than any catalogue holds
    digits = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]+)$", 1), "^0+(?=[0-9])", "")
    positive = F.when(F.length(digits) > 9, F.lit(len(names))).otherwise(
        F.least(F.greatest(digits.try_cast("int"), F.lit(1)), F.lit(len(names)))
    )
    count = F.when(digits != "", F.when(text.startswith("-"), F.lit(1)).otherwise(positive))
    listed = F.filter(F.transform(F.split(text, ","), lambda n: F.lower(F.trim(n))), lambda n: n != "")
    return F.when(count.isNotNull(), F.slice(known, F.lit(1), count)).otherwise(listed)


def ordered_dedupe(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """One row per key with its first position."""
    return df.groupBy(key).agg(F.min(ord_col).alias(ord_col))


def dedupe_lower(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """First row per key, ignoring case; the key comes back in lower case.

    An aggregate rather than a ranking window: rows combine before the shuffle.
    """
    others = [c for c in df.columns if c not in (key, ord_col)]
    first = F.min(F.struct(F.col(ord_col), *[F.col(c) for c in others]))
    return (
        df.groupBy(F.lower(key).alias(key))
        .agg(first.alias("_first"))
        .select(key, f"_first.{ord_col}", *[f"_first.{c}" for c in others])
    )


def resolve_sources(candidates: DataFrame, min_bytes: int = MIN_DOWNLOAD_BYTES) -> DataFrame:
    """``(name, priority, origin, bytes)`` of the first usable candidate per name.

    ``candidates`` adds ``downloaded``; a downloaded candidate is usable when it is longer
    than ``min_bytes``.
    """
    usable = candidates.filter(~F.col("downloaded") | (F.col("bytes") > min_bytes))
    best = F.min(F.struct("priority", "origin", "bytes"))
    return usable.groupBy("name").agg(best.alias("_b")).select("name", "_b.priority", "_b.origin", "_b.bytes")


def missing_sources(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requested names that no source resolved."""
    return lookup_join(wanted.select("name").distinct(), resolved.select("name").distinct(), ["name"], "left_anti")
