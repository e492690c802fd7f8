"""Connected components of an edge table, by alternating star rounds.

Each round replaces the edges of a node by edges to its least neighbour, first towards larger, then towards
smaller nodes, until every component is a star around its least node. The minimum per node is a
partial aggregate and meets the edges in a join, so a node with very many edges is not
collected anywhere. Rounds are written below the shared folder; a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.plans.lineage import drop_scratch, scratch_path

ROWS_PER_TASK = 250_000


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a, b; the result has node, component for every node with a link.

    The component is its least node. Loops and nulls are ignored.
    """
    spark = edges.sparkSession
    now, path = _stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _fingerprint(now)
    # rounds have no more edges than the first: few tasks write and read a small table
    tasks = 1 + mark[0] // ROWS_PER_TASK
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, wide = _stored(large.filter("a <> b").distinct(), tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = least.select("a", F.col("m").alias("b")).unionByName(moved)
        before, (now, path) = path, _stored(small.distinct(), tasks)
        drop_scratch(spark, before, wide)
        last, mark = mark, _fingerprint(now)
        if mark == last:
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(centres)


def _stored(df: DataFrame, tasks: int | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, "stars")
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.col("a").cast("decimal(20,0)"))).first()
    return tuple(row)
