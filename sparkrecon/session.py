"""Session settings the library is written for. Cluster sizes stay with spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession


INITIAL_PARTITIONS = "8192"


def build_session(app: str = "sparkrecon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    ``advisoryPartitionSizeInBytes`` lets adaptive execution merge reduce tasks by the bytes
    shuffled. It cannot make more of them than a shuffle starts with, so on a cluster shuffles start with
    ``INITIAL_PARTITIONS`` unless the caller sets ``spark.sql.shuffle.partitions``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    initial = {}
    if not (master or "").startswith("local") and "spark.sql.shuffle.partitions" not in conf:
        # adaptive execution only merges: start from many partitions and let it merge small ones
        initial = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": INITIAL_PARTITIONS}
    settings = {
        **initial,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
