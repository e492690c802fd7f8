"""Latest message and running count per key over a stream of progress rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1_000) -> DataFrame:
    """Stream of the Parquet files below the folder ``path``, or of the one file it names."""
    # As a pattern the path may name a file as well; a plain path must be a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)


def latest_status(stream: DataFrame, key: str, ts: str, tie: str, msg: str) -> DataFrame:
    """Newest message per key; ``tie`` decides between equal times."""
    newest = F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(msg).alias("msg")))
    return stream.groupBy(key).agg(newest.alias("_m")).select(key, "_m.ts", "_m.msg")


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Rows seen so far per key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


BUCKETS = 64
BUCKET = "_bucket"


def run_available(result: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Process what is there and keep the latest row per key below ``path``.

    Rows lie in ``buckets`` folders by a hash of the key, and a batch rewrites only those it has keys of
    (:func:`keep_changes`), so the stored table has one row per key however many batches there were. Choose
    ``buckets`` so that a folder is some hundred megabytes, and leave it: a stored table keeps its number.
    """
    spark = result.sparkSession
    shape = result.schema.add(BUCKET, T.IntegerType())
    spark.createDataFrame([], shape).write.mode("append").partitionBy(BUCKET).parquet(f"{path}/rows")

    query = (
        result.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(lambda batch, _: keep_changes(batch, path, key, buckets))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keep_changes(batch: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Replace the stored rows of the keys of ``batch`` (one row per key).

    The batch is written down first, so it is worked out once. The touched buckets are then written anew and swapped in
    by Spark's own commit, which also removes what they held before. Rows are states, not
    changes: a batch that is repeated after a failure, wholly or in part, leaves the same rows.
    """
    spark, shape = batch.sparkSession, batch.schema
    batch.write.mode("overwrite").parquet(f"{path}/batch")
    fresh = spark.read.schema(shape).parquet(f"{path}/batch")
    fresh = fresh.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    before = spark.read.schema(fresh.schema).parquet(f"{path}/rows").filter(F.col(BUCKET).isin(touched))
    changed = fresh.select(F.col(key).alias("_key"))
    kept = before.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    (
        kept.unionByName(fresh)
        .repartition(BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(f"{path}/rows")
    )


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per key of what :func:`run_available` has kept."""
    return spark.read.parquet(f"{path}/rows").drop(BUCKET)
