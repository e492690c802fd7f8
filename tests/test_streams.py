"""Streams resumed from their checkpoint end with the same rows as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.plans.lineage import scratch_path
from sparkrecon.streaming import status as S


def test_resumed_stream_equals_batch(spark, rows):
    source, out = scratch_path(spark, "progress"), scratch_path(spark, "status")
    data = spark.range(90).select(
        (F.col("id") % 4).alias("key"),
        (F.col("id") * 7 % 31).alias("ts"),
        F.col("id").alias("tie"),
        F.concat(F.lit("step "), "id").alias("msg"),
    )
    data.filter("tie < 50").repartition(3).write.parquet(source)
    for part in ("tie < 0", "tie >= 50", "tie < 0"):
        data.filter(part).write.mode("append").parquet(source)
        stream = S.read_stream(spark, source, data.schema, files_per_batch=2)
        S.run_available(S.latest_status(stream, "key", "ts", "tie", "msg"), out, "key", buckets=3)
    assert rows(S.current_rows(spark, out)) == rows(S.latest_status(data, "key", "ts", "tie", "msg"))


def test_counts_of_one_file(spark, rows):
    source, out = scratch_path(spark, "one"), scratch_path(spark, "counts")
    data = spark.range(20).select((F.col("id") % 3).alias("key"))
    data.coalesce(1).write.parquet(source)
    import glob

    (file,) = glob.glob(f"{source}/part-*.parquet")
    S.run_available(S.running_counts(S.read_stream(spark, file, data.schema), "key"), out, "key")
    assert rows(S.current_rows(spark, out)) == rows(S.running_counts(data, "key"))


def test_the_stored_table_does_not_grow_with_batches(spark, rows):
    """100 batches over 12 keys leave one file per bucket; a repeated batch counts once."""
    out = scratch_path(spark, "many")
    shape = "key int, n long"
    spark.createDataFrame([], f"{shape}, {S.BUCKET} int").write.partitionBy(S.BUCKET).parquet(f"{out}/rows")
    S.keep_changes(spark.createDataFrame([(k, 0) for k in range(12)] + [(None, 0)], shape), out, "key", 4)
    want = {k: 0 for k in [*range(12), None]}
    for batch in range(1, 100):
        changed = {batch * 5 % 12: batch, (None if batch % 9 == 0 else batch % 7): batch}
        want |= changed
        frame = spark.createDataFrame(list(changed.items()), shape)
        S.keep_changes(frame, out, "key", 4)
    S.keep_changes(frame, out, "key", 4)
    now = S.current_rows(spark, out)
    assert {r["key"]: r["n"] for r in now.collect()} == want and now.count() == 13
    assert len(now.inputFiles()) <= 4


def test_only_touched_buckets_are_written(spark):
    out = scratch_path(spark, "touched")
    data = spark.range(200).select(F.col("id").alias("key"), F.lit(1).alias("n"))
    source = scratch_path(spark, "source")
    data.write.parquet(source)
    S.run_available(S.running_counts(S.read_stream(spark, source, data.schema), "key"), out, "key", buckets=8)
    before = set(S.current_rows(spark, out).inputFiles())
    S.keep_changes(spark.createDataFrame([(3, 9)], "key long, n long"), out, "key", 8)
    after = set(S.current_rows(spark, out).inputFiles())
    assert len(before) == len(after) == 8 and len(before & after) == 7
    assert S.current_rows(spark, out).filter("n = 9").count() == 1
