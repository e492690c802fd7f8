"""Dependency graph over an edge table ``(src, dst)``: src needs dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrecon.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, salt_many, salt_one, spread_of
from sparkrecon.plans.lineage import checkpoint, scratch_path
from sparkrecon.plans.prefix import ordered_concat


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, level)``: 0 needs nothing, otherwise one more than the highest need.

    Every ``src`` is a node; edges to other names do not count. Members of a cycle, and nodes
    that need one, get a null level: they come last.

    1. A node with a single need is one level above it, so chains and trees of such nodes are followed by pointer
       jumping: each round a node takes over the pointer of the node it points to, ``JUMPS`` times per job, until it
       points to a node with no or several needs. The rounds grow with the logarithm of a chain's length, and
       nodes that have arrived are not read as open ones again.
    2. Nodes with several needs remain, their needs replaced by what those point to. Each keeps a count of unmet needs;
       a round takes one off for every need settled in the round before, in a single aggregation, and a count of
       zero settles the node. These rounds grow with the longest chain of such nodes only.

    Every round writes its nodes below the shared folder, so the plan stays short and a lost executor costs one
    round. Newly settled nodes are broadcast while their counted number and bytes allow it. Beyond that they are
    joined, with the edges to very popular nodes spread over slots.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "levels")
    names = nodes.select("node").distinct()
    kind = names.schema["node"].dataType
    links = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    links.join(names.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").write.parquet(f"{folder}/edges")
    needs = spark.read.schema(links.schema).parquet(f"{folder}/edges")

    seen = Observation()
    degrees = needs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"))
    degrees.observe(seen, F.count(F.when(F.col("n") > 1, 1)).alias("several")).filter("n = 1").select(
        "node", "to", F.lit(1).alias("w"), F.lit(False).alias("done")
    ).write.partitionBy("done").parquet(f"{folder}/pointers/round=0")
    several = seen.get["several"]
    pointers = _jump(spark, folder, kind)
    free = names.join(pointers.select("node"), "node", "left_anti")
    settled = free.select("node", F.lit(0).alias("level"))
    if several:
        arrived = pointers.filter("done").select(F.col("node").alias("dst"), "to", "w")
        rest = needs.join(free.select(F.col("node").alias("src")), "src", "left_semi").join(arrived, "dst", "left")
        contracted = rest.groupBy("src", F.coalesce("to", "dst").alias("dst")).agg(F.max(F.coalesce("w", F.lit(0)) + 1).alias("w"))
        settled = _settled(contracted, free, folder)
    roots = settled.select(F.col("node").alias("to"), F.col("level").alias("base"))
    above = pointers.join(roots, "to", "left").select("node", F.when(F.col("done"), F.col("base") + F.col("w")).cast("int").alias("level"))
    return settled.select("node", F.col("level").cast("int").alias("level")).unionByName(above)


JUMPS = 2


def _jump(spark: SparkSession, folder: str, kind: T.DataType) -> DataFrame:
    """``(node, to, w, done)``: where a chain of single needs ends, and after how many steps.

    Nodes on a cycle, or on a way into one, are not done.
    """
    shape = T.StructType(
        [T.StructField("node", kind), T.StructField("to", kind), T.StructField("w", T.IntegerType())]
        + [T.StructField("round", T.IntegerType()), T.StructField("done", T.BooleanType())]
    )
    level, columns = 0, ["node", "to", "w", "done"]
    while True:
        stored = spark.read.schema(shape).parquet(f"{folder}/pointers")
        latest = stored.filter(F.col("done") | (F.col("round") == level)).select(*columns)
        now, known = latest.filter("not done"), latest
        for _ in range(JUMPS):
            ahead = known.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"))
            now = now.join(ahead, "to", "left").select(
                "node",
                F.coalesce("next", "to").alias("to"),
                (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
                F.col("next").isNull().alias("done"),
            )
            known = latest.filter("done").unionByName(now)
        seen = Observation()
        now.observe(seen, F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("done"), 1)).alias("done")).write.partitionBy(
            "done"
        ).parquet(f"{folder}/pointers/round={level + 1}")
        level += 1
        if seen.get["done"] in (0, seen.get["all"]):
            everything = spark.read.schema(shape).parquet(f"{folder}/pointers")
            return everything.filter(F.col("done") | (F.col("round") == level)).select(*columns)


def _settled(links: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """``(node, level)`` of ``names`` by rounds of need counts; a need ``(src, dst, w)`` lifts src w levels above dst."""
    spark = links.sparkSession
    hot = checkpoint(spread_of(links, ["dst"]))
    salt_many(links, ["dst"], hot).select("src", "dst", "w", "_slot").write.parquet(f"{folder}/needs")
    shape = T.StructType([*links.schema, T.StructField("_slot", T.IntegerType())])
    needs = spark.read.schema(shape).parquet(f"{folder}/needs")

    none = F.lit(None).cast("int")
    unmet = needs.select(F.col("src").alias("node"), F.lit(1).alias("n"), none.alias("up"))
    start = names.select("node", F.lit(0).alias("n"), none.alias("up")).unionByName(unmet)
    columns = [T.StructField(c, T.IntegerType()) for c in ("n", "up", "level")]
    shape = T.StructType([names.schema["node"], *columns])
    level = 0
    size, held = _settle(start, level, folder)
    while size > 0:
        state = spark.read.schema(shape).parquet(f"{folder}/rounds/round={level}")
        done = state.filter(F.col("level").isNotNull()).select(F.col("node").alias("dst"), "level")
        if size <= BROADCAST_ROWS and held <= BROADCAST_BYTES:
            met = needs.join(F.broadcast(done), "dst")
        else:
            met = needs.join(salt_one(done, ["dst"], hot), ["dst", "_slot"])
        level += 1
        lifted = met.select(F.col("src").alias("node"), F.lit(-1).alias("n"), (F.col("level") + F.col("w")).alias("up"))
        size, held = _settle(state.filter(F.col("level").isNull()).select("node", "n", "up").unionByName(lifted), level, folder)
    everything = spark.read.schema(T.StructType([*shape, T.StructField("round", T.IntegerType())]))
    final = F.col("level").isNotNull() | (F.col("round") == level)
    return everything.parquet(f"{folder}/rounds").filter(final).select("node", "level")


def _settle(counts: DataFrame, level: int, folder: str) -> tuple[int, int]:
    """Add up need counts, write the round, and return how many nodes it settled and their bytes."""
    added = counts.groupBy("node").agg(F.sum("n").cast("int").alias("n"), F.max("up").cast("int").alias("up"))
    marked = added.withColumn("level", F.when(F.col("n") == 0, F.coalesce("up", F.lit(0))))
    seen = Observation()
    width = F.when(F.col("level").isNotNull(), F.octet_length(F.col("node").cast("string")))
    observed = marked.observe(
        seen, F.count("level").alias("settled"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    )
    observed.write.parquet(f"{folder}/rounds/round={level}")
    return seen.get["settled"], seen.get["bytes"]


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, callee)`` rows with one callee each; null for a node that calls nothing.

    Callers are looked up and leaves added on their own, so a node with very many callees
    is never gathered on the many side of an outer join.
    """
    names = nodes.select("node").distinct()
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("callee")).distinct()
    leaves = names.join(pairs.select("node").distinct(), "node", "left_anti")
    none = F.lit(None).cast(pairs.schema["callee"].dataType)
    return lookup_join(pairs, names, ["node"], "left_semi").unionByName(leaves.withColumn("callee", none))


def render_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, callees)`` with the callees sorted and joined by commas, or ``(leaf)``.

    Callees are sorted across the cluster first; pieces of a long list are joined before
    the finished text of a node is put together.
    """
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("callee")).distinct()
    ranked = pairs.repartitionByRange("node", "callee").sortWithinPartitions("node", "callee")
    ranked = ranked.withColumn("pos", F.monotonically_increasing_id())
    texts = ordered_concat(ranked, ["node"], "pos", "callee", ", ", "callees")
    return (
        nodes.select("node")
        .distinct()
        .join(texts, "node", "left")
        .withColumn("callees", F.coalesce("callees", F.lit("(leaf)")))
    )
