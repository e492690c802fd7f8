"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target in words. A document of it is taken ``target / source size`` times on average:
the whole part always, the rest by a draw. The draw is the cube method: inclusion probabilities move
through the null space of the balancing constraints (documents and words of the source), at
least one document settling per move, until at most two are open. It runs in blocks of about ``BLOCK``
documents of one source; what a block leaves open, its smallest documents, moves on to blocks of the next level,
and only the last two documents of a source are settled by the landing draw, words before documents. Documents over
``OUTLIER`` times the mean of their source are drawn before the flight, which balances them.

Draws come from a generator seeded by source and block over rows sorted by id, so reruns and
recomputed tasks agree. Null texts have size 0, null sources form one source that comes last, repeated
rows are drawn one by one, an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.llm.words import chunks, column, texts_of
from sparkrecon.plans.lineage import checkpoint, scratch_path

WEIGHTS = (5, 2, 1)
CAP = 3.0
BLOCK = 1_000
SLOTS = 16
OUTLIER = 10
NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of each row."""

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                n = np.diff(texts_of(column(piece, "text")).words()[2])
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), column(piece, "source"), pa.array(n, pa.int64())],
                    ["doc_id", "source", "size"],
                )

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, size long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, n, source_size, target: one row per source.

    Ranks come from a range sort and the row counts of its partitions, so no task sees all
    sources. The targets are weight times one level, capped; each round raises the level by what the
    capped sources leave over, until no further source is capped.
    """
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    laid = checkpoint(stats.orderBy(F.col("source").asc_nulls_last()))
    mask = (1 << 33) - 1
    numbered = laid.withColumn("_id", F.monotonically_increasing_id())
    counts = numbered.groupBy(F.shiftright("_id", 33).alias("p")).count().orderBy("p").collect()
    before, pairs = 0, []
    for row in counts:
        pairs += [F.lit(row["p"]), F.lit(before)]
        before += row["count"]
    first = F.create_map(*pairs) if pairs else F.create_map().cast("map<bigint,int>")
    rank = F.element_at(first, F.shiftright("_id", 33)) + F.col("_id").bitwiseAND(F.lit(mask))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weight = F.element_at(weights, (rank % len(WEIGHTS)).cast("int") + 1)
    ranked = numbered.withColumn("weight", weight).drop("_id")
    cap = CAP * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level >= cap
        sums = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("long")).alias("capped"),
        ).first()
        if not sums["total"] or not sums["open"] or sums["capped"] == capped:
            break
        capped = sums["capped"]
        level = (sums["total"] - sums["fixed"]) / sums["open"]
    return ranked.withColumn("target", F.least(F.col("weight") * level, cap)).drop("weight")


def with_target(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Join targets to documents; a hot source is spread over ``SLOTS`` keys."""
    slotted = sized.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLOTS)).cast("int"))
    table = targets.withColumnRenamed("source", "_source").withColumn(
        "_of", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))
    )
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slot") == F.col("_of"))
    return slotted.join(table, on).drop("_slot", "_of", "_source")


def flight(sizes: list[float], chance: list[float], draw: random.Random) -> list[float]:
    """Move probabilities until at most two lie strictly between 0 and 1.

    The largest open document leads each move and all other open ones make up for it, so large documents settle
    while many small ones can balance them, and the two left over are the smallest.
    """
    s, p = np.array(sizes, dtype=np.float64), np.array(chance, dtype=np.float64)
    settled = (p <= NEAR) | (p >= 1 - NEAR)
    p[settled] = np.round(p[settled])
    at = np.argsort(-s, kind="stable")
    at = at[~settled[at]]
    while len(at) > 2:
        now = p[at]
        u = np.append(1.0, _balance(s[at[0]], s[at[1:]], np.minimum(now[1:], 1 - now[1:])))
        p[at] = now = _moved(now, u, draw)
        at = at[(now > NEAR) & (now < 1 - NEAR)]
    return p.tolist()


def _balance(lead: float, sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """What the others move per unit of the lead: least change by ``room`` that keeps documents and words.

    Others of one size can keep only the words, others without words only the documents.
    """
    a0, a1, a2 = room.sum(), room @ sizes, room @ (sizes * sizes)
    det = a0 * a2 - a1 * a1
    if det > 1e-9 * a0 * a2:
        return -room * ((a2 - a1 * lead) + (a0 * lead - a1) * sizes) / det
    if a1 > 0:
        return -room * (lead / a1)
    return -room / a0


def landing(sizes: list[float], p: list[float], draw: random.Random) -> list[float]:
    """Settle what is open: keep the words while two are open, then draw the last one."""
    p = list(p)
    open_ = [i for i in range(len(p)) if NEAR < p[i] < 1 - NEAR]
    while len(open_) > 1:
        a, b = open_[:2]
        u = [sizes[b], -sizes[a]] if sizes[a] or sizes[b] else [1.0, -1.0]
        p[a], p[b] = _moved(np.array([p[a], p[b]]), np.array(u, dtype=np.float64), draw).tolist()
        open_ = [i for i in open_ if NEAR < p[i] < 1 - NEAR]
    for i in open_:
        p[i] = 1.0 if draw.random() < p[i] else 0.0
    return [float(round(x)) for x in p]


def _moved(p: np.ndarray, u: np.ndarray, draw: random.Random) -> np.ndarray:
    """One step along ``u`` or against it, as far as a probability reaches 0 or 1, fair on average."""
    up, down = u > 0, u < 0
    room = np.concatenate([(1 - p[up]) / u[up], -p[down] / u[down]]).min()
    back = np.concatenate([p[up] / u[up], (p[down] - 1) / u[down]]).min()
    step = room if draw.random() * (room + back) < back else -back
    p = p + step * u
    p[p < NEAR] = 0.0
    p[p > 1 - NEAR] = 1.0
    return p


def _fly(last: bool):
    def run(keys, table):
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("p", "ascending")])
        source, block = (k.as_py() for k in keys)
        seed = zlib.crc32(f"{source is None}:{source}:{block}:{last}".encode())
        draw = random.Random(seed)
        size, p = table.column("size").to_pylist(), table.column("p").to_pylist()
        p = flight(size, p, draw)
        if last:
            p = landing(size, p, draw)
        at = table.schema.get_field_index("p")
        return table.set_column(at, "p", pa.array(p, pa.float64()))

    return run


def _outlier() -> Column:
    return F.col("size") * F.col("n") > OUTLIER * F.col("source_size")


def _draw_rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def _drawn() -> Column:
    """Copies of an outlier: its source's rate rounded up or down by a draw from its id and size."""
    unit = F.pmod(F.xxhash64("doc_id", "size", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(_draw_rate() + unit)


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``rate``: copies on average of a document that is no outlier.

    Outliers, over ``OUTLIER`` times the mean size of their source, are drawn first, each by itself; no block of small
    documents could make up for them. The others of the source share what the draws leave of the target.
    """
    big = with_target(sized, targets).filter(_outlier())
    sums = big.groupBy(F.col("source").alias("_source")).agg(
        F.sum("size").alias("big"), F.sum(_drawn() * F.col("size")).alias("big_taken")
    )
    joined = targets.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
    small = F.col("source_size") - F.coalesce("big", F.lit(0))
    left = (F.col("target") - F.coalesce("big_taken", F.lit(0))) / small
    rate = F.when(small > 0, F.least(F.greatest(left, F.lit(0.0)), F.lit(CAP))).otherwise(_draw_rate())
    return joined.withColumn("rate", rate).drop("_source", "big", "big_taken")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) per row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "sizes")
    sizes(docs).write.parquet(path)
    sized = spark.read.parquet(path)
    targets = checkpoint(source_targets(sized))
    most = targets.agg(F.max("n")).first()[0] or 0
    blocks = F.ceil(F.col("n") / BLOCK)
    state = (
        with_target(sized, checkpoint(rates(sized, targets)))
        .withColumn("whole", F.when(_outlier(), _drawn()).otherwise(F.floor(F.col("rate") + NEAR)).cast("long"))
        .withColumn("p", F.when(_outlier(), 0.0).otherwise(F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), blocks))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "block")
    )
    n_blocks, settled = -(-most // BLOCK), []
    while True:
        last = n_blocks <= 1
        flown = state.groupBy("source", "block").applyInArrow(_fly(last), state.schema)
        if last:
            settled.append(flown)
            break
        path = scratch_path(spark, "flight")
        flown.write.parquet(path)
        flown = spark.read.parquet(path)
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(flown.filter(~is_open))
        # at most two open documents come from a block
        state = flown.filter(is_open).withColumn("block", F.floor(F.col("block") / (BLOCK // 2)))
        n_blocks = -(-n_blocks // (BLOCK // 2))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (none, once or more).

    Rows of one id, source and size meet their numbers of copies in the order of their texts. Texts cross the network
    once: the numbering follows the partitioning of the join. Columns of any name and type pass unchanged.
    """
    key = F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"))
    least = F.min("copies")
    # copies of one source and size differ by one at most
    taken = mix(docs).groupBy(key.alias("key")).agg(
        least.alias("least"), (F.sum("copies") - least * F.count(F.lit(1))).alias("more")
    )
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = F.struct(
        F.col("doc_id").cast("long").alias("d"),
        F.col("source").cast("string").alias("s"),
        F.coalesce(words, F.lit(0)).cast("long").alias("z"),
    )
    rows = docs.select(own.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(taken.hint("merge"), "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("row.text"))
    times = joined.select("row", (F.col("least") + (nth <= F.col("more")).cast("long")).alias("times")).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
