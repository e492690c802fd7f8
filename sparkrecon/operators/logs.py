"""Build-log mining over line tables ``(log, ln, line)`` and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.functions.text import plain_text

# Where a diagnostic names a module, and the module that is never reported.
MODULE = r"src/(\w+)\.rs:"
SKIPPED_MODULE = "lib"

# Fixed value: a run of blank lines with the line ends around it.
BLANK_LINES = r"(?:\A|\n)(?:[^\S\n]*\n)+|\n[^\S\n]*\z"

POSITION_BLOCK = 65_536


def failing_modules(lines: DataFrame, pattern: str = MODULE, skip: str = SKIPPED_MODULE) -> DataFrame:
    """``(log, module, first_ln)``: modules in diagnostics and where each is first seen."""
    return (
        lines.select("log", "ln", F.regexp_extract("line", pattern, 1).alias("module"))
        .filter((F.col("module") != "") & (F.col("module") != skip))
        .groupBy("log", "module")
        .agg(F.min("ln").alias("first_ln"))
    )


def error_blocks_in_text(logs: DataFrame, needle: Column, text: str = "text") -> DataFrame:
    """Add ``blocks``: the blank-line-separated blocks that mention ``needle``, else the text."""
    blocks = F.filter(F.split(plain_text(F.col(text)), BLANK_LINES), lambda b: (b != "") & b.contains(needle))
    return (
        logs.withColumn("_blocks", blocks)
        .withColumn(
            "blocks",
            F.when(F.size("_blocks") > 0, F.array_join("_blocks", "\n\n")).otherwise(F.col(text)),
        )
        .drop("_blocks")
    )


def error_blocks(lines: DataFrame, mentions: Column, blank: Column | None = None, block: int = POSITION_BLOCK) -> DataFrame:
    """Lines of the blocks in which ``mentions`` holds somewhere: ``(log, blk, ln, line)``.

    Blocks are runs between blank lines. A log without such a block, and lines without a log, are returned whole. Lines are dealt once, by log and
    range of positions, and everything inside a range is settled there. A block may go on over many ranges, so per range
    one row says how many blocks begin in it and whether its first and last one are hit; these rows, one per ``block``
    positions, are combined per log and meet their range where its lines already are.
    """
    empty = ~F.col("line").rlike(r"\S") if blank is None else blank
    flags = [F.coalesce(empty, F.lit(False)).alias("_blank"), F.coalesce(mentions, F.lit(False)).alias("_hit")]
    marked = lines.select("log", "ln", "line", F.floor(F.col("ln") / F.lit(block)).alias("_range"), *flags)
    inside = Window.partitionBy("log", "_range")
    before = inside.orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.withColumn("_at", F.sum(F.col("_blank").cast("long")).over(before)).withColumn("_hit", ~F.col("_blank") & F.col("_hit"))
    known = local.join(_range_verdicts(local), ["log", "_range"])
    same = Window.partitionBy("log", "_range", "_at")
    found = F.max("_hit").over(same)
    found = found | ((F.col("_at") == 0) & F.col("_first")) | ((F.col("_at") == F.col("_begun")) & F.col("_last"))
    judged = known.withColumn("_found", found).filter(~F.col("_any") | (F.col("_found") & ~F.col("_blank")))
    blk = F.when(F.col("_any"), F.col("_before") + F.col("_at"))
    nameless = lines.filter("log is null").select("log", F.lit(None).cast("long").alias("blk"), "ln", "line")
    return judged.select("log", blk.alias("blk"), "ln", "line").unionByName(nameless)


def _range_verdicts(local: DataFrame) -> DataFrame:
    """Per log and range: blocks begun in it and before it, is its log hit, is its first and last block hit anywhere."""
    ranges = local.groupBy("log", "_range", "_at").agg(F.max("_hit").alias("_hit")).groupBy("log", "_range")
    summary = ranges.agg(
        F.max("_at").alias("_begun"),
        F.max(F.col("_hit") & (F.col("_at") == 0)).alias("_head"),
        F.max_by("_hit", "_at").alias("_tail"),
        F.max("_hit").alias("_some"),
    )
    earlier = Window.partitionBy("log").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("_before", F.coalesce(F.sum("_begun").over(earlier), F.lit(0))).withColumn(
        "_any", F.max("_some").over(Window.partitionBy("log"))
    )
    ends = F.array(
        F.struct(F.col("_before").alias("blk"), F.col("_head").alias("hit")),
        F.struct((F.col("_before") + F.col("_begun")).alias("blk"), F.col("_tail").alias("hit")),
    )
    # the first block of a range may be the last of the one before
    open_ = placed.select("log", "_range", "_begun", "_before", "_any", F.posexplode(ends).alias("_end", "e"))
    open_ = open_.withColumn("_hit", F.max("e.hit").over(Window.partitionBy("log", "e.blk")))
    return open_.groupBy("log", "_range", "_begun", "_before", "_any").agg(
        F.max(F.when(F.col("_end") == 0, F.col("_hit"))).alias("_first"),
        F.max(F.when(F.col("_end") == 1, F.col("_hit"))).alias("_last"),
    )
