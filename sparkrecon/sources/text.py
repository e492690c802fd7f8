"""Text sources and sinks: whole source files, numbered lines, value files, rendered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecon.functions.text import OTHER_BREAKS, bound, has_odd_break, lines_of, strip_ws
from sparkrecon.plans.joins import lookup_join


def read_corpus(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(doc, text)``: every file whole; bytes that are not UTF-8 become U+FFFD."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("doc"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )


def _split_lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """``(doc, block, line)``: lines of every file; ``block`` is where the split of the file began.

    Files are read in splits, so a file of any size is read by many tasks. Within a task the lines of a split
    stand together and in order.
    """
    reader = spark.read.format("text").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # the text source cuts at line feeds and carriage returns; few lines hold other line ends, and only they are cut
    # again. A blank line is a line. No lambda here: Spark compiles none, and this runs once per line.
    uniform = F.regexp_replace(F.regexp_replace("text", OTHER_BREAKS, "\n"), r"\n\z", "")
    lines = F.when(has_odd_break(F.col("text")), F.split(uniform, "\n")).otherwise(F.array("text"))
    found = reader.load(path).select(
        F.col("_metadata.file_path").alias("doc"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8(F.col("value")).alias("text"),
    )
    return found.select("doc", "block", F.explode(lines).alias("line"))


def _numbered(rows: DataFrame, whole: Column, bad: Column) -> DataFrame:
    """Rows with ``pos``, their place in ``file`` from 0, and ``void``: whether ``file`` has a bad row.

    ``rows`` come straight from the reader. A row's number in its split is a difference of increasing ids; splits, of
    which there is one per some megabytes, add up what lies before them. No group of lines is gathered or sorted: lines
    only meet the row of their split, by whichever join Spark finds right for the number of splits.
    """
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("doc", "block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad")
    )
    splits = splits.withColumn("file", whole)
    # files of one text stand in the order of their names; those of write_values by task and number, which may be of any length
    ours = "/piece=(?:all|cut)/"
    number = [F.regexp_extract("doc", ours + p, 1).try_cast("long") for p in (r"part-(\d+)-[^/]*$", r"[^/]*\.c(\d+)\.[^/]*$")]
    before = Window.partitionBy("file").orderBy(*number, "doc", "block").rowsBetween(Window.unboundedPreceding, -1)
    places = splits.select(
        "doc",
        "block",
        "file",
        "_first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.max("bad").over(Window.partitionBy("file")).alias("void"),
    )
    placed = marked.join(places, ["doc", "block"]).withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first"))
    return placed.drop("_id", "_first", "_before")


def read_lines(spark: SparkSession, path: str, glob: str | None = None, by_folder: bool = False) -> DataFrame:
    """``(doc, ln, line)``: lines of every file with their numbers from 1, without holding any file whole.

    Files are cut into splits of ``spark.sql.files.maxPartitionBytes``; bytes that are not UTF-8 become U+FFFD. With
    ``by_folder`` the files of a folder, in the order of their names, are one text, and ``doc`` is the folder.
    """
    whole = F.regexp_replace("doc", "/[^/]*$", "") if by_folder else F.col("doc")
    placed = _numbered(_split_lines(spark, path, glob), whole, F.lit(False))
    return placed.select(F.col("file").alias("doc"), (F.col("pos") + 1).alias("ln"), "line")


def read_values(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(file, pos, v)``: one number per line, blank lines skipped.

    A line that is no number voids its whole file: the file then has a single row with null
    position and value. The pieces of a case that :func:`write_values` cut are one file, named after
    their folder: positions run on, and a bad line voids all of them. A file of any size is read in splits by many
    tasks.
    """
    # a cast trims by itself, so only what is no number is looked at again to tell blank lines
    numbers = _split_lines(spark, path, glob).withColumn("v", F.col("line").try_cast("double"))
    values = numbers.filter(F.col("v").isNotNull() | F.col("line").rlike(r"\S")).select("doc", "block", "v")
    whole = F.regexp_replace("doc", r"/piece=(?:all|cut|[0-9]{6}-[0-9]{8})/[^/]*$", "")
    placed = _numbered(values, whole, F.col("v").isNull())
    # a void file has a first value or bad line, which becomes its row
    kept = placed.filter(~F.col("void") | (F.col("pos") == 0))
    return kept.select("file", *[F.when(~F.col("void"), F.col(c)).alias(c) for c in ("pos", "v")])


def parse_values(files: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """``(key, pos, v)`` from texts with one number per line; see :func:`read_values`."""
    trimmed = F.filter(F.transform(lines_of(F.col(text)), strip_ws), lambda x: x != "")
    parsed = F.transform(trimmed, lambda x: x.try_cast("double"))
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("double").alias("v")))

    def numbered(numbers: Column) -> Column:
        rows = F.transform(numbers, lambda v, n: F.struct(n.cast("int").alias("pos"), v.alias("v")))
        return F.when(F.exists(numbers, lambda v: v.isNull()), nothing).otherwise(rows)

    keep = [*(keep or []), key]
    return files.select(*keep, F.explode(bound(parsed, numbered)).alias("_n")).select(*keep, "_n.pos", "_n.v")


def write_values(df: DataFrame, path: str, keys: list[str], lines_per_file: int = 5_000_000) -> None:
    """Write ``(keys, arg_ord, pos, v)`` as text, one number per line, below ``key=`` folders.

    Lines are in argument order, then position, at most ``lines_per_file`` in a file: a case of no more lines is one
    file. A case with an argument longer than that is dealt over tasks by argument and block of
    positions. All files of a case lie in one folder and are numbered in line order by task and file; reading joins them
    again. Rows are dealt by ranges, so a task has few cases, and it puts its own files in place.
    """
    block = F.floor(F.col("pos") / F.lit(lines_per_file))
    long_cases = (
        df.filter(F.col("pos") >= lines_per_file).select(*keys).distinct().withColumn("_long", F.lit(True))
    )
    place = F.when(F.col("_long"), F.struct(F.col("arg_ord").cast("long").alias("arg_ord"), block.alias("block")))
    piece = F.when(F.col("_long"), "cut").otherwise("all")
    placed = lookup_join(df, long_cases, keys, "left").withColumns({"piece": piece, "_place": place})
    (
        placed.repartitionByRange(*keys, "_place")
        .sortWithinPartitions(*keys, "piece", "arg_ord", "pos")
        .select(*keys, "piece", F.col("v").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", lines_per_file)
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy(*keys, "piece")
        .text(path)
    )


def write_report(df: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Write rendered lines in order. The files sort by name into one report."""
    df.orderBy(*order).select(F.col(line).alias("value")).write.text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``(line)`` of a written report."""
    return spark.read.text(path).withColumnRenamed("value", "line")
