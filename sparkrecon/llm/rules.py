"""Quality rules judged per host: failures by domain, shrunk with an empirical beta prior.

Each document gets counts from its text and fails or passes each of ``RULES``. Failures are
summed per host (here the ``source`` column). Rates of small hosts are drawn to the corpus rate
by a beta prior fitted to all hosts by moments; a host is rejected when, for some rule, the
lower end of its posterior rate lies above ``MAX_RATE``. The verdict joins back to documents.

Null texts count as empty, null hosts form one host of their own, repeated rows are judged one by
one, an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.words import Texts, chunks, column, mix, ngrams, row_of, texts_of
from sparkrecon.plans.lineage import scratch_path

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_RATE = 0.5
Z = 1.645
HOST_SLOTS = 16

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def seen_before(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of rows: is there an equal item earlier in the sort, is there any equal one."""
    key = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return later, shared


def text_counts(x: Texts) -> list[np.ndarray]:
    """The columns of ``COUNTS`` for the texts of a chunk."""
    starts, _, offsets = x.words()
    n_words = np.diff(offsets)
    gap = np.isin(x.raw, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    chars = per_row(~gap & ((x.raw & 0xC0) != 0x80), x.at)
    symbols = per_row(_SYMBOL[x.raw], x.at)

    first, last, of_row = x.lines()
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    rows = row_of(of_row)[worded]
    later, _ = seen_before(x.span_hashes(first[worded], last[worded]), rows)
    dup_lines = np.bincount(rows[later], minlength=x.n)

    grams, at = ngrams(x.word_hashes(), offsets, 3)
    _, shared = seen_before(grams, row_of(offsets)[at])
    cover = np.zeros(len(starts) + 4, dtype=np.int64)
    np.add.at(cover, at[shared], 1)
    np.add.at(cover, at[shared] + 3, -1)
    repeats = per_row(np.cumsum(cover)[: len(starts)] > 0, offsets)
    return [n_words, chars, symbols, dup_lines, repeats]


def document_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of each document."""
    source = docs.select(*keep, "text")
    schema = [*source.drop("text").schema.fields]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], *[f"{c} long" for c in COUNTS]])

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                counts = text_counts(texts_of(column(piece, "text")))
                yield pa.RecordBatch.from_arrays(
                    [*[column(piece, f.name) for f in schema], *[pa.array(c, pa.int64()) for c in counts]],
                    [*[f.name for f in schema], *COUNTS],
                )

    return source.mapInArrow(run, out)


def rules() -> dict[str, Column]:
    """Rule name to a test that a failing document meets."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > n,
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
    }


def host_verdicts(counted: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures per rule, ``host_rejected``."""
    names = list(rules())
    hosts = counted.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(test.cast("long")).alias(name) for name, test in rules().items()]
    )
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in names],
        *[F.sum(F.col(c) * F.col(c) / F.col("n")).alias(f"{c}_sq") for c in names],
    ).first()
    rejected = F.lit(False)
    for name in names:
        alpha, beta = beta_prior(sums["hosts"], sums["n"] or 0, sums[name] or 0, sums[f"{name}_sq"] or 0.0)
        a = F.col(name) + alpha
        b = F.col("n") - F.col(name) + beta
        low = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        rejected = rejected | (low > MAX_RATE)
    return hosts.withColumn("host_rejected", rejected)


def beta_prior(hosts: int, n: int, failed: int, squares: float) -> tuple[float, float]:
    """Beta parameters from the mean and the spread of host rates, sampling noise taken off.

    ``squares`` is the sum over hosts of failures squared divided by documents.
    """
    if n == 0:
        return 1.0, 1.0
    mean = min(max(failed / n, 1e-6), 1 - 1e-6)
    noise = mean * (1 - mean) * hosts / n
    spread = max(squares / n - mean * mean - noise, 1e-9)
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 10_000.0)
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``host_rejected`` and ``kept`` per document.

    The counts are stored once below the shared folder: the host table and the join both read
    them. Each host verdict is repeated ``HOST_SLOTS`` times and documents choose a slot by
    their id, so a host with a third of all documents is spread even without adaptive joins.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "rules")
    document_counts(docs, "doc_id", host).write.parquet(path)
    counted = spark.read.parquet(path)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = host_verdicts(counted, host).select(
        F.col(host).alias("_host"),
        "host_rejected",
        F.explode(F.sequence(F.lit(0), F.lit(HOST_SLOTS - 1))).alias("_of"),
    )
    slotted = counted.withColumn(
        "_slot", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(HOST_SLOTS)).cast("int")
    )
    joined = slotted.join(
        verdicts, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_slot") == F.col("_of")), "left"
    )
    return joined.select(
        "doc_id",
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
        F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
    )
