"""Order MinHash fingerprints: sensitive to edit distance, not only to the set of k-mers.

The k-mers of a text (``K`` code points) are numbered by occurrence. Each of ``SKETCHES``
functions orders the numbered k-mers; the ``TUPLE`` least ones are put back into the order of the text and
hashed as a tuple. Likeness is the share of equal tuples. A text shorter than ``K`` is one k-mer; a null
text counts as empty; repeated rows get equal fingerprints.

``edited_neighbours`` compares each document with its edited form and with the next
document by ascending id (then text; a null id comes first), the first following the last.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.words import column, mix

K = 6
SKETCHES = 32
TUPLE = 2
BLOCK = 1 << 16
LEAST_ID = -(1 << 63)

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_ORDERS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def numbered_kmers(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k-mer with its occurrence number, hash of the k-mer alone, and its place."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(1, len(codes) - K + 1)
    h = np.zeros(n, dtype=np.uint64)
    if len(codes) >= K:
        for j in range(K):
            h = h * _STEP + codes[j : j + n]
    else:
        for c in codes:
            h = h * _STEP + c
    h = mix(h)
    low = (np.uint64(1) << np.uint64(max(1, int(n).bit_length()))) - np.uint64(1)
    packed = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    place = packed & low
    kmer = h[place]
    new = kmer[1:] != kmer[:-1]
    if np.any(new & ((packed[1:] ^ packed[:-1]) <= low)):  # unequal k-mers with equal upper bits
        place = np.argsort(h, kind="stable").astype(np.uint64)
        kmer = h[place]
        new = kmer[1:] != kmer[:-1]
    first = np.zeros(n, dtype=np.int64)
    new = np.flatnonzero(new) + 1
    first[new] = new
    number = np.arange(n) - np.maximum.accumulate(first)
    return mix(kmer + number.astype(np.uint64) * _GOLD), kmer, place


def sketch(text: str) -> np.ndarray:
    """The tuple hashes of a text, 32 bits each."""
    value, kmer, place = numbered_kmers(text)
    n, least = len(value), min(TUPLE, len(value))
    out = np.empty(SKETCHES, dtype=np.uint64)
    at_once = max(1, BLOCK // n)
    for a in range(0, SKETCHES, at_once):
        orders = _ORDERS[a : a + at_once]
        ranks = value[None, :] * orders[:, None]
        rows = np.arange(len(orders))
        chosen = np.empty((len(orders), least), dtype=np.int64)
        for j in range(least):
            chosen[:, j] = ranks.argmin(axis=1)
            ranks[rows, chosen[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        in_text = np.take_along_axis(chosen, np.argsort(place[chosen], axis=1), axis=1)
        h = orders.copy()
        for j in range(least):
            h = mix(h * _STEP + kmer[in_text[:, j]] + np.uint64(j + 1))
        out[a : a + at_once] = h
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (hexadecimal) of each row."""

    def run(batches):
        for batch in batches:
            found = [_hex(sketch(t or "")) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``; looked up in two steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(v).cast("long") for v in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda b: b <= key))
    within = F.size(F.filter(F.element_at(inner, block), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * width + within).cast("int")


def by_ascending_id(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, key, text: rows dealt by ranges of the id and sorted in each bucket.

    The first document of a bucket stands once more at the end (``tail``) of the bucket before it,
    so every document finds its next one in its own task and no task needs another's rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(LEAST_ID)).cast("long").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile(
        "doc_id", [i / n for i in range(1, n)], 1 / (4 * n)
    )
    bounds = sorted({int(c) for c in cuts})
    placed = keyed.withColumn("bucket", _bucket(F.col("key"), bounds))
    firsts = sorted(
        (r["bucket"], r["key"]) for r in placed.groupBy("bucket").agg(F.min("key").alias("key")).collect()
    )
    buckets = [F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("tail"))]
    copy = F.lit(None).cast("int")
    if firsts:
        before = [firsts[i - 1][0] for i in range(len(firsts))]
        table = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(b).alias("before")) for (_, k), b in zip(firsts, before)])
        position = F.array_position(F.array(*[F.lit(b) for b, _ in firsts]), F.col("bucket")).cast("int")
        mine = F.element_at(table, position)
        copy = F.when(mine["key"] == F.col("key"), mine["before"])
    buckets.append(F.when(copy.isNotNull(), F.struct(copy.alias("bucket"), F.lit(1).alias("tail"))))
    return (
        placed.withColumn("_to", F.explode(F.array_compact(F.array(*buckets))))
        .select("_to.bucket", "_to.tail", "doc_id", "key", "text")
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "tail", "key", "text")
    )


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest and fingerprints of the text and its edited form, two likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(doc, text, own, following, next_own):
        changed = edited(text, following)
        other = sketch(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        return doc, len(text), digest, _hex(own), _hex(other), likeness(own, other), likeness(own, next_own)

    def run(batches):
        waiting, bucket = None, None
        for batch in batches:
            out = []
            cells = [column(batch, c) for c in ("bucket", "tail", "doc_id", "text")]
            for i in range(batch.num_rows):
                b, tail, doc, text = (c[i].as_py() for c in cells)
                if b != bucket:
                    waiting, bucket = None, b
                if tail and waiting is None:
                    continue
                own = sketch(text)
                if waiting is not None:
                    out.append(compare(*waiting, text, own))
                waiting = None if tail else (doc, text, own)
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return by_ascending_id(docs).mapInArrow(run, schema)
