"""A fixed-size bit table of ids, that keeps most rows of other ids from being moved; a join decides."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrecon.llm.words import column, mix

LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 26, 20
_SEED = np.uint64(0xD6E8FEB86659FD93)


def id_table(ids: DataFrame):
    """Bits of the table of ``ids`` (id) and the table itself, a broadcast; see :func:`marked`."""
    bits = min(max((16 * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)
    return bits, ids.sparkSession.sparkContext.broadcast(id_filter(ids, bits))


def id_filter(ids: DataFrame, bits: int):
    """A bit per hash of ``id``, set when some row has it; packed bytes, made in slices."""
    size = 1 << bits
    width = min(size, 1 << SLICE_BITS) // 8

    def packed(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
        blobs = [zlib.compress(v.tobytes(), 1) for v in slices.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array(blobs, pa.binary())], ["s", "c"])

    def mark(batches):
        seen = np.zeros(size, dtype=bool)
        for batch in batches:
            seen[_place(column(batch, "id"), bits)] = True
        table = np.packbits(seen)
        yield packed({i // width: table[i : i + width] for i in range(0, size // 8, width)})

    def either(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(column(batch, "s").to_pylist(), column(batch, "c").to_pylist()):
                values = np.frombuffer(zlib.decompress(c), np.uint8)
                found[s] = found[s] | values if s in found else values
        yield packed(found)

    parts = ids.mapInArrow(mark, "s int, c binary").repartition(size // 8 // width, "s").mapInArrow(either, "s int, c binary")
    rows = {r["s"]: r["c"] for r in parts.collect()}  # size / 2 ** SLICE_BITS rows
    table = np.zeros(size // 8, np.uint8)
    for s, c in rows.items():
        table[s * width : (s + 1) * width] = np.frombuffer(zlib.decompress(c), np.uint8)
    return table


def marked(ids: pa.Array, table: np.ndarray, bits: int) -> pa.Array:
    """Whether the bit of each id is set: always for the ids of the table, rarely for others."""
    place = _place(ids, bits)
    return pa.array(((table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool))


def likely(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose column ``name`` is, by the bit table, one of ``ids`` (id)."""
    bits, table = id_table(ids)

    def run(batches):
        for batch in batches:
            yield batch.filter(marked(column(batch, name), table.value, bits))

    return df.mapInArrow(run, df.schema)


def _place(ids: pa.Array, bits: int) -> np.ndarray:
    h = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SEED)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
