"""Packing of tokenised documents into fixed-length sequences by bounded-space best fit.

Tokenising: pieces between single spaces (a line break starts a piece of its own) are encoded once per
worker and cached as bytes; a text with other white space or with a special string in it is encoded
whole by the library. Pieces of plain Latin characters are encoded by the file's own vocabulary as
merge ranks, which is faster; each worker first compares its first pieces with the library, which encodes
all of them if any differs. So ids are always the library's. A document gets ``END`` appended and is cut, from its end, into
pieces of ``LENGTH`` tokens; only the first may be shorter.

Packing: full pieces are sequences by themselves. The others are dealt into groups of about
``GROUP_PIECES`` by a hash of the document id. In each group pieces arrive in hash order and go to
the open bin with the least sufficient space. At most ``OPEN_BINS`` bins are open; they
are found by a bit set keyed by free space, and when another one must open, the fullest closes.
A recomputed group repeats its choices. Null texts count as empty (one piece, the end
token), repeated rows are packed one by one, an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.words import chunks, column
from sparkrecon.plans.lineage import scratch_path

LENGTH = 1_024
END = 2
OPEN_BINS = 2_048
GROUP_PIECES = 100_000
CACHE = 600_000
COMPARED = 5_000
PLAIN = re.compile(r"[\n -~À-ÿ]*")
# fixed value: how byte-level vocabularies split text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_tokenizers: dict = {}
_caches: dict = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def rank_encoder(path: str):
    """Function from a plain text to its ids by merge ranks; None if the file's ids are no ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    # byte-level vocabularies write printable bytes as themselves, the others as characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in read.get("added_tokens", [])}
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in read["model"]["vocab"].items()
        if token not in added and all(c in byte_of for c in token)
    }
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _is_regular(piece: str, special: list[str]) -> bool:
    """One word, after at most one line break, that no special string is in."""
    word = piece[1:] if piece[:1] == "\n" else piece
    return word.split() == [word] and not any(s in piece for s in special)


class Ids:
    """Ids, as bytes, by piece. A piece stands after one space, or starts with its line break."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        self.by_rank, self.compared = rank_encoder(path), 0
        self.special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers."""
        cut = [text.replace("\n", " \n").split(" ") for text in texts]
        # the first piece has no space before it: it is looked up with a mark that no other piece has
        for pieces in cut:
            pieces[0] = f" {pieces[0]}"
        unknown = {p for pieces in cut for p in pieces if p not in self.known}
        if len(self.known) + len(unknown) > CACHE:
            self.known.clear()
            unknown = {p for pieces in cut for p in pieces}
        found = self.known
        inner = [p for p in unknown if p[:1] != " " and _is_regular(p, self.special)]
        first = [p for p in unknown if p[:1] == " " and p[1:2] != "\n" and _is_regular(p[1:], self.special)]
        bare = [p if p[0] == "\n" else f" {p}" for p in inner] + [p[1:] for p in first]
        for piece, ids in zip(inner + first, self._pieces(bare)):
            found[piece] = ids
        out: list[bytes | None] = []
        for pieces in cut:
            try:
                out.append(b"".join(map(found.__getitem__, pieces)))
            except KeyError:
                out.append(None)
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._batch([texts[i] for i in whole])):
            out[i] = ids
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_rank is not None and PLAIN.fullmatch(t) is not None for t in texts]
        fast = [array("I", self.by_rank(t)).tobytes() if p else None for t, p in zip(texts, plain)]
        if self.by_rank is not None and self.compared < COMPARED and any(plain):
            self.compared += sum(plain)
            library = self._batch(texts)
            if any(a is not None and a != b for a, b in zip(fast, library)):
                self.by_rank, self.known = None, {k: v for k, v in self.known.items() if not PLAIN.fullmatch(k)}
            return library
        rest = iter(self._batch([t for t, p in zip(texts, plain) if not p]))
        return [next(rest) if ids is None else ids for ids in fast]

    def _batch(self, texts: list[str]) -> list[bytes]:
        done = tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in done]


def document_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of each document."""
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches):
        if tokenizer_path not in _caches:
            _caches[tokenizer_path] = Ids(tokenizer_path)
        known = _caches[tokenizer_path]
        for batch in batches:
            out: list[tuple] = []
            for part in chunks(batch):
                texts = [t or "" for t in column(part, "text").to_pylist()]
                for doc, ids in zip(column(part, "doc_id").to_pylist(), known.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    begin, stop, k = 0, n % length or length, 0
                    while begin < n:
                        out.append((doc, k, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop])))
                        begin, stop, k = stop, stop + length, k + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cells = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin number and offset per item, in arrival order."""
    free_bits = 0
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open, n_bins = 0, 0
    bins, offsets = [], []
    for need in lengths:
        fitting = free_bits >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            chosen = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
            chosen, free = n_bins, capacity
            n_bins += 1
            n_open += 1
        bins.append(chosen)
        offsets.append(capacity - free)
        left = free - need
        if left:
            by_free[left].append(chosen)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with doc_id, piece, start, length, ids_crc32.

    ``pieces`` is read twice; give a stored table.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    short = pieces.filter(F.col("length") < length)
    groups = max(1, -(-short.count() // GROUP_PIECES))
    full = pieces.filter(F.col("length") == length).select(
        *names,
        # negative numbers, so they differ from those of the groups; unique by construction
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    key = F.xxhash64("doc_id", F.lit(7))
    dealt = short.select(
        *names,
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int").alias("_group"),
        key.alias("_key"),
    )

    def run(keys, table):
        table = table.sort_by([(c, "ascending") for c in ("_key", "doc_id", "piece", "ids_crc32", "length")])
        bins, offsets = best_fit(table.column("length").to_pylist(), length, open_bins)
        base = keys[0].as_py() << 32
        return (
            table.select(names)
            .append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInArrow(run, schema)
    return full.unionByName(packed)


def packed_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of all ``docs`` with their place in sequences of at most ``length`` tokens.

    Pieces are stored below the shared folder, so tokenising runs once.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    document_pieces(docs, tokenizer_path, length).write.parquet(path)
    return pack(spark.read.parquet(path), length)
