"""Token counts of whole texts by a two-tier lookup on the map side.

Pre-tokens are the pieces between single spaces; a line break starts a piece of its own. No piece
of the vocabulary crosses such a place, so the length of a text is the sum over its pieces.
The first tier is a broadcast table of the lengths of frequent pre-tokens: every partition keeps
its ``PER_PARTITION`` most frequent ones, and the ``TABLE`` most frequent of all of those are
encoded once (a bounded table; no pre-token is shuffled but these summaries). Misses are encoded by the
worker and cached there, at most ``CACHE`` of them.

A text with other white space, doubled spaces or the space mark U+2581 is encoded whole, so the
count is always the library's. Null texts count as empty (0 tokens); repeated rows are counted
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.words import column

PER_PARTITION = 4_096
TABLE = 32_768
CACHE = 400_000
SPACE_MARK = "▁"

_processors: dict = {}
_caches: dict = {}


class Irregular(Exception):
    """A piece whose length cannot be taken by itself."""


def processor(path: str):
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def pre_tokens(text: str) -> list[str]:
    return text.replace("\n", " \n").split(" ")


def is_regular(piece: str) -> bool:
    """One word without white space, after at most one line break."""
    word = piece[1:] if piece[:1] == "\n" else piece
    return piece != "" and SPACE_MARK not in piece and (word == "" or word.split() == [word])


def piece_length(piece: str, path: str) -> int:
    if not is_regular(piece):
        raise Irregular
    # a text starts with a space mark of its own; after a line break there is none
    return len(processor(path).encode(piece)) - (piece[0] == "\n")


class Lengths(dict):
    """Lengths by pre-token: the frequent ones are given, others are encoded when first met."""

    def __init__(self, frequent: dict[str, int], path: str):
        super().__init__(frequent)
        self.path, self.most = path, len(frequent) + CACHE

    def __missing__(self, piece: str) -> int:
        n = piece_length(piece, self.path)
        if len(self) < self.most:
            self[piece] = n
        return n


def text_length(text: str, lengths: Lengths) -> int:
    if text == "":
        return 0
    try:
        return sum(map(lengths.__getitem__, pre_tokens(text)))
    except Irregular:
        return len(processor(lengths.path).encode(text))


def frequent_pre_tokens(docs: DataFrame, per_partition: int = PER_PARTITION, table: int = TABLE) -> list[str]:
    """The pre-tokens that partitions see most often, over all rows; at most ``table`` of them."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                if text:
                    seen.update(pre_tokens(text))
                    if len(seen) > 40 * per_partition:
                        seen = Counter(dict(seen.most_common(10 * per_partition)))
        top = [(p, n) for p, n in seen.most_common(per_partition) if is_regular(p)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            ["piece", "n"],
        )

    counted = docs.select("text").mapInArrow(run, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table)
    return [r["piece"] for r in top.collect()]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4_096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    spark = docs.sparkSession
    frequent = {p: piece_length(p, model_path) for p in frequent_pre_tokens(docs)}
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches):
        key = (model_path, shared.id if hasattr(shared, "id") else id(shared.value))
        if key not in _caches:
            _caches.clear()
            _caches[key] = Lengths(shared.value, model_path)
        lengths = _caches[key]
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            tokens = [text_length(t, lengths) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
