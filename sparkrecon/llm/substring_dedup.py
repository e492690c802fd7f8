"""Removal of passages that an earlier document holds, with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words. Its words are removed when the same window starts in a
document with a smaller id, judged on the input.

The reference is the whole corpus, so its automata cannot be broadcast with a proven bound. They are
sharded by content instead: every window picks its least ``GRAM``-word hash as its anchor, so equal
windows always meet in the shard of their anchor, and documents are streamed only against
the shards they share an anchor with.

1. Runs of windows with one anchor are listed with a hash of their words, the segment; anchors of a
   single document are dropped.
2. Equal segments are aggregated to the least id that has them, its owner: a document with a larger
   id loses the whole segment. No text moves up to here.
3. Anchors with several different segments may share windows between those. The words of these segments are
   cut from their owners and form shards; each builds an automaton whose states carry the least
   id, and streams its segments for the matching statistic, capped at the window.
4. An anchor with more than ``HOT`` different segments is not put into one shard: the windows of its segments are
   aggregated by their hash instead.

Rows without an id, null texts and texts under a window lose nothing; repeated ids are told apart by a
hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.words import chunks, column, mix, ngrams, texts_of
from sparkrecon.llm.words import _power as power
from sparkrecon.plans.lineage import scratch_path

WINDOW = 50
GRAM = 8
HOT = 1_000
SHARD_SEGMENTS = 400
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def anchor_runs(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Anchor hash, first window, number of windows and row of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    grams, first = ngrams(hashes, offsets, GRAM)
    n, width = len(hashes), window - GRAM + 1
    if n < window:
        return np.zeros(0, np.uint64), none, none, none
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[first] = (grams & ~low) | first.astype(np.uint64)
    least, span = packed, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    shift = width - span
    if shift:
        least = np.minimum(least[:-shift], least[shift:])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + window <= row_end)
    at = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    by_place = np.zeros(n, dtype=np.uint64)
    by_place[first] = grams
    begin = starts[head]
    return by_place[at[head]], begin, count, np.searchsorted(offsets, begin, side="right") - 1


def run_table(docs: DataFrame) -> DataFrame:
    """anchor, h1, doc_id, th, start, count of every run; words are counted from 0 in their document.

    A segment is told by its anchor and ``h1``, 64 bits each.
    """

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                x = texts_of(column(piece, "text"))
                offsets = x.words()[2]
                hashes = x.word_hashes()
                anchor, begin, count, row = anchor_runs(hashes, offsets)
                h1, _ = span_digests(hashes, begin, begin + count + WINDOW - 1)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64), pa.int64()),
                        pa.array(h1, pa.int64()),
                        column(piece, "doc_id").take(rows),
                        column(piece, "th").take(rows),
                        pa.array(begin - offsets[row], pa.int32()),
                        pa.array(count, pa.int32()),
                    ],
                    ["anchor", "h1", "doc_id", "th", "start", "count"],
                )

    return docs.mapInArrow(run, "anchor long, h1 long, doc_id long, th long, start int, count int")


def span_digests(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of words."""
    out = []
    for values in (hashes, mix(hashes ^ _OTHER)):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power("up", len(values)), out=total[1:])
        h = (total[end] - total[begin]) * power("down", len(values) + 1)[begin]
        out.append(mix(h + (end - begin).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def segment_words(docs: DataFrame, owned: DataFrame) -> DataFrame:
    """``owned`` (anchor, h1, first, th, start, count, n) with the words of each segment, from its owner's text."""
    cells = ["anchor", "h1", "start", "count", "n"]
    lists = owned.groupBy(F.col("first").alias("doc_id"), "th").agg(F.collect_list(F.struct(*cells)).alias("owned"))
    joined = docs.join(lists, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    joined = joined.select("doc_id", "text", *[F.col(f"owned.{c}").alias(c) for c in cells])

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                x = texts_of(column(piece, "text"))
                first, last, offsets = x.words()
                raw = x.raw.tobytes()
                row = np.repeat(np.arange(x.n), np.diff(column(piece, "anchor").offsets.to_numpy()))
                flat = {c: column(piece, c).flatten() for c in cells}
                begin = flat["start"].to_numpy().astype(np.int64) + offsets[row]
                end = begin + flat["count"].to_numpy() + WINDOW - 1
                words = [b" ".join(raw[a:b].split()) for a, b in zip(first[begin].tolist(), last[end - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        flat["anchor"],
                        flat["h1"],
                        column(piece, "doc_id").take(pa.array(row, pa.int64())),
                        flat["n"],
                        pa.array(words, pa.binary()),
                    ],
                    ["anchor", "h1", "first", "n", "words"],
                )

    return joined.mapInArrow(run, "anchor long, h1 long, first long, n long, words binary")


class Automaton:
    """Suffix automaton of word sequences; a state carries the least id of a sequence it occurs in."""

    def __init__(self):
        self.go: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.least: list[int | None] = [None]

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.go) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.least[copy] = self.least[q]
        self.link[q] = copy
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.go[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.go[p]:
                    self.go[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.go[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            if self.least[last] is None or doc < self.least[last]:
                self.least[last] = doc

    def close(self) -> None:
        """Hand the least ids down the suffix links."""
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.least[state] is not None and (self.least[up] is None or self.least[state] < self.least[up]):
                self.least[up] = self.least[state]

    def statistics(self, words: list[bytes], window: int):
        """Matched length, capped at ``window``, and least id of the match at each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.go[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.go[state]:
                state, length = self.go[state][word], length + 1
            while length > window or self.length[self.link[state]] >= window:
                if self.length[self.link[state]] >= window:
                    state = self.link[state]
                length = min(length, window)
            yield length, self.least[state]


def earlier_windows(segments: list[tuple[list[bytes], int]], window: int = WINDOW) -> list[list[int]]:
    """Per segment (words, least id): its windows that occur in a segment with a smaller id."""
    shard = Automaton()
    for words, doc in segments:
        shard.add(words, doc)
    shard.close()
    out = []
    for words, doc in segments:
        hits = []
        for j, (length, least) in enumerate(shard.statistics(words, window)):
            if length == window and least < doc:
                hits.append(j - window + 1)
        out.append(hits)
    return out


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removable_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, and arrays of the starts and ends (exclusive) of word spans to remove."""
    named = docs.filter("doc_id is not null")
    runs = _stored(run_table(named), "runs")
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    rows = _stored(runs.join(shared.select("anchor"), "anchor"), "shared")
    key = ["anchor", "h1"]
    firsts = _stored(rows.groupBy(*key).agg(F.min("doc_id").alias("first")), "firsts")
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mixed = firsts.join(several, "anchor")
    owned = rows.withColumnRenamed("doc_id", "first").join(mixed, [*key, "first"])
    # an owner may hold a segment several times: any will do
    owned = owned.groupBy(*key, "first", "n", "count").agg(F.min("th").alias("th"), F.min_by("start", "th").alias("start"))
    owners = _stored(segment_words(named, owned).withColumn("hot", F.col("n") > HOT), "owners")
    shards = max(1, -(-owners.filter("not hot").count() // SHARD_SEGMENTS))

    def stream(keys, table):
        table = table.sort_by([(c, "ascending") for c in ("anchor", "h1")])
        cells = [table.column(c).to_pylist() for c in ("anchor", "h1", "first", "words")]
        distinct = {(a, h): (w.split(b" "), d) for a, h, d, w in zip(*cells)}
        hits = earlier_windows(list(distinct.values()))
        found = [(*k, h) for k, h in zip(distinct, hits) if h]
        columns = list(zip(*found)) or [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*key, "hits"])

    hit_schema = "anchor long, h1 long, hits array<int>"
    cold = (
        owners.filter("not hot")
        .withColumn("shard", F.pmod("anchor", F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(stream, hit_schema)
    )

    def windows(batches):
        for batch in batches:
            x = texts_of(column(batch, "words").cast(pa.large_binary()).view(pa.large_string()))
            _, _, offsets = x.words()
            count = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
            row = np.repeat(np.arange(x.n), count)
            i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = offsets[row] + i
            w1, w2 = span_digests(x.word_hashes(), begin, begin + WINDOW)
            rows_ = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c).take(rows_) for c in (*key, "first")], pa.array(i, pa.int32()), pa.array(w1), pa.array(w2)],
                [*key, "first", "i", "w1", "w2"],
            )

    hot = owners.filter("hot").dropDuplicates(key).select(*key, "first", "words")
    single = hot.mapInArrow(windows, "anchor long, h1 long, first long, i int, w1 long, w2 long")
    if not owners.filter("hot").isEmpty():
        single = _stored(single, "windows")
        least = single.groupBy("w1", "w2").agg(F.min("first").alias("m"))
        late = single.join(least, ["w1", "w2"]).filter("m < first")
        cold = cold.unionByName(late.groupBy(*key).agg(F.collect_list("i").alias("hits")))
    spans = (
        rows.join(firsts, key)
        .join(cold, key, "left")
        .withColumn("whole", F.col("doc_id") > F.col("first"))
        .filter("whole or hits is not null")
        .select(
            "doc_id",
            "th",
            F.when(F.col("whole"), F.array("start")).otherwise(F.transform("hits", lambda i: i + F.col("start"))).alias("s"),
            F.when(F.col("whole"), F.col("count") + WINDOW - 1).otherwise(WINDOW).alias("w"),
        )
    )
    one = spans.select("doc_id", "th", F.explode("s").alias("s"), "w")
    return one.groupBy("doc_id", "th").agg(F.collect_list("s").alias("starts"), F.collect_list("w").alias("widths"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans = removable_spans(keyed)
    joined = keyed.join(spans, ["doc_id", "th"], "left")

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                texts = column(piece, "text").to_pylist()
                starts, widths = column(piece, "starts").to_pylist(), column(piece, "widths").to_pylist()
                n, removed, digests = [], [], []
                for text, s, w in zip(texts, starts, widths):
                    words = (text or "").encode().split()
                    if s:
                        cover = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(cover, s, 1)
                        np.add.at(cover, np.array(s) + np.array(w), -1)
                        gone = np.cumsum(cover)[:-1] > 0
                        kept = [word for word, out in zip(words, gone.tolist()) if not out]
                    else:
                        kept = words
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return joined.select("doc_id", "text", "starts", "widths").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
