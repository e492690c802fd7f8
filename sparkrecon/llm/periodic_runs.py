"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, of ``max(6, 4q)`` words or more, that no
neighbouring word extends keeping period q.

1. Prefix doubling over the words of a chunk sorts the suffixes of each text (a text's suffixes stay
   together, words of different texts never compare). After step k every group of equal ranks holds
   the places of one factor of 2^k words, so an aligned (dyadic) block knows its range of the suffix array.
2. A wavelet matrix over the suffix array answers the range successor: the first, second and
   last place of the block among starts b to 2b-1 words after it (b = 2^k). A run of period b <= q < 2b and
   4q words holds an aligned block within its first 2b words, which occurs again q words on.
3. Those places are one arithmetic progression, as the window is at most twice the block. One or two
   places are candidate periods. Three or more differ by the block's own period d; both stretches of
   period d around the block and around the progression end q words apart, which leaves one candidate.
   Equal neighbours (blocks of one word, whose window is one place) are compared directly.
4. A candidate is extended in both directions with the ranks of all steps; equal stretches keep their least period.

Texts never leave their row: one map stage, no shuffle. Memory is bounded by ``CHUNK_BYTES`` of text or one
longer text, times its number of doubling steps (4 bytes a word and step).

Null and blank texts have no words and no run. A row with a null id is scanned unedited. Repeated rows, empty
tables and further columns, whatever their names, change nothing: only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrecon.llm.words import Texts, chunks, column, row_of, texts_of

LEAST_WORDS, LEAST_EXPONENT = 6, 4
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


class WaveletMatrix:
    """Counts and order statistics of ``values[lo:hi]``, for many ranges at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit) & 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - one, out=zeros[1:])
            self.before.append(zeros)
            self.zeros.append(int(zeros[-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of each range are less than ``limit`` (at most ``2 ** bits``)."""
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        count = np.where(limit >> self.bits > 0, hi - lo, 0)
        for level, (zeros, total) in enumerate(zip(self.before, self.zeros)):
            one = ((limit >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            count += np.where(one & (limit >> self.bits == 0), b - a, 0)
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) within each range."""
        lo, hi, k = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64)
        value = np.zeros(len(lo), np.int64)
        for level, (zeros, total) in enumerate(zip(self.before, self.zeros)):
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = k >= b - a
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return value


class Factors:
    """Ranks of all factors of 1, 2, 4, ... words, the suffix array and the ranges of aligned blocks.

    ``at`` holds the offsets of the texts in ``symbols``. ``blocks[k]`` lists the aligned blocks of 2^k words
    that occur again in their text: place, and range [lo, hi) of the suffix array.
    """

    def __init__(self, symbols: np.ndarray, at: np.ndarray):
        n = len(symbols)
        self.n, row = n, row_of(at)
        self.start, self.end = at[:-1][row].astype(np.int32), at[1:][row].astype(np.int32)
        order = np.lexsort((symbols, row))
        rank, active = self._grouped(order, (row[order], symbols[order]), np.zeros(n, np.int32), np.zeros(n, np.int64))
        self.ranks, self.blocks, step = [rank], [], 1
        while True:
            self.blocks.append(self._aligned(active, rank, step))
            if not len(active):
                break
            # the rest of a suffix that ends here is before all others
            beyond = active + step
            following = np.where(beyond < self.end[active], rank[np.minimum(beyond, n - 1)], -1)
            first = rank[active]
            by = np.lexsort((following, first))
            rank, active = self._grouped(active[by], (first[by], following[by]), rank.copy(), first[by])
            self.ranks.append(rank)
            step *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[rank] = np.arange(n, dtype=np.int32)

    @staticmethod
    def _grouped(places, keys, rank, base):
        """Ranks of ``places``, sorted by ``keys``; those that share their rank stay active.

        A group keeps the room its ``base`` rank had: the rank of a place is where its group begins.
        """
        n = len(places)
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = np.any([k[1:] != k[:-1] for k in keys], axis=0) if n > 1 else new[1:n]
        outer = np.ones(n, dtype=bool)
        outer[1:] = base[1:] != base[:-1]
        begin = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
        room = np.maximum.accumulate(np.where(outer, np.arange(n), 0))
        rank[places] = (base + begin - room).astype(np.int32)
        return rank, places[~(new[:n] & new[1:])]

    def _aligned(self, active: np.ndarray, rank: np.ndarray, step: int):
        """Aligned blocks among the places that share their factor of ``step`` words."""
        if not len(active):
            none = np.zeros(0, np.int64)
            return none, none, none
        lo = rank[active].astype(np.int64)
        edge = np.flatnonzero(np.append(True, lo[1:] != lo[:-1]))
        size = np.repeat(np.diff(np.append(edge, len(lo))), np.diff(np.append(edge, len(lo))))
        on = (active - self.start[active]) % step == 0
        return active[on].astype(np.int64), lo[on], (lo + size)[on]

    def equal_ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that starts at ``a`` and at ``b`` (a < b, one text)."""
        a, b = a.copy(), b.copy()
        begin, end = b.copy(), self.end[b].astype(np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            # where 2^k words fit, equal ranks are equal factors; the last step tells all suffixes apart
            fits = b + (1 << k) <= end
            same = fits & (self.ranks[k][np.where(fits, a, 0)] == self.ranks[k][np.where(fits, b, 0)])
            a, b = np.where(same, a + (1 << k), a), np.where(same, b + (1 << k), b)
        return b - begin

    def equal_behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before ``a`` and before ``b`` (a < b, one text)."""
        a, b = a.copy(), b.copy()
        begin, start = a.copy(), self.start[np.minimum(a, self.n - 1)].astype(np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            fits = a - (1 << k) >= start
            one, two = np.where(fits, a - (1 << k), 0), np.where(fits, b - (1 << k), 0)
            same = fits & (self.ranks[k][one] == self.ranks[k][two])
            a, b = np.where(same, one, a), np.where(same, two, b)
        return begin - a


def candidates(f: Factors, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods worth extending, from the blocks of all sizes."""
    place, lo, hi = f.blocks[0]
    twins = place[place + 1 < f.end[place]]
    twins = twins[f.ranks[0][twins] == f.ranks[0][twins + 1]]
    places, periods = [twins], [np.ones(len(twins), np.int64)]
    longest = int(np.diff(at).max(initial=0))
    bits = longest.bit_length()
    local = f.suffixes - f.start[f.suffixes]
    tree = None
    for k in range(1, len(f.blocks)):
        place, lo, hi = f.blocks[k]
        b = 1 << k
        begin, size = f.start[place].astype(np.int64), f.end[place] - f.start[place]
        # a run of period b or more has four times as many words
        wide = size >= 4 * b
        place, lo, hi, begin = place[wide], lo[wide], hi[wide], begin[wide]
        if not len(place):
            continue
        tree = tree or WaveletMatrix(local, bits)
        near = place - begin + b
        skipped = tree.below(lo, hi, np.minimum(near, longest))
        found = tree.below(lo, hi, np.minimum(near + b, longest)) - skipped
        hit = found > 0
        place, lo, hi, begin, skipped, found = (x[hit] for x in (place, lo, hi, begin, skipped, found))
        if not len(place):
            continue
        first = begin + tree.kth(lo, hi, skipped)
        last = begin + tree.kth(lo, hi, skipped + found - 1)
        few = found <= 2
        places += [place[few], place[found == 2]]
        periods += [(first - place)[few], (last - place)[found == 2]]
        many = ~few
        if many.any():
            place, lo, hi, first, last = (x[many] for x in (place, lo, hi, first, last))
            d = begin[many] + tree.kth(lo, hi, skipped[many] + 1) - first
            end = place + d + f.equal_ahead(place, place + d)
            q = first + d + f.equal_ahead(first, first + d) - end
            good = (q >= first - place) & (q <= last - place) & ((q - first + place) % d == 0)
            places.append(place[good])
            periods.append(q[good])
    return np.concatenate(places).astype(np.int64), np.concatenate(periods).astype(np.int64)


def runs(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``symbols``), length and period of all runs, ordered by start, then period."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    f = Factors(symbols, at)
    place, period = candidates(f, at)
    start = place - f.equal_behind(place, place + period)
    length = place + period + f.equal_ahead(place, place + period) - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.ones(len(start), dtype=bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def edit_map(ids: list, at: np.ndarray) -> np.ndarray:
    """The original word that stands at each place: every tenth id gets a planted repeat."""
    source = np.arange(at[-1], dtype=np.int64)
    for i, doc in enumerate(ids):
        begin, n = int(at[i]), int(at[i + 1] - at[i])
        if doc is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
        if rest == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    return source


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run holds after its first ``period`` words."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _scan(piece: pa.RecordBatch, x: Texts, source: np.ndarray) -> pa.RecordBatch:
    begins, ends, at = x.words()
    symbols = x.word_hashes()[source]
    start, length, period = runs(symbols, at)
    gone = dropped(len(symbols), start, length, period)
    of = np.searchsorted(start, at)
    raw, out = x.raw.tobytes(), []
    moved = source != np.arange(len(source))
    for i in range(x.n):
        a, b, r, s = int(at[i]), int(at[i + 1]), int(of[i]), int(of[i + 1])
        words = raw[x.at[i] : x.at[i + 1]].split()
        if moved[a:b].any():
            words = [words[j] for j in (source[a:b] - a).tolist()]
        if r < s:
            words = compress(words, (~gone[a:b]).tolist())
        kept = hashlib.sha256(b" ".join(words)).hexdigest()
        found = list(zip((start[r:s] - a).tolist(), length[r:s].tolist(), period[r:s].tolist()))
        listed = hashlib.sha256("".join(f"{t},{m},{q}\n" for t, m, q in found).encode()).hexdigest()
        best = max(found, key=lambda e: (Fraction(e[1], e[2]), -e[0], -e[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if found else None
        out.append((len(found), *best, milli, listed, kept))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([column(piece, "doc_id").cast(pa.int64()), *columns], names)


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Runs of each text: number, the one of greatest exponent, digests of all runs and of the text without repeats.

    ``planted`` writes a repeat into every tenth text first (``edit_map``).
    """

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                x = texts_of(column(piece, "text"))
                _, _, at = x.words()
                ids = column(piece, "doc_id").to_pylist() if planted else [None] * x.n
                yield _scan(piece, x, edit_map(ids, at))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
