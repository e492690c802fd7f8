"""Periodic runs against a brute-force search."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparkrecon.llm import periodic_runs
from tests.llm import brute


def runs(w: list) -> list[tuple]:
    found: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc, text, planted: bool) -> tuple:
    w = brute.words(text)
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    if planted and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def texts(seed: int, n: int) -> list[str]:
    """Random words with stretches copied from shortly before: runs of all periods, nested and overlapping."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        size = rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
        kinds = rng.choice([1, 2, 2, 3, 5, 50])
        w = [f"w{rng.randrange(kinds)}" for _ in range(size)]
        for _ in range(rng.randint(0, 4) if size > 8 else 0):
            a, p = rng.randrange(size), rng.randint(1, max(1, size // 4))
            for i in range(a + p, rng.randint(a, size)):
                w[i] = w[i - p]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.mark.parametrize("planted", [False, True])
def test_runs_equal_brute_force(spark, planted):
    rows = [(1000 + i, t, "s") for i, t in enumerate(texts(1, 400))] + brute.ODD
    got = periodic_runs.periodic_runs(brute.frame(spark, rows), planted).collect()
    want = [expected(doc, text, planted) for doc, text, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_long_texts(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(4000)}" for _ in range(30_000)]
    w += w[-7_000:] * 4 + ["end"] + ["x", "y"] * 40_000
    (row,) = periodic_runs.periodic_runs(brute.frame(spark, [(1, " ".join(w), "s")])).collect()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (2, 58_001, 80_000, 2)
    assert len(" ".join(w)) > 300_000


def test_empty_table(spark):
    out = periodic_runs.periodic_runs(brute.frame(spark, []), True)
    assert out.collect() == [] and out.columns[0] == "doc_id"


def test_order_statistics_of_ranges():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 300)
    tree = periodic_runs.WaveletMatrix(values, 6)
    lo = rng.integers(0, 300, 500)
    hi = np.array([rng.integers(a, 300) + 1 for a in lo])
    limit = rng.integers(0, 64, 500)
    below = [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, limit)]
    assert tree.below(lo, hi, limit).tolist() == below
    k = np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
    assert tree.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]
