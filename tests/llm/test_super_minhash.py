"""SuperMinHash, its near-duplicate groups and their edge cases against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkrecon.llm import super_minhash as S
from tests.llm import brute
from tests.llm.test_join_and_dedup import copies, same


def expected(rows) -> list[tuple]:
    found = brute.jaccard_components(rows, S.PERCENT)
    return [(d, n, c, True if d is None else d == c) for d, n, c in found]


@pytest.mark.parametrize("group, shingles", [(512, 1_000_000), (6, 300)])
def test_components_of_links(spark, monkeypatch, group, shingles):
    """Small groups are dealt into blocks."""
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "GROUP_SHINGLES", shingles)
    rows = copies(1, 220)
    same(S.near_duplicates(brute.frame(spark, rows)).collect(), expected(rows))


def test_variants_without_their_original(spark, monkeypatch):
    """One group of texts that mostly do not link with the hub, but in part with each other."""
    monkeypatch.setattr(S, "GROUP", 16)
    rng = random.Random(4)
    base, made = [f"w{i}" for i in range(150)], []
    for i in range(120):
        w = list(base if rng.random() < 0.4 or not made else rng.choice(made))
        for at in rng.sample(range(0, 150, 6), 4 if w == base else 1):
            w[at] = f"x{i}"
        made.append(w)
    rows = [(i, " ".join(w), "s") for i, w in enumerate(made)]
    want = expected(rows)
    assert 10 < len({c for _, _, c, _ in want}) < 110
    same(S.near_duplicates(brute.frame(spark, rows)).collect(), want)


def test_several_texts_of_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one, "s"), (5, two, "s"), (3, one, "s"), (4, two + " more", "t"), (9, "else", None), (9, "else", None)]
    same(S.near_duplicates(brute.frame(spark, rows)).collect(), expected(rows))


def test_empty_table(spark):
    assert S.near_duplicates(brute.frame(spark, [])).collect() == []


def plain_signature(grams: np.ndarray) -> np.ndarray:
    """The same offers, one shingle after the other, without early stopping."""
    m = S.REGISTERS
    out = [2**64 - 1] * m
    for gram in grams:
        state = S.mix(np.array([gram]) ^ S._SEED)
        p = list(range(m))
        for step in range(m):
            if step:
                state = S.mix(state + S._STEP + np.uint64(step))
            other = step + int(state[0]) % (m - step)
            p[step], p[other] = p[other], p[step]
            value = (step << 56) | int(S.mix(state + S._STEP)[0] >> np.uint64(8))
            out[p[step]] = min(out[p[step]], value)
    return np.array(out, np.uint64)


def test_signature_is_a_walk_over_permutations():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 30, 300, 0, 900]
    grams = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    at = np.cumsum([0, *sizes])
    got = S.signatures(grams, at)
    for i, (a, b) in enumerate(zip(at, at[1:])):
        assert (got[i] == plain_signature(grams[a:b])).all()


def test_signatures_vary_less_than_minhash():
    """The estimate is unbiased, and for small sets tighter than that of independent registers."""
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(300):
        grams = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = S.signatures(np.concatenate([grams[:34], grams[3:]]), np.array([0, 34, 71]))
        errors.append((a == b).mean() - 31 / 40)
    assert abs(np.mean(errors)) < 0.008
    assert np.std(errors) < 0.8 * np.sqrt(31 / 40 * 9 / 40 / S.REGISTERS)
