"""Singular values and right singular vectors of a small matrix by qd transforms, in plain numpy.

``bidiagonal``  Householder reflections to an upper bidiagonal matrix.
``dqds``        squares of its singular values, by differential qd transforms with shifts.
``directions``  eigenvectors of B'B from twisted factorisations, one per value.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
TINY = 1e-290
#: Values whose relative distance is less share their vectors' space and are made orthogonal explicitly.
CLUSTER = 1e-5
#: A singular value below this many ulps of the greatest, per dimension, is taken for zero.
ROUNDING = 64


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta, alpha with (I - beta v v') x = alpha e1."""
    norm = float(np.sqrt(x @ x))
    if norm == 0.0 or len(x) == 1:
        return np.zeros_like(x), 0.0, float(x[0]) if len(x) else 0.0
    alpha = -norm if x[0] > 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B = U'AV, and V."""
    a, n = a.copy(), a.shape[1]
    right = np.eye(n)
    main, upper = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, beta, main[k] = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v, beta, upper[k] = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return main, upper, right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform with shift; None when a value turned negative."""
    out_q, out_e, d = [], [], q[0] - shift
    for i, off in enumerate(e):
        if d < 0.0:
            return None
        pivot = max(d + off, TINY)
        ratio = q[i + 1] / pivot
        out_q.append(pivot)
        out_e.append(off * ratio)
        d = d * ratio - shift
    if d < 0.0:
        return None
    out_q.append(d)
    return out_q, out_e


def _shift(q: list[float], e: list[float]) -> float:
    """The less eigenvalue of the last 2 x 2 block of the qd pair."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    root = float(np.hypot(a - b, 2.0 * np.sqrt(c)))
    greater = (a + b + root) / 2.0
    return max(0.0, (a * b - c) / greater) if greater > 0.0 else 0.0


def dqds(main: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    scale = float(max(np.abs(main).max(initial=0.0), np.abs(upper).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(main))
    q = [max(float(x), TINY) for x in (main / scale) ** 2]
    e = [float(x) for x in (upper / scale) ** 2]
    found: list[float] = []
    work = [(q, e, 0.0)]
    while work:
        q, e, total = work.pop()
        last = None
        while q:
            if len(q) == 1:
                found.append(q[0] + total)
                break
            # the floor of the squares: nothing below it can move a value by an ulp
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (total + min(q[i], q[i + 1]))), None)
            if cut == len(e) - 1:
                found.append(q[-1] + total)
                q, e, last = q[:-1], e[:-1], None
                continue
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], total))
                q, e, last = q[cut + 1 :], e[cut + 1 :], None
                continue
            guess = _shift(q, e) if last is None else min(_shift(q, e), last)
            for factor in (1.0 - 4.0 * EPS, 0.98, 0.7, 0.25, 0.0):
                shift = guess * factor
                if shift <= EPS * total * 1e-3:
                    shift = 0.0
                made = _transform(q, e, shift)
                if made is not None:
                    break
            if q[0] < q[-1] * 1e-2 and last is None:
                # graded the wrong way round: the reversed pair has the same values
                q, e = q[::-1], e[::-1]
                last = float("inf")
                continue
            q, e = made
            total += shift
            last = q[-1] if q[-1] > 0.0 else float("inf")
    return np.sort(np.array(found))[::-1] * scale * scale


class Twisted:
    """The twisted factorisation N D N' of B'B - value, at the place where its pivot is least."""

    def __init__(self, q: np.ndarray, e: np.ndarray, value: float):
        n = len(q)
        off, low = np.sqrt(q[:-1] * e), np.sqrt(e / q[:-1])
        small = EPS * EPS * float(q.max())
        nonzero = lambda x: x if abs(x) > small else (small if x >= 0 else -small)
        s, p = np.empty(n), np.empty(n)
        self.down, self.up = np.empty(n - 1), np.empty(n - 1)
        self.plus, self.minus = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            self.plus[i] = nonzero(s[i] + q[i])
            self.down[i] = off[i] / self.plus[i]
            s[i + 1] = self.down[i] * low[i] * s[i] - value
        p[n - 1] = q[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.minus[i + 1] = nonzero(e[i] + p[i + 1])
            ratio = q[i] / self.minus[i + 1]
            self.up[i] = off[i] / self.minus[i + 1]
            p[i] = p[i + 1] * ratio - value
        gamma = s + p + value
        self.at = int(np.argmin(np.abs(gamma)))
        self.pivot = nonzero(float(gamma[self.at]))

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.plus))
        z[self.at] = 1.0
        return self._spread(z)

    def _spread(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x with (B'B - value) x = b."""
        y, r = b.copy(), self.at
        for i in range(r):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(len(y) - 2, r - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        pivots = np.where(np.arange(len(y)) < r, self.plus, self.minus)
        pivots[r] = self.pivot
        return self._spread(y / pivots)


def _unit(z: np.ndarray) -> np.ndarray:
    z = z / np.abs(z).max()
    return z / np.sqrt(z @ z)


def directions(main: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector per value (falling), as columns; orthogonal within clusters of values.

    The matrix is unreduced: no entry of ``upper`` is negligible.
    """
    n = len(main)
    if n == 1:
        return np.ones((1, len(values)))
    scale = float(max(np.abs(main).max(), np.abs(upper).max())) or 1.0
    q, e = np.maximum((main / scale) ** 2, EPS**4), (upper / scale) ** 2
    signs = np.cumprod(np.append(1.0, np.where((main[:-1] < 0) ^ (upper < 0), -1.0, 1.0)))
    out = np.zeros((n, len(values)))
    cluster: list[int] = []
    rng = np.random.default_rng(n)
    for j, value in enumerate(values / (scale * scale)):
        if cluster and values[cluster[-1]] - values[j] > CLUSTER * values[cluster[-1]]:
            cluster = []
        twisted = Twisted(q, e, float(value))
        z = _unit(twisted.vector())
        before = out[:, cluster]
        for _ in range(8 if cluster else 0):
            kept = z - before @ (before.T @ z)
            if np.sqrt(kept @ kept) > 0.1:
                z = kept - before @ (before.T @ kept)
                break
            start = rng.standard_normal(n)
            start -= before @ (before.T @ start)
            z = _unit(twisted.solve(start))
        out[:, j] = _unit(z)
        cluster.append(j)
    return out * signs[:, None]


def right_singular(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to ``most`` greatest squared singular values that rounding leaves above zero, their right
    singular vectors as columns, and the sum of all squares."""
    main, upper, right = bidiagonal(a)
    # entries that rounding has made: the matrix falls into parts
    cut = np.flatnonzero(np.abs(upper) <= 8 * EPS * np.sqrt(np.abs(main[:-1] * main[1:]))) + 1
    parts = list(zip([0, *cut.tolist()], [*cut.tolist(), len(main)]))
    found = [dqds(main[i:j], upper[i : j - 1]) for i, j in parts]
    every = np.sort(np.concatenate(found))[::-1] if found else np.zeros(0)
    floor = max((ROUNDING * a.shape[1] * EPS) ** 2 * every.max(initial=0.0), every[most] if len(every) > most else 0.0)
    values, vectors = [], [np.zeros((len(main), 0))]
    for (i, j), own in zip(parts, found):
        own = own[(own >= floor) & (own > 0.0)]
        part = np.zeros((len(main), len(own)))
        part[i:j] = directions(main[i:j], upper[i : j - 1], own)
        values.append(own)
        vectors.append(part)
    merged = np.concatenate(values) if values else np.zeros(0)
    order = np.argsort(-merged, kind="stable")[:most]
    kept, vectors = merged[order], right @ np.hstack(vectors)[:, order]
    peak = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))] if len(kept) else np.zeros(0)
    return kept, vectors * np.where(peak < 0, -1.0, 1.0), float(every.sum())
