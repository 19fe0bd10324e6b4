"""Singular values and right singular vectors of one small square matrix by the qd family.

Householder reflections make the matrix bidiagonal, B. With q = d^2 and e = f^2 of its diagonals, dqds finds the eigenvalues
of B^T B = L D L^T to high relative accuracy. A vector comes from the twisted factorisation of L D L^T - w: the stationary
transform from the top and the progressive one from the bottom meet where the twist element is smallest. Eigenvalues that
are relatively close are told apart in a shifted representation, L' D' L'^T = L D L^T - s with s at the cluster's edge,
where their relative gaps are wide; what no shift parts is made orthogonal inside its cluster.

The size is the dimension of the vectors, never their number.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny
#: Eigenvalues nearer than this, relative to their size, form a cluster.
CLOSE = 1e-3
DEPTH = 8


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(w, beta, alpha) with (1 - beta w w^T) x = alpha e1."""
    size = float(np.linalg.norm(x))
    if size == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    alpha = -size if x[0] >= 0 else size
    w = x.copy()
    w[0] -= alpha
    w /= np.linalg.norm(w)
    return w, 2.0, alpha


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of ``matrix`` = U B V^T."""
    a, n = matrix.astype(np.float64, copy=True), len(matrix)
    d, f, v = np.zeros(n), np.zeros(max(0, n - 1)), np.eye(n)
    for k in range(n):
        w, beta, d[k] = reflector(a[k:, k])
        a[k:, k + 1 :] -= beta * np.outer(w, w @ a[k:, k + 1 :])
        if k < n - 1:
            w, beta, f[k] = reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= beta * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return d, f, v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | float:
    """One transform with a shift; if the shift is above the smallest eigenvalue, a smaller one to try."""
    d, to_q, to_e = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return 0.5 * shift if shift > EPS * q[-1] else 0.0
        sum_ = d + e[k]
        t = q[k + 1] / sum_ if sum_ > 0 else 0.0
        to_q.append(sum_)
        to_e.append(e[k] * t)
        d = d * t - shift if sum_ > 0 else q[k + 1] - shift
    if d < 0:  # only the last element failed: what it lacks is nearly the distance to the eigenvalue
        return max(0.0, (shift + d) * (1.0 - 4.0 * EPS)) if -d < shift else 0.0
    to_q.append(d)
    return to_q, to_e


def _corner(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, a guess at the smallest of all."""
    a, b, c = q[-2], e[-1], q[-1]
    half = 0.5 * (a + b + c)
    root = np.sqrt(max(0.0, (0.5 * (a - b - c)) ** 2 + a * b)) if half else 0.0
    return max(0.0, min(float(q[-1]), a * c / (half + root) if half + root > 0 else 0.0))


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of the positive qd array (q, e), largest first."""
    found: list[float] = []
    blocks = [(q.tolist(), e.tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        if len(q) > 1 and q[0] * 1.5 < q[-1]:  # the small end belongs below
            q, e = q[::-1], e[::-1]
        tries = 0
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if e[-1] <= EPS * EPS * (moved + q[-1]) or e[-1] < TINY:
                found.append(moved + q.pop())
                e.pop()
                tries = 0
                continue
            cut = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= EPS * EPS * (moved + q[k]) or e[k] < TINY), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            tries += 1
            if tries > 200 * len(q):
                raise ArithmeticError("dqds does not settle")
            shift = _corner(q, e) * (1.0 - 2.0 * EPS) if tries > 1 else 0.0
            while isinstance(after := _dqds_step(q, e, shift), float):
                shift = after
            (q, e), moved = after, moved + shift
    return np.sort(np.array(found))[::-1]


def _below(d: np.ndarray, l: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of L D L^T are below each value of ``at``."""
    s, count = -at, np.zeros(len(at), dtype=np.int64)
    for k in range(len(d)):
        plus = s + d[k]
        plus = np.where(plus == 0.0, -TINY, plus)
        count += plus < 0
        if k < len(l):
            step = d[k] * l[k] * l[k] / plus
            s = np.where(np.isinf(plus), d[k] * l[k] * l[k], step * s) - at
            s = np.where(np.isnan(s), -at, s)
    return count


def _refined(d: np.ndarray, l: np.ndarray, numbers: np.ndarray, guess: np.ndarray, unsure: float) -> np.ndarray:
    """Bisection of the eigenvalues with these numbers (from 0, smallest first) to full relative accuracy."""
    low, high = guess - unsure, guess + unsure
    for _ in range(60):
        wide = (_below(d, l, low) > numbers) | (_below(d, l, high) <= numbers)
        if not wide.any():
            break
        width = high - low
        low, high = np.where(wide, low - width, low), np.where(wide, high + width, high)
    for _ in range(120):
        middle = 0.5 * (low + high)
        if ((high - low) <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
        left = _below(d, l, middle) > numbers
        low, high = np.where(left, low, middle), np.where(left, middle, high)
    return 0.5 * (low + high)


def _stationary(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """D+, L+ of L D L^T - shift = L+ D+ L+^T, and its auxiliary values."""
    n = len(d)
    plus, lower, aux, s = np.zeros(n), np.zeros(n - 1), np.zeros(n), -shift
    for k in range(n):
        aux[k], plus[k] = s, s + d[k]
        if k < n - 1:
            if plus[k] == 0.0:
                plus[k] = -EPS * max(abs(d[k]), abs(shift), TINY)
            lower[k] = d[k] * l[k] / plus[k]
            s = lower[k] * l[k] * s - shift
    return plus, lower, aux


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """The vector of the twisted factorisation at ``value``, and the correction of the value by its Rayleigh quotient."""
    n = len(d)
    _, lower, aux = _stationary(d, l, value)
    upper, p = np.zeros(n - 1), np.zeros(n)
    p[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        below = d[k] * l[k] * l[k] + p[k + 1]
        if below == 0.0:
            below = EPS * max(abs(d[k]), abs(value), TINY)
        t = d[k] / below
        upper[k] = l[k] * t
        p[k] = p[k + 1] * t - value
    gamma = aux + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -upper[k] * z[k]
    square = float(z @ z)
    return z / np.sqrt(square), float(gamma[r]) / square


def _single(d: np.ndarray, l: np.ndarray, value: float) -> np.ndarray:
    for _ in range(4):
        z, by = _twisted(d, l, value)
        if abs(by) <= 2 * EPS * abs(value) or not np.isfinite(by):
            break
        value += by
    return z


def _vectors(d: np.ndarray, l: np.ndarray, numbers: np.ndarray, values: np.ndarray, out: np.ndarray, depth: int = 0) -> None:
    """Fills ``out[:, number]`` for eigenvalues of L D L^T given in rising order."""
    first = 0
    while first < len(values):
        last = first + 1
        while last < len(values) and values[last] - values[last - 1] <= CLOSE * max(abs(values[last]), abs(values[last - 1])):
            last += 1
        group = slice(first, last)
        if last - first == 1:
            out[:, numbers[first]] = _single(d, l, float(values[first]))
        elif depth == DEPTH:
            for k in range(first, last):
                z = _single(d, l, float(values[k]))
                for _ in range(2):
                    z -= out[:, numbers[first:k]] @ (out[:, numbers[first:k]].T @ z)
                size = np.linalg.norm(z)
                if size < 1e-6:  # no vector of its own is left: any direction off the cluster's others
                    z = np.random.default_rng(k).standard_normal(len(d))
                    for _ in range(3):
                        z -= out[:, numbers[first:k]] @ (out[:, numbers[first:k]].T @ z)
                        z, size = _solved(d, l, float(values[k]), z), 1.0
                    z -= out[:, numbers[first:k]] @ (out[:, numbers[first:k]].T @ z)
                out[:, numbers[k]] = z / np.linalg.norm(z)
        else:
            edges = []
            for end, sign in ((values[first], -1.0), (values[last - 1], 1.0)):
                shift = float(end + sign * max(4 * EPS * abs(end), 0.01 * (values[last - 1] - values[first])))
                plus, lower, _ = _stationary(d, l, shift)
                edges.append((float(np.abs(plus).max()), shift, plus, lower))
            _, shift, plus, lower = min(edges, key=lambda found: found[0])
            unsure = 8 * EPS * abs(shift) + 0.001 * float(values[last - 1] - values[first])
            moved = _refined(plus, lower, numbers[group], values[group] - shift, unsure)
            _vectors(plus, lower, numbers[group], np.sort(moved), out, depth + 1)
        first = last


def _solved(d: np.ndarray, l: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Direction of (L D L^T - value)^-1 right, by the factorisation from the top."""
    plus, lower, _ = _stationary(d, l, value)
    x, last = right.copy(), len(d) - 1
    for k in range(last):
        x[k + 1] -= lower[k] * x[k]
    x /= np.where(np.abs(plus) < TINY, EPS * np.abs(d).max() + TINY, plus)
    for k in range(last - 1, -1, -1):
        x[k] -= lower[k] * x[k + 1]
    return x / np.linalg.norm(x)


def right_vectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, largest first, and the right singular vectors as columns in the same order."""
    n = len(matrix)
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(matrix).max())
    if scale == 0.0:
        return np.zeros(n), np.eye(n)
    d, f, v = bidiagonal(matrix / scale)
    size = max(float(np.abs(d).max()), float(np.abs(f).max(initial=0.0)))
    d = np.where(np.abs(d) < EPS * size, EPS * size, d)  # as far off as rounding is
    cuts = np.flatnonzero(np.abs(f) <= 0.5 * EPS * size) + 1
    values, basis = np.zeros(n), np.zeros((n, n))
    for block in np.split(np.arange(n), cuts):
        own, off = d[block], f[block[:-1]]
        found = dqds(own * own, off * off)[::-1]
        inner = np.zeros((len(block), len(block)))
        _vectors(own * own, off / own[:-1], np.arange(len(block)), found, inner)
        values[block], basis[np.ix_(block, block)] = found, inner
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, v @ basis[:, order]
