"""Singular values and right singular vectors of a small triangular matrix: bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = 1e-290


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(unit v, value) so that (I - 2 v v') x = value * e1; v is zero where nothing has to be done."""
    size = np.linalg.norm(x)
    v = x.copy()
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    value = -np.copysign(size, x[0])
    v[0] -= value
    return v / np.linalg.norm(v), float(value)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) with matrix = u B w': B has the diagonal a and the upper diagonal b, w is orthogonal."""
    m = matrix.astype(float).copy()
    n = len(m)
    a, b, w = np.zeros(n), np.zeros(max(0, n - 1)), np.eye(n)
    for k in range(n):
        v, a[k] = _reflector(m[k:, k])
        m[k:, k + 1:] -= 2 * np.outer(v, v @ m[k:, k + 1:])
        if k + 1 < n:
            v, b[k] = _reflector(m[k, k + 1:])
            m[k + 1:, k + 1:] -= 2 * np.outer(m[k + 1:, k + 1:] @ v, v)
            w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return a, b, w


def _sweep(q, e, shift):
    """One dqds transform by ``shift``: (q, e), or (None, d) with a negative ``d`` where the shift is above the smallest value."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None, -shift
        q2[i] = d + e[i]
        t = q[i + 1] / max(q2[i], TINY)
        e2[i] = e[i] * t
        d = d * t - shift
    q2[-1] = d
    return (q2, e2) if d >= 0 else (None, d)


def _shift(q, e) -> float:
    """A guess of the smallest value, from the last 2 by 2 block of the matrix."""
    x, y, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    return max(0.0, min((x + y) / 2 - np.hypot((x - y) / 2, np.sqrt(c)), q[-1]))


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared singular values of a bidiagonal matrix, falling, by the differential qd algorithm with shifts.

    Shifts stay below the smallest value: one that overshoots is lowered by what it was too high or divided by four, at last
    zero, with which a step always holds. The last value splits off when its coupling no longer counts; inner couplings split the matrix.
    """
    if not len(a):
        return np.zeros(0)
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(a))
    q, e = np.maximum((a / scale) ** 2, TINY), (b / scale) ** 2
    least = (EPS / 16) ** 2
    found, work = [], [(q, e, 0.0)]
    while work:
        q, e, moved = work.pop()
        for _ in range(100 * len(q)):
            if len(q) == 1 or e[-1] <= least * max(moved + q[-1], EPS):
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                if not len(q):
                    break
                e = e[:len(q) - 1]
                continue
            small = np.flatnonzero(e <= least * np.maximum(moved + np.minimum(q[:-1], q[1:]), EPS))
            if len(small):
                at = int(small[-1]) + 1
                work.append((q[:at], e[:at - 1], moved))
                q, e = q[at:], e[at:]
                continue
            shift = _shift(q, e)
            while (step := _sweep(q, e, shift))[0] is None:
                lower = (shift + step[1]) * (1 - 4 * EPS)
                shift = lower if lower > shift / 4 else shift / 4 if shift > EPS * EPS * q[-1] else 0.0
            q, e = step
            moved += shift
        else:
            raise ArithmeticError("dqds does not settle")
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted(a: np.ndarray, b: np.ndarray, value: float, skip=()) -> tuple[np.ndarray, int]:
    """(vector, twist): a unit vector z with B'B z = value z, from the twisted factorisation with the smallest pivot.

    The top-down and the bottom-up factorisation of B'B - value meet in the row whose pivot is smallest; its
    equation is the one left out. ``skip`` holds twists that are not to be taken.
    """
    n = len(a)
    floor = TINY + EPS * EPS * abs(value)
    safe = np.where(np.abs(a) > TINY, a, TINY)
    d, lower = safe * safe, b / safe[:-1]
    down, up = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > floor else floor
        down[i] = d[i] * lower[i] / pivot
        s[i + 1] = down[i] * lower[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * lower[i] ** 2 + p[i + 1]
        if abs(pivot) <= floor:
            pivot, p[i + 1] = floor, p[i + 1] + floor - pivot
        t = d[i] / pivot
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    order = np.argsort(np.abs(s + p + value), kind="stable")
    twist = next(int(k) for k in order if k not in skip)
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z), twist


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, all falling; the first ``k`` right singular vectors as columns) of a square matrix.

    Vectors whose values lie close together come from different twists and are made orthogonal to each other.
    """
    a, b, w = bidiagonal(r)
    values = dqds(a, b)
    found: list[np.ndarray] = []
    used: list[set] = []
    for j in range(min(k, len(values))):
        cluster = [i for i in range(j) if values[i] - values[j] <= 1e-3 * values[0]]
        skip: set = set()
        while True:
            if len(a) == 1:
                z, twist = np.ones(1), 0
            else:
                z, twist = twisted(a, b, values[j], skip)
            for _ in range(2):
                for i in cluster:
                    z = z - (found[i] @ z) * found[i]
            size = np.linalg.norm(z)
            skip.add(twist)
            if size > 1e-3 or len(skip) == len(a):
                break
        found.append(z / size if size > 1e-3 else _another(found, len(a)))
        used.append(skip)
    return values, w @ np.stack(found, axis=1) if found else np.zeros((len(a), 0))


def _another(found, n: int) -> np.ndarray:
    """A unit vector orthogonal to those found: the unit vector they cover least, without its part in them."""
    basis = np.stack(found, axis=1)
    z = np.eye(n)[:, int(np.argmin((basis ** 2).sum(axis=1)))]
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
    return z / np.linalg.norm(z)
