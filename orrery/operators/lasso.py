"""The graphical lasso of one group of series by Newton steps over a sparse inverse covariance."""

from __future__ import annotations

import tempfile

import numpy as np

#: Pivots and rows that a step of the inversion takes; pairs that a node may gain in one step; entries of a matrix that is kept in memory, larger ones are mapped from a file.
PIVOT, ROWS, GAIN, IN_MEMORY = 256, 1_024, 16, 82_000_000
#: Times that a step holds pairs at 0, and the factor by which the penalty falls to its value from step to step.
HOLDS, FALL = 6, 0.85


def _square(n: int, kind: type) -> np.ndarray:
    if n * n <= IN_MEMORY:
        return np.zeros((n, n), kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n, n))


def invert(a: np.ndarray) -> float | None:
    """Turns a symmetric matrix, of which the lower blocks are read, into its inverse where it stands; the logarithm of its determinant, None where it is not positive definite."""
    n, log = len(a), 0.0
    for s in range(0, n, PIVOT):
        e = min(s + PIVOT, n)
        try:
            log += 2 * np.log(np.diag(np.linalg.cholesky(a[s:e, s:e]))).sum()
        except np.linalg.LinAlgError:
            return None
        p = np.linalg.inv(a[s:e, s:e])
        row = np.concatenate([a[s:e, :s], np.zeros((e - s, e - s)), a[e:, s:e].T], axis=1)
        q = p @ row
        for r in range(0, n, ROWS):
            t = min(r + ROWS, n)
            a[r:t, :t] -= row[:, r:t].T @ q[:, :t]
        a[s:e, :s], a[e:, s:e], a[s:e, s:e] = q[:, :s], q[:, e:].T, -(p + p.T) / 2
        # Rows of one step hold both triangles of their square.
        r = s // ROWS * ROWS
        a[r:s, s:e], a[s:e, e : r + ROWS] = q[:, r:s].T, q[:, e : r + ROWS]
    for r in range(0, n, ROWS):
        t = min(r + ROWS, n)
        a[r:t, :t] *= -1
        a[:r, r:t] = a[r:t, :r].T
    return log if np.isfinite(log) else None


class _Curvature:
    """d -> W D W on the pairs (i, j) and the diagonal, for the symmetric D that has the values d there."""

    def __init__(self, w: np.ndarray, i: np.ndarray, j: np.ndarray, more: np.ndarray) -> None:
        n, m = len(w), len(i)
        own = np.arange(n)
        rows, cols, slots = np.concatenate([i, j, own]), np.concatenate([j, i, own]), np.concatenate([np.arange(m), np.arange(m), m + own])
        o = np.lexsort((cols, rows))
        self.cols, self.slots, self.at, self.more = cols[o], slots[o], np.searchsorted(rows[o], np.arange(n + 1)), more
        # Every pair is asked for once, from its larger end.
        self.half = [self.at[k] + np.searchsorted(self.cols[self.at[k] : self.at[k + 1]], k, "right") for k in range(n)]
        self.w, self.p = w, _square(n, np.float32)
        self.rows = np.empty((int(np.diff(self.at).max()), n), np.float32)

    def __call__(self, d: np.ndarray) -> np.ndarray:
        n, v, out = len(self.w), d[self.slots].astype(np.float32), np.empty(len(d))
        for s in range(0, n, 64):
            e = min(s + 64, n)
            y = np.empty((e - s, n), np.float32)
            for k in range(s, e):
                a, b = self.at[k], self.at[k + 1]
                y[k - s] = v[a:b] @ np.take(self.w, self.cols[a:b], 0, self.rows[: b - a], "clip")
            self.p[:, s:e] = y.T
        for k in range(n):
            a, b = self.at[k], self.half[k]
            out[self.slots[a:b]] = np.take(self.w, self.cols[a:b], 0, self.rows[: b - a], "clip") @ self.p[k]
        out[-n:] += self.more * d[-n:]
        return out


def _conjugate(apply: _Curvature, x: np.ndarray, r: np.ndarray, free: np.ndarray, scale: np.ndarray, weight: np.ndarray, rest: float, steps: int = 60) -> np.ndarray:
    """x, changed where it is free until the rest r, which changes with it, is at most so large there, by conjugate gradients."""
    y = np.where(free, r / scale, 0.0)
    p, now = y.copy(), (weight * r * y).sum()
    for _ in range(steps):
        if now <= rest:
            break
        h = apply(p)
        a = now / (weight * p * h).sum()
        x += a * p
        r -= a * h
        y = np.where(free, r / scale, 0.0)
        last, now = now, (weight * r * y).sum()
        p = y + now / last * p
    return x


def _direction(apply: _Curvature, grad: np.ndarray, at: np.ndarray, sign: np.ndarray, scale: np.ndarray, weight: np.ndarray, rest: float) -> np.ndarray:
    """The Newton step from -grad for values at, none of which may leave the side of 0 that sign says: those that would are held there, until they turn back, and the others are solved again."""
    x, r, free = np.zeros(len(grad)), -grad, np.ones(len(grad), bool)
    rest = rest * rest * (weight * r * r / scale).sum()
    for _ in range(HOLDS):
        x = _conjugate(apply, x, r, free, scale, weight, rest)
        cross = free & (sign * (at + x) < 0)
        if cross.any():
            move = np.where(cross, -at - x, 0.0)
            x = np.where(cross, -at, x)
            r -= apply(move)
        back = ~free & (sign * r > 0)
        if not cross.any() and not back.any():
            break
        free = (free & ~cross) | back
    return x


def solve(z: np.ndarray, copies: np.ndarray, penalty: float, exact: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, values of the pairs, values of the diagonal) of the inverse covariance of series with unit rows z, each of which stands for so many equal ones.

    By symmetry equal series have equal entries, so that one of each is enough: with m copies its variance is 1 - penalty + penalty / m, and the value on the diagonal m (a + (m - 1) b),
    of a pair m m' times the entry, where a is each copy's own entry and b that between copies. a - b is 1 / penalty, or the value / m where that is more, for b is never above 0.

    A step takes the pairs that have an entry and, of each node, some of those that most break the conditions of the optimum; signs are held and entries that cross 0 become 0.
    The penalty falls to its value on the way. It ends when all pairs, with an entry or without, keep the conditions up to exact.
    """
    n, m = len(z), copies.astype(float)
    own = np.where(m > 1, 1 - penalty + penalty / m, 1.0)
    i, j, v, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0), 1 / own
    above = lambda d: (m > 1) & (d * penalty > m)

    def state(i: np.ndarray, j: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[float, np.ndarray] | None:
        if (d <= 0).any():
            return None
        a = _square(n, np.float64)
        a[i, j] = a[j, i] = v
        a[np.arange(n), np.arange(n)] = d
        log = invert(a)
        if log is None:
            return None
        t = np.where(above(d), d * penalty / m, 1.0)
        return -log + own @ d + 2 * ((z[i] * z[j]).sum(1) @ v) + ((m - 1) * (t - 1 - np.log(t))).sum(), a

    value, w = state(i, j, v, d)
    # The penalty falls from where nothing is linked, so that whole steps lead on.
    most = max(np.abs(z[s : s + ROWS] @ z.T - np.eye(min(ROWS, n - s), n, s)).max() for s in range(0, n, ROWS))
    now = max(penalty, FALL * most)
    for _ in range(rounds):
        over = above(d)
        gd = own + np.where(over, (m - 1) * (penalty / m - 1 / d), 0.0) - w[np.arange(n), np.arange(n)]
        gv = (z[i] * z[j]).sum(1) - w[i, j]
        worst = max(np.abs(gd).max(), np.abs(gv + now * np.sign(v)).max(initial=0.0))
        o = np.argsort(np.concatenate([i, j]), kind="stable")
        ends, others = np.concatenate([i, j])[o], np.concatenate([j, i])[o]
        new = []
        small = _square(n, np.float32)
        for s in range(0, n, ROWS):
            e = min(s + ROWS, n)
            small[s:e] = w[s:e]
            g = np.abs(z[s:e] @ z.T - w[s:e])
            a, b = np.searchsorted(ends, [s, e])
            g[ends[a:b] - s, others[a:b]] = 0
            g[np.arange(e - s), np.arange(s, e)] = 0
            most = g.max()
            worst = max(worst, most - now)
            if most > now:
                k = min(GAIN, n)
                top = np.argpartition(g, n - k, axis=1)[:, n - k :]
                r, c = np.nonzero(np.take_along_axis(g, top, 1) > now)
                new.append(np.stack([r + s, top[r, c]]))
        if worst < exact and now == penalty:
            return i, j, v, d
        if new:
            x = np.concatenate(new, axis=1)
            x = np.unique(x.min(0) * n + x.max(0))
            x = (x // n, x % n)
            i, j, v = np.concatenate([i, x[0]]), np.concatenate([j, x[1]]), np.concatenate([v, np.zeros(len(x[0]))])
            gv = np.concatenate([gv, (z[x[0]] * z[x[1]]).sum(1) - w[x]])
        sign = np.where(v != 0, np.sign(v), -np.sign(gv))
        wd, wv = w[np.arange(n), np.arange(n)], w[i, j]
        del w
        more = np.where(over, (m - 1) / (d * d), 0.0)
        scale, weight = np.concatenate([wd[i] * wd[j] + wv * wv, wd * wd + more]), np.concatenate([np.full(len(i), 2.0), np.ones(n)])
        grad = np.concatenate([gv + now * sign, gd])
        apply = _Curvature(small, i, j, more)
        x = _direction(apply, grad, np.concatenate([v, d]), np.concatenate([sign, np.ones(n)]), scale, weight, 0.1 if worst > 1e-2 else 1e-2 if worst > 1e-4 else 1e-3)
        del apply, small
        step, got = 1.0, None
        while step > 1e-10:
            nv = v + step * x[:-n]
            nv = np.where(nv * sign > 0, nv, 0.0)
            nd = d + step * x[-n:]
            keep = nv != 0
            got = state(i[keep], j[keep], nv[keep], nd)
            fall = (weight * grad * np.concatenate([nv - v, nd - d])).sum()
            if got and got[0] + 2 * now * np.abs(nv).sum() <= value + 2 * now * np.abs(v).sum() + 1e-3 * min(fall, 0.0) + 1e-12 * (n + abs(value)):
                break
            got, step = None, step / 2
        if got is None:
            raise ArithmeticError("no step of the graphical lasso leads on")
        i, j, v, d = i[keep], j[keep], nv[keep], nd
        value, w = got
        if step > 0.3:
            now = max(penalty, FALL * now)
    raise ArithmeticError(f"the graphical lasso is not solved after {rounds} steps")
