"""Learners for the ordered fold: state is plain numpy, a step predicts, then learns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Linear:
    """Least squares by stochastic gradient with a bias that is never regularised; ridge shrinks the weights before a step, lasso after it."""

    dim: int
    rate: float = 0.01
    ridge: float = 0.0
    lasso: float = 0.0

    def new(self):
        return np.zeros(self.dim + 1)

    def step(self, s, x, y):
        w, bias = s[:-1], s[-1]
        p = float(w @ x) + float(bias)
        move = 2 * self.rate * (p - y)
        w = w * (1 - self.rate * self.ridge) - move * x
        w = np.sign(w) * np.maximum(np.abs(w) - self.rate * self.lasso, 0)
        return p, np.append(w, bias - move)


@dataclass
class RLS:
    """Recursive least squares without intercept.

    With `adaptive`, the forgetting factor falls a little when an error exceeds the usual one, and rises when it is smaller, within
    0.95 and 1. State: weights, covariance, smoothed squared error (the noise variance) and smoothed absolute error. If the covariance
    or the weights degenerate, all of it starts again from zero weights. `interval` gives (mean, low, high).
    """

    dim: int
    forgetting: float = 1.0
    start: float = 100.0
    adaptive: bool = False

    def new(self):
        return np.zeros(self.dim), np.eye(self.dim) * self.start, 0.0, 0.0

    def step(self, s, x, y):
        w, c, mse, usual = s
        p = float(w @ x)
        err = y - p
        mse = 0.99 * mse + 0.01 * err * err
        keep = self.forgetting
        if self.adaptive:
            usual = 0.99 * usual + 0.01 * abs(err)
            ratio = min(max(abs(err) / usual, 0.1), 10.0) if usual > 1e-15 else 1.0
            keep = min(max(keep * min(max(1 - 0.001 * (ratio - 1), 0.99), 1.001), 0.95), 1.0)
        u = c @ x
        g = u / max(keep + float(x @ u), 1e-8)
        w, c = w + g * err, (c - np.outer(g, u)) / keep
        d = np.diag(c)
        if not (np.isfinite(d).all() and np.isfinite(w).all()) or d.min() < 0 or d.max() > 1e10:
            return p, self.new()
        return p, (w, c, mse, usual)

    def fold_many(self, xs, ys):
        """The predictions of a model per series, as `step` gives them; the series advance together, a row of each at a time."""
        order = sorted(range(len(xs)), key=lambda i: -len(ys[i]))
        size = np.array([len(ys[i]) for i in order])
        n, most, d = len(order), int(size[0]) if len(order) else 0, self.dim
        x, y, out = np.zeros((n, most, d)), np.zeros((n, most)), np.zeros((n, most))
        for k, i in enumerate(order):
            x[k, : size[k]], y[k, : size[k]] = xs[i], ys[i]
        w, c, usual = np.zeros((n, d)), np.tile(np.eye(d) * self.start, (n, 1, 1)), np.zeros(n)
        for t in range(most):
            m = int(np.searchsorted(-size, -t, "left"))
            a, v = x[:m, t], w[:m]
            p = np.einsum("kd,kd->k", v, a)
            out[:m, t] = p
            err, keep = y[:m, t] - p, np.full(m, self.forgetting)
            if self.adaptive:
                usual[:m] = 0.99 * usual[:m] + 0.01 * np.abs(err)
                ratio = np.where(usual[:m] > 1e-15, np.clip(np.abs(err) / np.maximum(usual[:m], 1e-300), 0.1, 10.0), 1.0)
                keep = np.clip(keep * np.clip(1 - 0.001 * (ratio - 1), 0.99, 1.001), 0.95, 1.0)
            u = np.einsum("kij,kj->ki", c[:m], a)
            g = u / np.maximum(keep + np.einsum("kd,kd->k", a, u), 1e-8)[:, None]
            w[:m] = v + g * err[:, None]
            c[:m] = (c[:m] - g[:, :, None] * u[:, None, :]) / keep[:, None, None]
            diagonal = np.einsum("kii->ki", c[:m])
            bad = ~(np.isfinite(diagonal).all(axis=1) & np.isfinite(w[:m]).all(axis=1)) | (diagonal.min(axis=1) < 0) | (diagonal.max(axis=1) > 1e10)
            if bad.any():
                w[:m][bad], c[:m][bad], usual[:m][bad] = 0.0, np.eye(d) * self.start, 0.0
        found = [np.empty(0)] * n
        for k, i in enumerate(order):
            found[i] = out[k, : size[k]]
        return found

    def interval(self, s, x, z=1.96):
        w, c, mse, _ = s
        p, sd = float(w @ x), math.sqrt(mse * (1 + float(x @ c @ x)))
        return p, p - z * sd, p + z * sd


@dataclass
class DDM:
    """Drift by the error's mean and deviation against their minimum: 0 stable, 1 warning, 2 drift. On drift the minima stay."""

    least: int = 30
    warn: float = 2.0
    drift: float = 3.0

    def new(self):
        return [0, 0.0, 0.0, math.inf, math.inf]

    def step(self, s, x, y):
        n, mean, m2, least, dev = s
        v = float(x[0])
        mean, gap = mean + (v - mean) / (n + 1), v - mean
        n, m2 = n + 1, m2 + gap * (v - mean)
        sd = math.sqrt(max(m2 / n, 0.0))
        if n <= self.least:
            return 0.0, [n, mean, m2, least, dev]
        if mean + sd < least:
            least, dev = mean + sd, sd
        if mean + sd >= least + self.drift * dev:
            return 2.0, [0, 0.0, 0.0, least, dev]
        return float(mean + sd >= least + self.warn * dev), [n, mean, m2, least, dev]


@dataclass
class ADWIN:
    """Adaptive windowing over exponential buckets: 0 stable, 1 warning, 2 drift (the window's older part is cut off).

    Cuts are tried from the newest bucket on; a cut whose means differ by sqrt(ln(4 ln(W) / delta) / (2 m)) or more, with
    m = 1 / (1/n0 + 1/n1), is a drift; twice the delta gives warnings. Windows of at most `least` rows are never cut.
    """

    delta: float = 0.002
    rows: int = 5
    least: int = 32

    def new(self):
        return []

    def step(self, s, x, y):
        """s: a list of rows by bucket size, each a list of (count, total), oldest first."""
        if not s:
            s.append([])
        s[0].append((1, float(x[0])))
        k = 0
        while k < len(s) and len(s[k]) > self.rows:
            (n, a), (m, b) = s[k].pop(0), s[k].pop(0)
            if k + 1 == len(s):
                s.append([])
            s[k + 1].append((n + m, a + b))
            k += 1
        flat = [b for row in s for b in reversed(row)]  # newest first
        count, total = np.array([b[0] for b in flat]), np.array([b[1] for b in flat])
        width = int(count.sum())
        if width <= max(self.least, 3):
            return 0.0, s
        right, sums = np.cumsum(count)[:-1], np.cumsum(total)[:-1]
        left = width - right
        gap = np.abs((total.sum() - sums) / left - sums / right)
        inverse = (1 / left + 1 / right) / 2
        bound = np.sqrt(inverse * math.log(4 * math.log(width) / self.delta))
        over = np.flatnonzero(gap >= bound)
        if not len(over):
            return float((gap >= np.sqrt(inverse * math.log(4 * math.log(width) / (2 * self.delta)))).any()), s
        kept, out = int(over[0]) + 1, []
        for row in s:
            take = min(kept, len(row))
            out.append(row[len(row) - take :])
            kept -= take
        while out and not out[-1]:
            out.pop()
        return 2.0, out


@dataclass
class HoltWinters:
    """Triple exponential smoothing, additive or multiplicative seasons; the first period starts level and seasons and is then replayed. Predictions ignore x."""

    period: int
    alpha: float = 0.3
    beta: float = 0.1
    gamma: float = 0.1
    multiplicative: bool = False

    def new(self):
        return {"start": [], "level": 0.0, "trend": 0.0, "season": None, "t": 0}

    def forecast(self, s, ahead: int = 1) -> float:
        base, season = s["level"] + ahead * s["trend"], s["season"][(s["t"] + ahead - 1) % self.period]
        return float(base * season if self.multiplicative else base + season)

    def step(self, s, x, y):
        if s["season"] is None:
            s["start"].append(y)
            if len(s["start"]) == self.period:
                s["level"] = sum(s["start"]) / self.period
                s["season"] = [self._apart(v, s["level"]) for v in s["start"]]
                for v in s["start"]:
                    self._update(s, v)
            return 0.0, s
        p = self.forecast(s)
        self._update(s, y)
        return p, s

    def _apart(self, y, level):
        if not self.multiplicative:
            return y - level
        return y / level if abs(level) > 1e-15 else 1.0

    def _update(self, s, y):
        i, level = s["t"] % self.period, s["level"]
        season = s["season"][i]
        plain = y - season if not self.multiplicative else (y / season if abs(season) > 1e-15 else y)
        s["level"] = self.alpha * plain + (1 - self.alpha) * (level + s["trend"])
        s["trend"] = self.beta * (s["level"] - level) + (1 - self.beta) * s["trend"]
        s["season"][i] = self.gamma * self._apart(y, s["level"]) + (1 - self.gamma) * season
        s["t"] += 1


@dataclass
class KMeans:
    """Online k-means: the first k different points seed the centers, then each point moves its nearest by 1 / count. Predicts the center's number."""

    k: int
    forgetting: float = 1.0

    def new(self):
        return [], []

    def step(self, s, x, y):
        centers, counts = s
        if len(centers) < self.k and not any(np.array_equal(c, x) for c in centers):
            centers.append(np.array(x, float))
            counts.append(1.0)
            return float(len(centers) - 1), s
        i = int(np.argmin([((c - x) ** 2).sum() for c in centers]))
        counts[i] += 1
        centers[i] = centers[i] + (x - centers[i]) / counts[i]
        counts[:] = [c * self.forgetting for c in counts]
        return float(i), s


@dataclass
class Polynomial:
    """Monomials up to a degree, with a constant, into recursive least squares."""

    dim: int
    degree: int = 2
    forgetting: float = 1.0

    def __post_init__(self):
        from itertools import combinations_with_replacement as c

        self.terms = [t for d in range(self.degree + 1) for t in c(range(self.dim), d)]
        self.rls = RLS(len(self.terms), self.forgetting)

    def new(self):
        return self.rls.new()

    def step(self, s, x, y):
        return self.rls.step(s, np.array([np.prod([x[i] for i in t]) if t else 1.0 for t in self.terms]), y)


@dataclass
class OneVsRest:
    """A class by the greatest of k models trained on 0 and 1 targets; ties to the smaller class."""

    k: int
    model: object

    def new(self):
        return [self.model.new() for _ in range(self.k)]

    def step(self, s, x, y):
        out = [self.model.step(a, x, float(int(y) == c)) for c, a in enumerate(s)]
        return float(int(np.argmax([p for p, _ in out]))), [a for _, a in out]


@dataclass
class LinUCB:
    """Contextual bandit over arms by ridge regression with upper bounds, learned from logged (arm, context) rows: x is the arm, then the context.

    Predicts the arm that it would have pulled.
    """

    arms: int
    dim: int
    alpha: float = 1.0

    def new(self):
        return [(np.eye(self.dim), np.zeros(self.dim)) for _ in range(self.arms)]

    def step(self, s, x, y):
        arm, c = int(x[0]), np.asarray(x[1:], float)
        bound = [float(inv @ b @ c + self.alpha * math.sqrt(max(c @ inv @ c, 0.0))) for inv, b in s]
        inv, b = s[arm]
        u = inv @ c
        s[arm] = inv - np.outer(u, u) / (1 + c @ u), b + y * c
        return float(int(np.argmax(bound))), s
