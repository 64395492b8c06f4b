"""Further learners for the ordered fold: kernels, reservoirs, forecasts, density, anomalies, calibration, bags."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .learners import RLS


@dataclass
class KernelRLS:
    """Kernel recursive least squares over a dictionary of at most `budget` rows.

    A row enters the dictionary if its squared distance from the span of the rows there exceeds `novelty`;
    other rows only correct the weights. kernel: "gaussian" (exp(-gamma d^2)), "polynomial" ((gamma x.y + 1)^degree) or "linear".
    """

    budget: int = 100
    gamma: float = 1.0
    novelty: float = 1e-4
    kernel: str = "gaussian"
    degree: int = 2

    def new(self):
        return None

    def _k(self, rows, x):
        if self.kernel == "gaussian":
            return np.exp(-self.gamma * ((rows - x) ** 2).sum(axis=1))
        return (self.gamma * (rows @ x) + 1) ** self.degree if self.kernel == "polynomial" else rows @ x

    def step(self, s, x, y):
        if s is None:
            own = float(self._k(x[None, :], x)[0])
            if own <= self.novelty:
                return 0.0, None
            return 0.0, (x[None, :].copy(), np.full((1, 1), 1 / own), np.ones((1, 1)), np.array([y / own]))
        rows, inv, cov, w = s
        k = self._k(rows, x)
        a = inv @ k
        gap, err = float(self._k(x[None, :], x)[0]) - float(k @ a), y - float(k @ w)
        if gap > self.novelty and len(rows) < self.budget:
            n = len(rows)
            grown = np.zeros((n + 1, n + 1))
            grown[:n, :n] = inv * gap + np.outer(a, a)
            grown[:n, n] = grown[n, :n] = -a
            grown[n, n] = 1.0
            wide = np.eye(n + 1)
            wide[:n, :n] = cov
            return float(k @ w), (np.vstack([rows, x]), grown / gap, wide, np.append(w - a * err / gap, err / gap))
        q = cov @ a / (1.0 + a @ cov @ a)
        return float(k @ w), (rows, inv, cov - np.outer(q, a @ cov), w + inv @ q * err)


@dataclass
class EchoState:
    """A ring of leaky tanh units driven by the row, read out by recursive least squares after `warmup` rows."""

    dim: int
    units: int = 40
    radius: float = 0.9
    leak: float = 0.3
    scale: float = 0.5
    warmup: int = 20
    seed: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.inputs = self.scale * rng.choice([-1.0, 1.0], (self.units, self.dim))
        self.bias = 0.1 * self.scale * rng.choice([-1.0, 1.0], self.units)
        self.read = RLS(self.units + self.dim + 1, 0.999)

    def new(self):
        return np.zeros(self.units), 0, self.read.new()

    def _next(self, h, x):
        return (1 - self.leak) * h + self.leak * np.tanh(self.inputs @ x + self.bias + self.radius * np.roll(h, 1))

    def update(self, s, x):
        """As a preprocessor: the units after the row, and the row."""
        h = self._next(s[0], np.asarray(x, float))
        return np.concatenate([h, x]), (h, s[1] + 1, s[2])

    def transform(self, s, x):
        """The same; the state does not move."""
        return self.update(s, x)[0]

    def step(self, s, x, y):
        h, n, r = s
        h = self._next(h, x)
        if n < self.warmup:
            return 0.0, (h, n + 1, r)
        p, r = self.read.step(r, np.concatenate([h, x, [1.0]]), y)
        return p, (h, n + 1, r)


@dataclass
class Snarimax:
    """Online ARMA with seasonal lags and outside inputs, learned by stochastic gradient; errors are clamped to +-1e6.

    The terms are the last `p` targets, the last `q` errors, `sp` targets and `sq` errors a multiple of `season` back, and the row.
    """

    dim: int = 0
    p: int = 2
    q: int = 1
    sp: int = 0
    sq: int = 0
    season: int = 1
    rate: float = 0.01

    def new(self):
        return np.zeros(1 + self.p + self.q + self.sp + self.sq + self.dim), [], []

    def step(self, s, x, y):
        w, ys, es = s
        back = lambda v, lag: v[-lag] if len(v) >= lag else 0.0
        past = [back(ys, i + 1) for i in range(self.p)] + [back(es, i + 1) for i in range(self.q)]
        past += [back(ys, self.season * (i + 1)) for i in range(self.sp)] + [back(es, self.season * (i + 1)) for i in range(self.sq)]
        z = np.concatenate([[1.0], past, x[: self.dim]])
        p = float(w @ z)
        e = min(max(y - p, -1e6), 1e6)
        keep = max(self.p, self.q, self.season * max(self.sp, self.sq), 1)
        return p, (w + self.rate * e * z, [*ys, y][-keep:], [*es, e][-keep:])

    def forecast(self, s, steps: int, x=()) -> list[float]:
        """The next values, each from the ones before it, with errors of 0."""
        out = []
        for _ in range(steps):
            p, (_, ys, es) = self.step(s, np.asarray(x, float), 0.0)
            s = (s[0], [*ys[:-1], p], [*es[:-1], 0.0])
            out.append(p)
        return out


@dataclass
class HalfSpaceTrees:
    """Anomaly score in [0, 1] of rows: 1 less the path's mass of the last full window, weighted by 2^(depth - level), against the most possible.

    Trees halve a random feature's range at each level, within `ranges` (the unit cube by default). Every `window` rows the running
    masses become the reference.
    """

    dim: int
    trees: int = 10
    depth: int = 6
    window: int = 100
    seed: int = 0
    ranges: tuple | None = None

    def __post_init__(self):
        inner = 2**self.depth - 1
        rng = np.random.default_rng(self.seed)
        self.features = rng.integers(0, self.dim, (self.trees, inner))
        self.cuts = np.zeros((self.trees, inner))
        lo, hi = np.array(self.ranges or [(0.0, 1.0)] * self.dim, float).T
        box = {0: (np.tile(lo, (self.trees, 1)), np.tile(hi, (self.trees, 1)))}
        each = np.arange(self.trees)
        for node in range(inner):
            low, high = box.pop(node)
            f = self.features[:, node]
            self.cuts[:, node] = (low[each, f] + high[each, f]) / 2
            for child in (2 * node + 1, 2 * node + 2):
                a, b = low.copy(), high.copy()
                (b if child % 2 else a)[each, f] = self.cuts[:, node]
                box[child] = a, b
        levels = np.arange(self.depth + 1)
        self.weights = 2.0 ** (self.depth - levels)

    def new(self):
        shape = (self.trees, 2 ** (self.depth + 1) - 1)
        return np.zeros(shape), np.zeros(shape), 0

    def step(self, s, x, y):
        last, now, n = s
        each, node, total = np.arange(self.trees), np.zeros(self.trees, np.int64), 0.0
        for level in range(self.depth + 1):
            now[each, node] += 1
            total += float(last[each, node].sum()) * self.weights[level]
            if level < self.depth:
                node = 2 * node + 1 + (x[self.features[each, node]] >= self.cuts[each, node])
        # the most that a path can hold: the whole window at every level
        score = 1.0 - min(total / (self.trees * self.window * float(self.weights.sum())), 1.0)
        if n + 1 == self.window:
            return float(score), (now, np.zeros_like(now), 0)
        return float(score), (last, now, n + 1)


@dataclass
class DBStream:
    """Density clusters: a row moves the nearest micro-cluster within `radius`, or starts one, and ties together all within it.

    Weights and ties fade by 2^-decay a row; clusters lighter than `least` go every `clean` rows. Predicts the number of the micro-cluster
    that took the row. `macro` joins micro-clusters whose tie is at least `share` of their mean weight.
    """

    radius: float
    decay: float = 0.001
    least: float = 0.1
    clean: int = 200
    share: float = 0.3

    def new(self):
        return {"next": 0, "t": 0, "at": {}, "ties": {}}

    def _now(self, s, value):
        weight, t = value
        return weight * 2.0 ** (-self.decay * (s["t"] - t))

    def step(self, s, x, y):
        near = sorted((float(((c - x) ** 2).sum()), i) for i, (c, _) in s["at"].items())
        near = [i for d, i in near if d <= self.radius**2]
        if near:
            first = near[0]
            c, w = s["at"][first]
            w = self._now(s, w)
            s["at"][first] = ((c * w + x) / (w + 1), (w + 1, s["t"]))
            for k, a in enumerate(sorted(near)):
                for b in sorted(near)[k + 1 :]:
                    s["ties"][a, b] = (self._now(s, s["ties"].get((a, b), (0.0, s["t"]))) + 1, s["t"])
        else:
            first = s["next"]
            s["at"][first] = (x.copy(), (1.0, s["t"]))
            s["next"] += 1
        s["t"] += 1
        if s["t"] % self.clean == 0:
            s["at"] = {i: v for i, v in s["at"].items() if self._now(s, v[1]) >= self.least}
            s["ties"] = {k: v for k, v in s["ties"].items() if k[0] in s["at"] and k[1] in s["at"]}
        return float(first), s

    def macro(self, s) -> dict[int, int]:
        """The least micro-cluster that each one is joined to."""
        up = {i: i for i in s["at"]}

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for (a, b), tie in s["ties"].items():
            if a in up and b in up and self._now(s, tie) >= self.share * (self._now(s, s["at"][a][1]) + self._now(s, s["at"][b][1])) / 2:
                a, b = sorted((top(a), top(b)))
                up[b] = a
        return {i: top(i) for i in up}


@dataclass
class Platt:
    """Probability sigmoid(a z + b) of label 1 for a score z = x[0], by stochastic gradient."""

    rate: float = 0.05

    def new(self):
        return 1.0, 0.0

    def step(self, s, x, y):
        a, b = s
        z = min(max(a * float(x[0]) + b, -500.0), 500.0)
        p = 1 / (1 + math.exp(-z))
        return p, (a - self.rate * (p - y) * float(x[0]), b - self.rate * (p - y))


@dataclass
class Temperature:
    """Probability sigmoid(z / T) of label 1 for a score z = x[0]; T follows the gradient of the log loss within [0.01, 100]."""

    rate: float = 0.05

    def new(self):
        return 1.0

    def step(self, heat, x, y):
        z = float(x[0]) / heat
        p = 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))
        return p, min(max(heat + self.rate * (p - y) * z / heat, 0.01), 100.0)


@dataclass
class Bagged:
    """The mean of members that each learn a row as often as a Poisson(1) draw says; draws follow the row's number and the seed."""

    size: int
    model: object
    seed: int = 0

    def new(self):
        return 0, [self.model.new() for _ in range(self.size)]

    def step(self, s, x, y):
        n, members = s
        times = np.random.default_rng((self.seed, n)).poisson(1.0, self.size)
        total = 0.0
        for i, k in enumerate(times):
            p, learned = self.model.step(members[i] if k else _copy(members[i]), x, y)
            total += p
            if k:
                for _ in range(k - 1):
                    _, learned = self.model.step(learned, x, y)
                members[i] = learned
        return total / self.size, (n + 1, members)


def _copy(state):
    import copy

    return copy.deepcopy(state)
