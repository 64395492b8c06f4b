"""Gradient boosted Hoeffding trees for the ordered fold, all trees of a model stepped at once in numpy.

A model's trees share flat arrays (tree, node). A row is routed through all of them level by level; as each tree's
contribution is its prediction from before it learns the row, the running predictions, gradients and hessians of
all boosting steps are one cumulative sum, and leaf sums and histograms are updated by fancy indexing. Only splits and replacements,
which are rare, are handled one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


def gradients(loss: str, y: float | np.ndarray, p: np.ndarray, tau: float = 0.5, delta: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of a loss by running predictions p."""
    if loss == "squared":
        return p - y, np.ones_like(p)
    if loss in ("logistic", "softmax"):
        s = 1 / (1 + np.exp(-np.clip(p, -500, 500)))
        return s - (np.equal(y, 1).astype(float) if loss == "softmax" else y), np.maximum(s * (1 - s), 1e-16)
    if loss == "huber":
        return np.clip(p - y, -delta, delta), np.where(np.abs(p - y) <= delta, 1.0, 1e-6)
    if loss == "quantile":
        return np.where(p >= y, 1 - tau, -tau), np.ones_like(p)
    if loss == "expectile":
        w = np.where(p >= y, tau, 1 - tau)
        return 2 * w * (p - y), 2 * w
    raise ValueError(f"loss is squared, logistic, softmax, huber, quantile or expectile, not {loss}")


def first_prediction(loss: str, ys: list[float], tau: float = 0.5) -> float:
    """Where boosting starts, from the first targets."""
    if loss == "softmax":
        return 0.0
    if loss == "logistic":
        m = min(max(float(np.mean(ys)), 1e-7), 1 - 1e-7)
        return math.log(m / (1 - m))
    if loss == "huber":
        return float(np.median(ys))
    if loss == "quantile":
        s = sorted(ys)
        return float(s[min(int(tau * len(s)), len(s) - 1)])
    return float(np.mean(ys))


class Forest:
    """The arrays of a model's trees; a tree is a row, and its statistics by leaf lie in slots."""

    NODE = ("feature", "threshold", "child", "value", "n", "g", "h", "depth", "slot")

    def __init__(self, trees: int, dim: int, bins: int):
        self.dim, self.bins = dim, bins
        kinds = dict.fromkeys(("feature", "child", "n", "depth", "slot"), np.int64)
        for c in self.NODE:
            setattr(self, c, np.zeros((trees, 1), kinds.get(c, float)))
        self.used = np.zeros(trees, np.int64)
        self.seen = np.zeros(trees, np.int64)
        self.gains = np.zeros((trees, dim))
        self.free: list[int] = []
        self.low = np.empty((0, dim))
        self.high, self.edges = np.empty((0, dim)), np.empty((0, dim, bins - 1))
        self.sums = np.empty((0, 2, dim, bins))
        self.ready = np.empty(0, bool)
        for t in range(trees):
            self.reset(t)

    def _slot(self) -> int:
        if not self.free:
            old = len(self.ready)
            more = max(16, old)
            self.free = list(range(old + more - 1, old - 1, -1))
            for c in ("low", "high", "edges", "sums", "ready"):
                a = getattr(self, c)
                setattr(self, c, np.concatenate([a, np.zeros((more, *a.shape[1:]), a.dtype)]))
        k = self.free.pop()
        self.low[k], self.high[k], self.ready[k], self.sums[k] = np.inf, -np.inf, False, 0
        return k

    def _node(self, t: int, depth: int, value: float) -> int:
        if self.used[t] == self.feature.shape[1]:
            for c in self.NODE:
                a = getattr(self, c)
                setattr(self, c, np.concatenate([a, np.zeros_like(a)], axis=1))
        i = int(self.used[t])
        self.used[t] += 1
        self.feature[t, i], self.child[t, i], self.n[t, i], self.depth[t, i], self.slot[t, i] = -1, -1, 0, depth, self._slot()
        self.value[t, i], self.g[t, i], self.h[t, i] = value, 0.0, 0.0
        return i

    def reset(self, t: int) -> None:
        own = self.slot[t, : self.used[t]]
        self.free += [int(k) for k in own[self.feature[t, : self.used[t]] < 0]]
        self.used[t], self.seen[t], self.gains[t] = 0, 0, 0
        self._node(t, 0, 0.0)

    def route(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf of x in each of the trees; x is one row, or one a tree."""
        node = np.zeros(len(rows), np.int64)
        each = None if x.ndim == 1 else np.arange(len(rows))
        while True:
            f = self.feature[rows, node]
            inner = f >= 0
            if not inner.any():
                return node
            v = x[f] if each is None else x[each, f]
            node = np.where(inner, self.child[rows, node] + (v > self.threshold[rows, node]), node)

    def learn(self, rows: np.ndarray, leaf: np.ndarray, x: np.ndarray, g: np.ndarray, h: np.ndarray, reg: float, grace: int) -> np.ndarray:
        """Adds gradients at the leaves; which trees are due for a split test."""
        self.seen[rows] += 1
        at = rows, leaf
        self.n[at] += 1
        self.g[at] += g
        self.h[at] += h
        self.value[at] = -self.g[at] / (self.h[at] + reg)
        n, slot = self.n[at], self.slot[at]
        ready = self.ready[slot]
        if not ready.all():
            k, v = slot[~ready], x if x.ndim == 1 else x[~ready]
            self.low[k], self.high[k] = np.minimum(self.low[k], v), np.maximum(self.high[k], v)
            for k in slot[~ready & (n >= grace)]:
                self._cut(k)
        own = self.ready[slot]
        if own.any():
            k = slot[own]
            b = (self.edges[k] <= (x[:, None] if x.ndim == 1 else x[own][:, :, None])).sum(axis=2)
            cell = np.arange(self.dim)
            self.sums[k[:, None], 0, cell, b] += g[own][:, None]
            self.sums[k[:, None], 1, cell, b] += h[own][:, None]
        return np.flatnonzero(ready & (n % grace == 0) & (n >= grace))

    def _cut(self, k: int) -> None:
        """Equal bins between the least and greatest values seen; a single edge where they are equal."""
        lo, span = self.low[k], self.high[k] - self.low[k]
        edges = lo[:, None] + (span / self.bins)[:, None] * np.arange(1, self.bins)
        flat = np.abs(span) < np.finfo(float).eps
        edges[flat] = np.inf
        edges[flat, 0] = lo[flat]
        self.edges[k], self.ready[k] = edges, True

    def split(self, trees: np.ndarray, leaves: np.ndarray, seen: np.ndarray | None, reg: float, gamma: float, delta: float, depth: int, least: float = 1.0, tie: float = 0.05) -> int:
        """Splits each leaf by the greatest gain if its lead over the next feature passes the Hoeffding bound, or the bound is under `tie`.

        seen: which features each test may use (None: all).
        """
        low = self.depth[trees, leaves] < depth
        if not low.all():
            trees, leaves, seen = trees[low], leaves[low], None if seen is None else seen[low]
        if not len(trees):
            return 0
        left = np.cumsum(self.sums[self.slot[trees, leaves]], axis=3)
        total, left = left[..., -1:], left[..., :-1]
        right = total - left
        gain = 0.5 * (left[:, 0] ** 2 / (left[:, 1] + reg) + right[:, 0] ** 2 / (right[:, 1] + reg) - total[:, 0] ** 2 / (total[:, 1] + reg)) - gamma
        gain = np.where((left[:, 1] >= least) & (right[:, 1] >= least), gain, -np.inf)
        if seen is not None:
            gain[~seen] = -np.inf
        cut = gain.argmax(axis=2)
        best = np.take_along_axis(gain, cut[:, :, None], axis=2)[:, :, 0]
        feature = best.argmax(axis=1)
        each = np.arange(len(trees))
        top = best[each, feature]
        best[each, feature] = -np.inf
        lead = top - np.maximum(best.max(axis=1), 0.0)
        bound = np.sqrt(math.log(1 / delta) / (2 * self.n[trees, leaves]))
        done = np.flatnonzero((top > 0) & ((lead > bound) | (bound < tie)))
        for i in done:
            t, leaf, f, c = int(trees[i]), int(leaves[i]), int(feature[i]), int(cut[i, feature[i]])
            k = int(self.slot[t, leaf])
            self.gains[t, f] += top[i]
            edges, child_depth = self.edges[k].copy(), int(self.depth[t, leaf]) + 1
            a, b = left[i, :, f, c], right[i, :, f, c]
            first = self._node(t, child_depth, -a[0] / (a[1] + reg))
            self._node(t, child_depth, -b[0] / (b[1] + reg))
            for j in (first, first + 1):
                s = self.slot[t, j]
                self.edges[s], self.ready[s] = edges, True
            self.feature[t, leaf], self.threshold[t, leaf], self.child[t, leaf] = f, edges[f, c], first
            self.free.append(k)
        return len(done)


class Shifts:
    """Two-sided Page-Hinkley tests of many series at once."""

    def __init__(self, n: int, delta: float, threshold: float):
        self.delta, self.threshold = delta, threshold
        self.count, self.mean = np.zeros(n), np.zeros(n)
        self.up, self.down = np.zeros(n), np.zeros(n)
        self.low, self.low2 = np.full(n, np.inf), np.full(n, np.inf)

    def update(self, v: np.ndarray) -> np.ndarray:
        """0 stable, 1 warning, 2 drift (the sums restart, mean and count go on); v has values for the first series."""
        count, mean, up, down, low, low2 = (a[: len(v)] for a in (self.count, self.mean, self.up, self.down, self.low, self.low2))
        count += 1
        mean += (v - mean) / count
        up += v - mean - self.delta
        down += mean - self.delta - v
        np.minimum(low, up, out=low)
        np.minimum(low2, down, out=low2)
        most = np.maximum(up - low, down - low2)
        drift = most > self.threshold
        if drift.any():
            up[drift] = down[drift] = 0
            low[drift] = low2[drift] = np.inf
        return np.where(drift, 2, (most > self.threshold / 2).astype(int))

    def fresh(self, i: int) -> None:
        self.count[i] = self.mean[i] = self.up[i] = self.down[i] = 0
        self.low[i] = self.low2[i] = np.inf


@dataclass
class SGBT:
    """Streaming gradient boosting.

    Boosting starts from the first `start` targets (until then from 0, while trees already learn). A tree whose gradients' size shifts
    (Page-Hinkley) grows an alternate at a warning and is replaced by it, or by a fresh tree, at a drift or after `lifetime` rows. Each
    split test sees a random share `subsample` of the features. variant is ("standard",), ("skip", k): a tree passes over a row with probability 1 / k,
    or ("repeat", k): a tree learns a row max(1, ceil(hessian * k)) times.
    """

    dim: int
    steps: int = 100
    rate: float = 0.0125
    depth: int = 6
    bins: int = 64
    reg: float = 1.0
    gamma: float = 0.0
    grace: int = 200
    delta: float = 1e-7
    subsample: float = 0.75
    loss: str = "squared"
    tau: float = 0.5
    huber: float = 1.0
    start: int = 50
    drift: tuple[float, float] = (0.005, 50.0)
    lifetime: int | None = None
    variant: tuple = ("standard",)
    shared: bool = False
    seed: int = 0
    clip: float | None = None
    weight: float | None = None

    def new(self) -> dict:
        forest = Forest(2 * self.steps, self.dim, self.bins)
        return {
            "forest": forest, "tests": Shifts(self.steps, *self.drift), "active": np.arange(self.steps), "spare": np.arange(self.steps, 2 * self.steps),
            "growing": np.zeros(self.steps, bool), "from": np.zeros(self.steps, np.int64), "first": [], "base": 0.0, "seen": 0, "replaced": 0,
            "rng": np.random.default_rng(self.seed), "error": 0.0,
        }

    def raw(self, s: dict, x: np.ndarray) -> float:
        """The prediction on the scale of the loss."""
        f, a = s["forest"], s["active"]
        return s["base"] + self.rate * float(f.value[a, f.route(a, x)].sum())

    def output(self, raw: float) -> float:
        return 1 / (1 + math.exp(-min(max(raw, -500.0), 500.0))) if self.loss in ("logistic", "softmax") else raw

    def learn(self, s: dict, x: np.ndarray, y: float) -> tuple[float, np.ndarray]:
        """Learns a row; the prediction from before it and the steps' contributions to it."""
        s["seen"] += 1
        if s["first"] is not None:
            s["first"].append(y)
            if len(s["first"]) >= self.start:
                s["base"], s["first"] = first_prediction(self.loss, s["first"], self.tau), None
        f, active, growing = s["forest"], s["active"], s["growing"]
        rows = np.concatenate([active, s["spare"][growing]])
        leaf = f.route(rows, x)
        part = self.rate * f.value[active, leaf[: self.steps]]
        run = np.full(self.steps, s["base"] + part.sum()) if self.shared else s["base"] + np.concatenate([[0.0], np.cumsum(part)[:-1]])
        g, h = gradients(self.loss, y, run, self.tau, self.huber)
        if self.weight is not None:
            gap = abs(y - s["base"])
            w = min(1 + gap / s["error"], 10.0) if s["error"] > 0 else 1.0
            s["error"] = gap if s["error"] == 0 else self.weight * gap + (1 - self.weight) * s["error"]
            g, h = g * w, h * w
        if self.clip is not None:
            g = np.clip(g, -self.clip, self.clip)
        if self.variant[0] == "skip":
            times = (s["rng"].random(self.steps) >= 1 / self.variant[1]).astype(int)
        elif self.variant[0] == "repeat":
            times = np.maximum(1, np.ceil(np.abs(h) * self.variant[1]).astype(int))
        else:
            times = None
        base = s["base"]
        if times is None:
            self._once(s, rows, leaf, x, g, h, np.arange(self.steps), growing)
        else:
            for k in range(int(times.max(initial=0))):
                own = np.flatnonzero(times > k)
                rows = np.concatenate([active[own], s["spare"][own[growing[own]]]])
                self._once(s, rows, f.route(rows, x), x, g, h, own, growing)
        return base + float(part.sum()), part

    def _once(self, s: dict, rows: np.ndarray, leaf: np.ndarray, x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray, growing: np.ndarray) -> None:
        f = s["forest"]
        more = own[growing[own]]
        gs, hs = np.concatenate([g[own], g[more]]), np.concatenate([h[own], h[more]])
        due = f.learn(rows, leaf, x, gs, hs, self.reg, self.grace)
        if len(due):
            f.split(rows[due], leaf[due], self._seen([s["rng"]] * len(due)), self.reg, self.gamma, self.delta, self.depth)
        tests = s["tests"]
        if len(own) == self.steps:
            signal = tests.update(np.abs(g))
        else:
            v = np.where(np.isin(np.arange(self.steps), own), np.abs(g), np.nan)
            signal = self._some(tests, v, own)
        late = f.seen[s["active"]] - s["from"] >= self.lifetime if self.lifetime else np.zeros(self.steps, bool)
        if not signal.any() and not late.any():
            return
        growing |= signal == 1
        for t in np.flatnonzero((signal == 2) | late):
            old = s["active"][t]
            f.reset(old)
            if growing[t]:
                s["active"][t], s["spare"][t], growing[t] = s["spare"][t], old, False
            s["from"][t] = f.seen[s["active"][t]]
            tests.fresh(t)
            s["replaced"] += 1

    def _seen(self, rngs: list) -> np.ndarray | None:
        """The features of each split test, a random share of them."""
        k = max(1, math.ceil(self.subsample * self.dim))
        if k >= self.dim:
            return None
        out = np.zeros((len(rngs), self.dim), bool)
        for i, rng in enumerate(rngs):
            out[i, rng.choice(self.dim, k, replace=False)] = True
        return out

    def fold_many(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> list[np.ndarray]:
        """The predictions of a model per series, each as `step` gives them one by one; the series advance together, a row of each at a time."""
        if self.variant[0] != "standard" or self.weight is not None or self.clip is not None:
            return [self._alone(x, y) for x, y in zip(xs, ys, strict=True)]
        order = sorted(range(len(xs)), key=lambda i: -len(ys[i]))
        size, steps = np.array([len(ys[i]) for i in order]), self.steps
        keys, most = len(order), int(size[0]) if len(order) else 0
        x, y, out = np.zeros((keys, most, self.dim)), np.zeros((keys, most)), np.zeros((keys, most))
        for k, i in enumerate(order):
            x[k, : size[k]], y[k, : size[k]] = xs[i], ys[i]
        f, tests = Forest(2 * keys * steps, self.dim, self.bins), Shifts(keys * steps, *self.drift)
        active, spare = np.split(np.arange(2 * keys * steps), 2)
        growing, since, base = np.zeros(keys * steps, bool), np.zeros(keys * steps, np.int64), np.zeros(keys)
        rngs = [np.random.default_rng(self.seed) for _ in order]
        for t in range(most):
            n = int(np.searchsorted(-size, -t, "left"))  # series longer than t
            if t + 1 == self.start:
                base[:n] = [first_prediction(self.loss, y[k, : t + 1].tolist(), self.tau) for k in range(n)]
            own = n * steps
            now = x[:n, t]
            more = np.flatnonzero(growing[:own])
            rows, of = np.concatenate([active[:own], spare[more]]), np.concatenate([np.repeat(np.arange(n), steps), more // steps])
            own_x = now[of]
            leaf = f.route(rows, own_x)
            part = self.rate * f.value[rows[:own], leaf[:own]].reshape(n, steps)
            upto = np.cumsum(part, axis=1)
            raw = base[:n] + upto[:, -1]
            out[:n, t] = raw
            run = np.repeat(raw[:, None], steps, axis=1) if self.shared else base[:n, None] + np.concatenate([np.zeros((n, 1)), upto[:, :-1]], axis=1)
            g, h = (a.ravel() for a in gradients(self.loss, y[:n, t][:, None], run, self.tau, self.huber))
            due = f.learn(rows, leaf, own_x, np.concatenate([g, g[more]]), np.concatenate([h, h[more]]), self.reg, self.grace)
            if len(due):
                f.split(rows[due], leaf[due], self._seen([rngs[k] for k in of[due]]), self.reg, self.gamma, self.delta, self.depth)
            signal = tests.update(np.abs(g))
            late = f.seen[active[:own]] - since[:own] >= self.lifetime if self.lifetime else np.zeros(own, bool)
            growing[:own] |= signal == 1
            for i in np.flatnonzero((signal == 2) | late):
                old = active[i]
                f.reset(old)
                if growing[i]:
                    active[i], spare[i], growing[i] = spare[i], old, False
                since[i] = f.seen[active[i]]
                tests.fresh(i)
        found = [np.empty(0)] * keys
        for k, i in enumerate(order):
            v = out[k, : size[k]]
            found[i] = 1 / (1 + np.exp(-np.clip(v, -500, 500))) if self.loss in ("logistic", "softmax") else v
        return found

    def _alone(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s, out = self.new(), np.empty(len(y))
        for i, (a, b) in enumerate(zip(x, y, strict=True)):
            out[i], s = self.step(s, a, b)
        return out

    @staticmethod
    def _some(tests: Shifts, v: np.ndarray, own: np.ndarray) -> np.ndarray:
        names = ("count", "mean", "up", "down", "low", "low2")
        part = Shifts(len(own), tests.delta, tests.threshold)
        for c in names:
            setattr(part, c, getattr(tests, c)[own])
        out = np.zeros(len(v), int)
        out[own] = part.update(v[own])
        for c in names:
            getattr(tests, c)[own] = getattr(part, c)
        return out

    def step(self, s: dict, x: np.ndarray, y: float) -> tuple[float, dict]:
        raw, _ = self.learn(s, np.asarray(x, float), float(y))
        return self.output(raw), s

    def nodes(self, s: dict) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, value, n, depth) of every node, feature -1 at leaves; the model's scoring format."""
        f, out = s["forest"], []
        for i, t in enumerate(s["active"]):
            for k in range(int(f.used[t])):
                inner = f.feature[t, k] >= 0
                left = int(f.child[t, k]) if inner else -1
                out.append((i, k, int(f.feature[t, k]), float(f.threshold[t, k]) if inner else 0.0, left, left + 1 if inner else -1, float(f.value[t, k]), int(f.n[t, k]), int(f.depth[t, k])))
        return out

    def smooth(self, s: dict, x: np.ndarray, bandwidth: float) -> float:
        """Soft routing: at each node both sides count, by a sigmoid of the distance to the threshold over the bandwidth."""
        f = s["forest"]

        def value(t: int, i: int) -> float:
            if f.feature[t, i] < 0:
                return float(f.value[t, i])
            z = (f.threshold[t, i] - x[f.feature[t, i]]) / bandwidth
            left, k = 1 / (1 + math.exp(-min(max(z, -500.0), 500.0))), int(f.child[t, i])
            return left * value(t, k) + (1 - left) * value(t, k + 1)

        return s["base"] + self.rate * sum(value(int(t), 0) for t in s["active"])

    def interpolated(self, s: dict, x: np.ndarray) -> float:
        """Leaves of little weight lean on their parents: h / (h + reg) of the leaf, the rest of its parent's last value."""
        f, total = s["forest"], 0.0
        for t in s["active"]:
            up, i = None, 0
            while f.feature[t, i] >= 0:
                up, i = i, int(f.child[t, i]) + int(x[f.feature[t, i]] > f.threshold[t, i])
            a = f.h[t, i] / (f.h[t, i] + self.reg)
            total += f.value[t, i] if up is None else a * f.value[t, i] + (1 - a) * f.value[t, up]
        return s["base"] + self.rate * float(total)

    def variance(self, s: dict, x: np.ndarray) -> float:
        """Of the prediction: the sum of the leaves' 1 / (h + reg), by the square of the rate."""
        f, a = s["forest"], s["active"]
        return self.rate**2 * float((1 / (f.h[a, f.route(a, x)] + self.reg)).sum())

    def diagnostics(self, s: dict) -> list[tuple[int, int, int, int]]:
        """(tree, leaves, greatest depth, rows seen) of every tree."""
        f = s["forest"]
        return [(i, int((f.feature[t, : f.used[t]] < 0).sum()), int(f.depth[t, : f.used[t]].max()), int(f.seen[t])) for i, t in enumerate(s["active"])]

    def importances(self, s: dict) -> np.ndarray:
        """Split gains by feature, as shares."""
        g = s["forest"].gains[s["active"]].sum(axis=0)
        return g / g.sum() if g.sum() > 0 else g


@dataclass
class Multiclass:
    """One boosted model a class on 0/1 targets; the class of the greatest softmax over their raw outputs, ties to the smaller."""

    classes: int
    model: SGBT

    def new(self):
        return [self.model.new() for _ in range(self.classes)]

    def proba(self, s, x):
        raw = np.array([self.model.raw(a, x) for a in s])
        e = np.exp(raw - raw.max())
        return e / e.sum()

    def step(self, s, x, y):
        raw = [self.model.learn(a, x, float(int(y) == c))[0] for c, a in enumerate(s)]
        return float(int(np.argmax(raw))), s


@dataclass
class Quantiles:
    """One model a quantile; outputs made ascending by pooling adjacent violators. Predicts the middle quantile; `all` gives every one."""

    taus: tuple[float, ...]
    model: SGBT
    models: list = field(init=False, repr=False)

    def __post_init__(self):
        from dataclasses import replace

        if sorted(set(self.taus)) != list(self.taus):
            raise ValueError("taus ascend and differ")
        self.models = [replace(self.model, loss="quantile", tau=t) for t in self.taus]

    def new(self):
        return [m.new() for m in self.models]

    def all(self, s, x):
        return pooled([m.raw(a, x) for m, a in zip(self.models, s, strict=True)])

    def step(self, s, x, y):
        out = pooled([m.learn(a, x, y)[0] for m, a in zip(self.models, s, strict=True)])
        return out[len(out) // 2], s


def pooled(v: list[float]) -> list[float]:
    """The nearest ascending values: adjacent violators take their mean."""
    blocks: list[list[float]] = []
    for x in v:
        blocks.append([x, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, n), (b, m) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return [a for a, n in blocks for _ in range(n)]


@dataclass
class Distributional:
    """A normal forecast: boosted mean, and deviation by an exponential average of squared errors ("empirical") or by
    a second boosted model of the log deviation ("chain", z-score gradients 1 - z^2, hessians 2 z^2 within 0.01 and 100).

    Predicts the mean; `forecast` gives (mean, deviation, deviation of the trees' contributions).
    """

    model: SGBT
    mode: str = "empirical"
    alpha: float = 0.01

    def new(self):
        return {"mean": self.model.new(), "scale": self.model.new() if self.mode == "chain" else None, "square": 1.0, "first": [], "log": 0.0}

    def _log(self, s, x):
        f, a = s["scale"]["forest"], s["scale"]["active"]
        return s["log"] + self.model.rate * float(f.value[a, f.route(a, x)].sum())

    def forecast(self, s, x):
        f, a = s["mean"]["forest"], s["mean"]["active"]
        part = self.model.rate * f.value[a, f.route(a, x)]
        sd = math.sqrt(s["square"]) if self.mode == "empirical" else math.exp(min(max(self._log(s, x), -20.0), 20.0))
        return s["mean"]["base"] + float(part.sum()), sd, float(part.std(ddof=1)) if len(part) > 1 else 0.0

    def step(self, s, x, y):
        if s["first"] is not None:
            s["first"].append(y)
            if len(s["first"]) >= self.model.start:
                ys = np.array(s["first"])
                s["mean"]["base"], s["mean"]["first"], s["first"] = float(ys.mean()), None, None
                s["square"] = max(float(ys.var()), 1e-12)
                s["log"] = 0.5 * math.log(s["square"])
            return s["mean"]["base"], s
        mean, part = self.model.learn(s["mean"], x, y)
        err = y - mean
        s["square"] = max((1 - self.alpha) * s["square"] + self.alpha * err * err, 1e-12)
        if self.mode == "chain":
            self._learn_scale(s, x, err)
        return mean, s

    def _learn_scale(self, s, x, err):
        scale, m = s["scale"], self.model
        f, active = scale["forest"], scale["active"]
        rows = np.concatenate([active, scale["spare"][scale["growing"]]])
        leaf = f.route(rows, x)
        run = s["log"] + np.concatenate([[0.0], np.cumsum(m.rate * f.value[active, leaf[: m.steps]])[:-1]])
        z2 = np.square(err / np.exp(np.clip(run, -20, 20)))
        m._once(scale, rows, leaf, x, 1 - z2, np.clip(2 * z2, 0.01, 100.0), np.arange(m.steps), scale["growing"])


@dataclass
class Scheduled:
    """A boosted model whose rate follows a schedule of the row number or, on a plateau, of its squared error.

    schedule: ("constant",), ("linear", end, rows), ("exponential", decay), ("cosine", least, rows) or ("plateau", factor, patience, least).
    """

    model: SGBT
    schedule: tuple

    def new(self):
        return {"model": self.model.new(), "n": 0, "rate": self.model.rate, "best": math.inf, "bad": 0}

    def rate(self, s, loss):
        first, n, kind, a = self.model.rate, s["n"], self.schedule[0], self.schedule[1:]
        if kind == "constant":
            return first
        if kind == "linear":
            return first + (a[0] - first) * min(n / a[1], 1.0)
        if kind == "exponential":
            return max(first * a[0] ** n, 1e-8)
        if kind == "cosine":
            return a[0] + 0.5 * (first - a[0]) * (1 + math.cos(2 * math.pi * n / a[1]))
        if loss < s["best"]:
            s["best"], s["bad"] = loss, 0
        else:
            s["bad"] += 1
            if s["bad"] > a[1]:
                s["rate"], s["bad"] = max(s["rate"] * a[0], a[2]), 0
        return s["rate"]

    def step(self, s, x, y):
        from dataclasses import replace

        p = self.model.output(self.model.raw(s["model"], x))
        model = replace(self.model, rate=self.rate(s, (y - p) ** 2))
        model.learn(s["model"], x, y)
        s["n"] += 1
        return p, s


@dataclass
class Stacked:
    """A linear or other model over the predictions of base models (and the row, with passthrough); it learns a row before they do."""

    bases: tuple
    meta: object
    passthrough: bool = False

    def new(self):
        return [b.new() for b in self.bases], self.meta.new()

    def step(self, s, x, y):
        out = [b.step(a, x, y) for b, a in zip(self.bases, s[0], strict=True)]
        z = np.array([p for p, _ in out] + (list(x) if self.passthrough else []))
        p, meta = self.meta.step(s[1], z, y)
        return p, ([a for _, a in out], meta)


@dataclass
class MixtureOfExperts:
    """Boosted experts under a linear softmax gate, which learns by cross entropy to pick the expert of the least error.

    top None weighs all experts by the gate; a number lets only the gate's best so many predict and learn.
    """

    experts: int
    model: SGBT
    top: int | None = None
    gate_rate: float = 0.01

    def new(self):
        from dataclasses import replace

        return [replace(self.model, seed=self.model.seed + i).new() for i in range(self.experts)], np.zeros((self.experts, self.model.dim + 1))

    def step(self, s, x, y):
        states, w = s
        z = w @ np.append(x, 1.0)
        gate = np.exp(z - z.max())
        gate /= gate.sum()
        on = np.argsort(-gate, kind="stable")[: self.top or self.experts]
        raw = np.array([self.model.raw(a, x) for a in states])
        share = gate[on] / gate[on].sum()
        p = float(share @ raw[on])
        best = int(np.argmin(np.abs(raw - y)))
        w = w - self.gate_rate * np.outer(gate - (np.arange(self.experts) == best), np.append(x, 1.0))
        for i in on:
            self.model.learn(states[i], x, y)
        return p, (states, w)
