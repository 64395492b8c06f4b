"""Classification trees and forests, Mondrian trees, local regression, wrappers and online projections for the ordered fold."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .learners import ADWIN


def entropy(counts: np.ndarray) -> np.ndarray:
    """In bits, along the last axis; 0 of nothing."""
    n = counts.sum(axis=-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


class _Leaf:
    """Class counts, and by feature the classes of equal bins, cut once `grace` rows have shown the feature's range."""

    def __init__(self, dim: int, classes: int, depth: int):
        self.depth, self.n, self.counts = depth, 0, np.zeros(classes)
        self.rows: list[tuple[np.ndarray, int]] | None = []
        self.edges, self.cells = np.empty((dim, 0)), np.empty(0)

    def add(self, x: np.ndarray, c: int, bins: int, grace: int) -> None:
        self.n += 1
        self.counts[c] += 1
        if self.rows is None:
            self._count(x, c)
            return
        self.rows.append((x, c))
        if len(self.rows) >= grace:
            every = np.array([r for r, _ in self.rows])
            low, high = every.min(axis=0), every.max(axis=0)
            self.edges = low[:, None] + (high - low)[:, None] * np.arange(1, bins) / bins
            self.cells = np.zeros((len(x), bins, len(self.counts)))
            for r, k in self.rows:
                self._count(r, k)
            self.rows = None

    def _count(self, x: np.ndarray, c: int) -> None:
        self.cells[np.arange(len(x)), (self.edges <= x[:, None]).sum(axis=1), c] += 1


@dataclass
class HoeffdingClassifier:
    """A classification tree that splits by information gain once the best cut leads the next by the Hoeffding bound with range log2(classes).

    Predicts the majority class of the leaf (ties: the smaller class); `proba` its shares. Rows below a cut go left.
    """

    dim: int
    classes: int = 2
    depth: int = 10
    bins: int = 16
    grace: int = 50
    delta: float = 1e-5
    tie: float = 0.05

    def new(self):
        return [_Leaf(self.dim, self.classes, 0)]

    def _leaf(self, s, x):
        i = 0
        while isinstance(s[i], tuple):
            f, cut, left, right = s[i]
            i = left if x[f] < cut else right
        return i

    def proba(self, s, x):
        c = s[self._leaf(s, x)].counts
        return c / c.sum() if c.sum() else np.full(self.classes, 1 / self.classes)

    def step(self, s, x, y):
        i = self._leaf(s, x)
        leaf = s[i]
        p = float(leaf.counts.argmax())
        leaf.add(np.asarray(x, float), int(y), self.bins, self.grace)
        if leaf.rows is None and leaf.n % self.grace == 0 and leaf.depth < self.depth:
            self._split(s, i)
        return p, s

    def _split(self, s, i):
        leaf = s[i]
        left = leaf.cells.cumsum(axis=1)[:, :-1]
        total = leaf.cells.sum(axis=1)[:, None]
        right, n = total - left, total.sum(axis=-1)
        nl, nr = left.sum(axis=-1), right.sum(axis=-1)
        gain = entropy(leaf.counts) - nl / n * entropy(left) - nr / n * entropy(right)
        gain = np.where((nl > 0) & (nr > 0), gain, -np.inf).ravel()
        order = np.argsort(-gain, kind="stable")
        best = gain[order[0]]
        if best <= 0:
            return
        bound = math.log2(max(self.classes, 2)) * math.sqrt(math.log(1 / self.delta) / (2 * leaf.n))
        second = max(gain[order[1]], 0.0) if len(gain) > 1 else 0.0
        if best - second <= bound and bound >= self.tie:
            return
        f, b = divmod(int(order[0]), self.bins - 1)
        for counts in (left[f, b], right[f, b]):
            child = _Leaf(self.dim, self.classes, leaf.depth + 1)
            child.counts, child.n = counts.copy(), int(counts.sum())
            s.append(child)
        s[i] = (f, float(leaf.edges[f, b]), len(s) - 2, len(s) - 1)


@dataclass
class AdaptiveForest:
    """Votes of trees that each learn a row Poisson(rate) times on their own share of the features; ADWIN on a tree's mistakes replaces it.

    share 0 means the square root of the number of features.
    """

    dim: int
    trees: int = 10
    classes: int = 2
    rate: float = 6.0
    share: float = 0.0
    delta: float = 1e-3
    seed: int = 0
    tree: HoeffdingClassifier | None = None

    def __post_init__(self):
        k = max(1, min(self.dim, math.ceil((self.share or math.sqrt(self.dim) / self.dim) * self.dim)))
        base = self.tree or HoeffdingClassifier(k, self.classes)
        self.k, self.member = k, HoeffdingClassifier(k, self.classes, base.depth, base.bins, base.grace, base.delta, base.tie)
        self.drift = ADWIN(self.delta)

    def _fresh(self, rng):
        return [np.sort(rng.choice(self.dim, self.k, replace=False)), self.member.new(), self.drift.new()]

    def new(self):
        rng = np.random.default_rng(self.seed)
        return {"rng": rng, "trees": [self._fresh(rng) for _ in range(self.trees)], "drifts": 0}

    def step(self, s, x, y):
        votes = np.zeros(self.classes)
        times = s["rng"].poisson(self.rate, self.trees)
        for i, (mask, tree, drift) in enumerate(s["trees"]):
            z = x[mask]
            p = int(tree[self.member._leaf(tree, z)].counts.argmax())
            votes[p] += 1
            for _ in range(times[i]):
                self.member.step(tree, z, y)
            signal, state = self.drift.step(drift, [float(p != int(y))], 0.0)
            s["trees"][i][2] = state
            if signal == 2:
                s["trees"][i] = self._fresh(s["rng"])
                s["drifts"] += 1
        return float(votes.argmax()), s


@dataclass
class MondrianForest:
    """Means of random trees whose leaves split, at even odds a full leaf, on a feature drawn by range, between a quarter and three quarters of it."""

    dim: int
    trees: int = 10
    depth: int = 8
    leaf: int = 10
    seed: int = 0

    def new(self):
        rng = np.random.default_rng(self.seed)
        return {"rng": rng, "trees": [[self._node(0)] for _ in range(self.trees)]}

    def _node(self, depth):
        return {"n": 0, "mean": 0.0, "lo": np.full(self.dim, np.inf), "hi": np.full(self.dim, -np.inf), "depth": depth}

    def _at(self, tree, x):
        i = 0
        while "f" in tree[i]:
            i = tree[i]["kids"] + int(x[tree[i]["f"]] > tree[i]["cut"])
        return i

    def step(self, s, x, y):
        total = 0.0
        for tree in s["trees"]:
            node = tree[self._at(tree, x)]
            total += node["mean"]
            node["n"] += 1
            node["mean"] += (y - node["mean"]) / node["n"]
            node["lo"], node["hi"] = np.minimum(node["lo"], x), np.maximum(node["hi"], x)
            if node["n"] >= self.leaf and node["depth"] < self.depth:
                self._split(s["rng"], tree, node)
        return total / self.trees, s

    def _split(self, rng, tree, node):
        span = node["hi"] - node["lo"]
        if span.sum() <= 0:
            return
        f = int(rng.choice(self.dim, p=span / span.sum()))
        kids = [self._node(node["depth"] + 1) for _ in range(2)]
        for k in kids:
            k["mean"], k["n"] = node["mean"], 0
        node.update(f=f, cut=float(node["lo"][f] + span[f] * rng.uniform(0.25, 0.75)), kids=len(tree))
        tree += kids


@dataclass
class LocalRegression:
    """The Gaussian-weighted mean of the last `window` targets by distance of their rows."""

    window: int = 100
    width: float = 1.0

    def new(self):
        return [], []

    def step(self, s, x, y):
        xs, ys = s
        p = 0.0
        if xs:
            w = np.exp(-((np.array(xs) - x) ** 2).sum(axis=1) / (2 * self.width**2))
            p = float(w @ np.array(ys) / w.sum()) if w.sum() > 1e-15 else float(np.mean(ys))
        return p, ([*xs, x][-self.window :], [*ys, y][-self.window :])


@dataclass
class Classifier:
    """A regressor as a classifier: two classes by targets -1 and 1 through a sigmoid, more by one head a class and a softmax. Predicts the class."""

    model: object
    classes: int = 2

    def new(self):
        return [self.model.new() for _ in range(1 if self.classes == 2 else self.classes)]

    @staticmethod
    def proba(raw):
        if len(raw) == 1:
            p = 1 / (1 + math.exp(-min(max(raw[0], -500.0), 500.0)))
            return np.array([1 - p, p])
        e = np.exp(np.array(raw) - max(raw))
        return e / e.sum()

    def step(self, s, x, y):
        goal = [1.0 if y >= 0.5 else -1.0] if self.classes == 2 else [float(int(y) == c) for c in range(self.classes)]
        out = [self.model.step(a, x, g) for a, g in zip(s, goal, strict=True)]
        return float(self.proba([p for p, _ in out]).argmax()), [a for _, a in out]


@dataclass
class CCIPCA:
    """Candid covariance-free principal components, largest first; `amnesic` weighs new rows up. Transforms to the projections.

    The first row is its own mean, so the direction that starts from it stays empty: of k directions k - 1 are found, as in the method's usual streaming form.
    """

    components: int
    amnesic: float = 2.0

    def new(self):
        return {"n": 0, "mean": None, "dir": None, "size": np.zeros(self.components)}

    def update(self, s, x):
        if s["mean"] is None:
            s["mean"], s["dir"] = np.zeros(len(x)), np.zeros((self.components, len(x)))
        s["n"] += 1
        n = s["n"]
        s["mean"] += (x - s["mean"]) / n
        rest = x - s["mean"]
        for i in range(self.components):
            v = rest
            if n > i + 1:
                v = (n - 1 - self.amnesic) / n * s["size"][i] * s["dir"][i] + (1 + self.amnesic) / n * float(rest @ s["dir"][i]) * rest
            s["size"][i] = np.linalg.norm(v)
            s["dir"][i] = v / s["size"][i] if s["size"][i] > 0 else v
            rest = rest - float(rest @ s["dir"][i]) * s["dir"][i]
        order = np.argsort(-s["size"], kind="stable")
        s["size"], s["dir"] = s["size"][order], s["dir"][order]
        return self.transform(s, x), s

    def transform(self, s, x):
        return s["dir"] @ (x - s["mean"])

    def explained(self, s):
        total = s["size"].sum()
        return s["size"] / total if total > 0 else s["size"]


@dataclass
class FeatureSelector:
    """Keeps the share `keep` of features of the greatest smoothed importance (ties fill up from the first), the others are 0; all until `warmup` updates."""

    dim: int
    keep: float = 0.5
    alpha: float = 0.1
    warmup: int = 10

    def new(self):
        return {"n": 0, "ewma": np.zeros(self.dim), "mask": np.ones(self.dim, bool)}

    def learn(self, s, importances):
        s["ewma"] = self.alpha * np.asarray(importances, float) + (1 - self.alpha) * s["ewma"]
        s["n"] += 1
        if s["n"] >= self.warmup:
            k = min(max(math.ceil(self.dim * self.keep), 1), self.dim)
            s["mask"] = np.zeros(self.dim, bool)
            s["mask"][np.argsort(-s["ewma"], kind="stable")[:k]] = True
        return s

    def update(self, s, x):
        """Importances by the size of the row's features."""
        s = self.learn(s, np.abs(x))
        return self.transform(s, x), s

    def transform(self, s, x):
        return np.where(s["mask"], x, 0.0)


@dataclass
class CluStream:
    """Micro-clusters (n, sums, squares): a row joins the nearest if it is within `factor` radii or the cluster has under 3 rows, else starts
    one; at `most` the two closest merge first. Predicts the micro-cluster's number; `macro` groups their centers by weighted k-means.
    """

    most: int = 50
    factor: float = 2.0

    def new(self):
        return []

    def _centers(self, s):
        return np.array([ls / n for n, ls, _ in s])

    def step(self, s, x, y):
        if s:
            c = self._centers(s)
            d = np.sqrt(((c - x) ** 2).sum(axis=1))
            i = int(d.argmin())
            n, ls, ss = s[i]
            radius = math.sqrt(max(float((ss / n - (ls / n) ** 2).sum()), 0.0))
            if d[i] < self.factor * radius or n < 3:
                s[i] = (n + 1, ls + x, ss + x * x)
                return float(i), s
            if len(s) >= self.most:
                gap = ((c[:, None] - c[None]) ** 2).sum(axis=2)
                np.fill_diagonal(gap, np.inf)
                a, b = sorted(divmod(int(gap.argmin()), len(s)))
                m, us, vs = s.pop(b)
                n, ls, ss = s[a]
                s[a] = (n + m, ls + us, ss + vs)
        s.append((1, np.array(x, float), np.array(x, float) ** 2))
        return float(len(s) - 1), s

    def macro(self, s, k, rounds=100):
        """The group of each micro-cluster; the first centers are the heaviest micro-clusters'."""
        c, w = self._centers(s), np.array([n for n, _, _ in s], float)
        at = c[np.argsort(-w, kind="stable")[:k]]
        own = None
        for _ in range(rounds):
            new = ((c[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
            if own is not None and (new == own).all():
                break
            own = new
            at = np.array([np.average(c[own == i], axis=0, weights=w[own == i]) if (own == i).any() else at[i] for i in range(len(at))])
        return own
