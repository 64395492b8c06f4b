"""Streaming neural learners for the ordered fold: a recurrent or layered state in numpy, most of them read out by recursive least squares."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .learners import RLS


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _silu(x):
    return x * _sigmoid(x)


class _Readout:
    """A learner from `features(state, x) -> (z, state)` and `width`: z goes to recursive least squares."""

    forgetting = 0.998
    start = 100.0

    def _read(self):
        return RLS(self.width, self.forgetting, self.start, adaptive=True)

    def new(self):
        return self.begin(), self._read().new()

    def step(self, s, x, y):
        z, inner = self.features(s[0], np.asarray(x, float))
        if z is None:
            return 0.0, (inner, s[1])
        p, read = self._read().step(s[1], z, y)
        return p, (inner, read)

    def update(self, s, x):
        """As a preprocessor: the features after the row."""
        z, inner = self.features(s[0], np.asarray(x, float))
        return (np.zeros(self.width) if z is None else z), (inner, s[1])

    def transform(self, s, x):
        """The features that the row would give; the state does not move."""
        import copy

        return self.update(copy.deepcopy(s), x)[0]


@dataclass
class NextGenReservoir(_Readout):
    """The last k rows, `stride` apart, and their monomials of a degree, with a bias."""

    dim: int
    k: int = 2
    stride: int = 1
    degree: int = 2
    bias: bool = True

    def __post_init__(self):
        from itertools import combinations_with_replacement as c

        self.terms = np.array(list(c(range(self.k * self.dim), self.degree)))
        self.width = self.k * self.dim + len(self.terms) + int(self.bias)

    def begin(self):
        return []

    def features(self, past, x):
        past = [*past, x][-((self.k - 1) * self.stride + 1) :]
        if len(past) <= (self.k - 1) * self.stride:
            return None, past
        lin = np.concatenate([past[-1 - i * self.stride] for i in range(self.k)])
        return np.concatenate([[1.0] if self.bias else [], lin, lin[self.terms].prod(axis=1)]), past


def discretise(a: np.ndarray, b: np.ndarray, dt: float, kind: str = "hold") -> tuple[np.ndarray, np.ndarray]:
    """A diagonal system over a step dt: zero-order hold, or bilinear."""
    if kind == "bilinear":
        return (1 + dt * a / 2) / (1 - dt * a / 2), dt * b / (1 - dt * a / 2)
    bar = np.exp(dt * a)
    return bar, np.where(np.abs(a) < 1e-12, dt, (bar - 1) / np.where(np.abs(a) < 1e-12, 1, a)) * b


@dataclass
class DiagonalSSM(_Readout):
    """A fixed diagonal state-space layer of decays -1, -2, ..., driven by a random projection of the row; the state is the feature."""

    dim: int
    states: int = 16
    dt: float = 0.1
    kind: str = "hold"
    seed: int = 0

    def __post_init__(self):
        self.b = np.random.default_rng(self.seed).normal(0, 1 / math.sqrt(self.dim), (self.states, self.dim))
        self.bar, self.gain = discretise(-np.arange(1.0, self.states + 1), np.ones(self.states), self.dt, self.kind)
        self.width = self.states + self.dim

    def begin(self):
        return np.zeros(self.states)

    def features(self, h, x):
        h = self.bar * h + self.gain * (self.b @ x)
        return np.concatenate([h, x]), h


@dataclass
class Mamba(_Readout):
    """A selective state-space layer: step size, input and output maps follow the row; its output passes a SiLU gate, the row is added, the state goes along."""

    dim: int
    states: int = 8
    seed: int = 0
    most: int = 128

    def __post_init__(self):
        rng, s = np.random.default_rng(self.seed), 1 / math.sqrt(self.dim)
        self.decay = -np.arange(1.0, self.states + 1)
        self.wd, self.wb, self.wc = rng.normal(0, s, self.dim), rng.normal(0, s, (self.states, self.dim)), rng.normal(0, s, (self.states, self.dim))
        self.gate = rng.normal(0, s, (self.dim, self.dim))
        self.width = min(self.dim + self.dim * self.states, self.most)

    def begin(self):
        return np.zeros((self.dim, self.states))

    def features(self, h, x):
        bar, inp = discretise(self.decay, self.wb @ x, float(_softplus(self.wd @ x)))
        h = bar * h + inp * x[:, None]
        out = (h @ (self.wc @ x) + x) * _silu(self.gate @ x) + x
        return np.concatenate([out, h.ravel()])[: self.width], h


#: The update rules of the attention state.
MODES = ("retnet", "hawk", "gla", "delta", "gated_delta", "rwkv", "mlstm")


@dataclass
class Attention(_Readout):
    """Linear attention of several heads, a recurrent state each, updated by one of seven rules; the answers to the row's queries are the features.

    retnet: S = a S + k v' with a fixed decay a head; gla: a decay gate by the row; delta: S += k (v - S'k)'; gated_delta: the same after a decay gate;
    rwkv: S = exp(-w) S + exp(k) v'; mlstm: S = f S + i k v' with forget and input gates; hawk: a vector h = a h + sqrt(1 - a^2) x with a gate.
    """

    dim: int
    mode: str = "gla"
    heads: int = 2
    size: int = 4
    seed: int = 0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        rng, s = np.random.default_rng(self.seed), 1 / math.sqrt(self.dim)
        self.wq, self.wk, self.wv = (rng.normal(0, s, (self.heads, self.size, self.dim)) for _ in range(3))
        self.gates = rng.normal(0, s, (2, self.heads, self.dim))
        self.wide = rng.normal(0, s, (self.heads, self.size, self.dim))
        self.decay = 1 - 2.0 ** -(5 + np.arange(self.heads))
        self.width = self.heads * self.size + self.dim + 1

    def begin(self):
        return np.zeros((self.heads, self.size, self.size) if self.mode != "hawk" else (self.heads, self.size))

    def features(self, state, x):
        q, k, v = self.wq @ x, self.wk @ x, self.wv @ x
        one, two = _sigmoid(self.gates[0] @ x), _sigmoid(self.gates[1] @ x)
        if self.mode == "hawk":
            a = _sigmoid(self.wide @ x) ** 0.5
            state = a * state + np.sqrt(np.maximum(1 - a * a, 0)) * v
            return np.concatenate([state.ravel(), x, [1.0]]), state
        if self.mode in ("delta", "gated_delta"):
            k = k / np.maximum(np.linalg.norm(k, axis=1, keepdims=True), 1e-12)
        keep = {"retnet": self.decay, "gla": one, "gated_delta": one, "mlstm": one, "rwkv": np.exp(-_softplus(self.gates[0] @ x)), "delta": np.ones(self.heads)}[self.mode]
        state = keep[:, None, None] * state
        if self.mode in ("delta", "gated_delta"):
            v = v - np.einsum("hkv,hk->hv", state, k)
        elif self.mode == "mlstm":
            v = two[:, None] * v
        elif self.mode == "rwkv":
            k = np.exp(np.minimum(k, 20))
        state = state + k[:, :, None] * v[:, None, :]
        out = np.einsum("hkv,hk->hv", state, q)
        return np.concatenate([out.ravel(), x, [1.0]]), state


@dataclass
class SpikeNet:
    """Leaky integrate-and-fire units on changes of the row (one spike up, one down a feature), in Q1.14 integers, learned by e-prop.

    A unit fires above `threshold`, loses that much, and has a triangular pseudo-derivative; eligibility traces fade with the membrane. The readout is
    a leaky sum of spikes.
    """

    dim: int
    units: int = 16
    decay: float = 0.9
    threshold: float = 0.5
    change: float = 0.05
    rate: float = 0.01
    seed: int = 0
    ONE = 1 << 14

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        q = lambda v: np.round(np.clip(v, -1.99, 1.99) * self.ONE).astype(np.int64)
        self.w, self.feed = q(rng.normal(0, 0.5, (self.units, 2 * self.dim))), rng.normal(0, 0.5, self.units)
        self.keep, self.fire = int(self.decay * self.ONE), int(self.threshold * self.ONE)

    def new(self):
        zero = np.zeros(self.units, np.int64)
        return {"w": self.w.copy(), "v": zero, "spikes": zero, "pre": np.zeros(2 * self.dim), "trace": np.zeros((self.units, 2 * self.dim)), "last": None, "out": np.zeros(self.units), "sum": np.zeros(self.units), "bias": 0.0}

    def _forward(self, s, x):
        gap = x - (x if s["last"] is None else s["last"])
        spikes = np.concatenate([gap > self.change, gap < -self.change]).astype(np.int64)
        v = (s["v"] * self.keep >> 14) + s["w"] @ spikes - s["spikes"] * self.fire
        return spikes, v, (v >= self.fire).astype(np.int64)

    def update(self, s, x):
        """As a preprocessor: the units' spikes and membranes after the row; nothing is learned."""
        x = np.asarray(x, float)
        _, v, fired = self._forward(s, x)
        return np.concatenate([fired, v / self.ONE]), {**s, "v": v, "spikes": fired, "last": x}

    def transform(self, s, x):
        """The same; the state does not move."""
        return self.update(s, x)[0]

    def step(self, s, x, y):
        x = np.asarray(x, float)
        spikes, v, fired = self._forward(s, x)
        s["sum"] = self.decay * s["sum"] + fired
        p = float(s["out"] @ s["sum"]) + s["bias"]
        err = p - y
        slope = np.maximum(0, 1 - np.abs(v - self.fire) / self.fire)
        s["pre"] = self.decay * s["pre"] + spikes
        s["trace"] = self.decay * s["trace"] + slope[:, None] * s["pre"]
        step = np.round(np.clip(self.rate * np.clip(err, -10, 10) * self.feed[:, None] * s["trace"], -0.1, 0.1) * self.ONE).astype(np.int64)
        s["w"] = np.clip(s["w"] - step, -2 * self.ONE + 1, 2 * self.ONE - 1)
        move = 10 * self.rate * err / (1 + float(s["sum"] @ s["sum"]))
        s["out"], s["bias"] = s["out"] - move * s["sum"], s["bias"] - move
        s["v"], s["spikes"], s["last"] = v, fired, x
        return p, s


@dataclass
class TestTimeTraining(_Readout):
    """Fast weights that reconstruct one view of the row from another by a gradient step at every row; their answer to a third view is the feature."""

    __test__ = False
    dim: int
    size: int = 8
    rate: float = 0.05
    seed: int = 0

    def __post_init__(self):
        rng, s = np.random.default_rng(self.seed), 1 / math.sqrt(self.dim)
        self.wk, self.wv, self.wq = (rng.normal(0, s, (self.size, self.dim)) for _ in range(3))
        self.width = self.size + self.dim + 1

    def begin(self):
        return np.zeros((self.size, self.size)), np.zeros(self.size)

    def features(self, state, x):
        w, b = state
        k, v, q = self.wk @ x, self.wv @ x, self.wq @ x
        k = k / max(float(np.linalg.norm(k)), 1e-12)
        err = w @ k + b - v
        w, b = w - self.rate * np.outer(err, k), b - self.rate * err
        z = w @ q + b
        z = 0.5 * z * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))
        z = (z - z.mean()) / math.sqrt(float(z.var()) + 1e-5)
        return np.concatenate([z, x, [1.0]]), (w, b)


def spline(x: np.ndarray, grid: int, order: int = 3, low: float = -1.0, high: float = 1.0) -> np.ndarray:
    """B-spline basis values of x, clamped to the grid, by the Cox-de Boor recursion: (..., grid + order)."""
    h = (high - low) / grid
    knots = low + h * np.arange(-order, grid + order + 1)
    x = np.clip(x, low, high - 1e-9 * (high - low))[..., None]
    b = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    for p in range(1, order + 1):
        b = (x - knots[: -p - 1]) / (p * h) * b[..., :-1] + (knots[p + 1 :] - x) / (p * h) * b[..., 1:]
    return b


@dataclass
class KAN:
    """A network whose edges are splines: rows are normalised, squashed, summed over edge functions layer by layer, and learned by clipped SGD with momentum."""

    dim: int
    hidden: int = 5
    grid: int = 5
    rate: float = 0.02
    momentum: float = 0.5
    clip: float = 1.0
    seed: int = 0

    def new(self):
        rng, m = np.random.default_rng(self.seed), self.grid + 3
        w = [rng.normal(0, 0.1, (self.hidden, self.dim, m)), rng.normal(0, 0.1, (1, self.hidden, m))]
        return {"w": w, "v": [np.zeros_like(a) for a in w], "n": 0, "mean": np.zeros(self.dim + 1), "var": np.ones(self.dim + 1)}

    def step(self, s, x, y):
        at = np.append(x, y)
        scale = np.sqrt(s["var"]) + 1e-8
        z = (np.append(x, 0.0) - s["mean"]) / scale
        a0 = np.tanh(z[:-1])
        b0 = spline(a0, self.grid)
        h = np.einsum("oim,im->o", s["w"][0], b0)
        a1 = np.tanh(h)
        b1 = spline(a1, self.grid)
        out = float(np.einsum("oim,im->o", s["w"][1], b1)[0])
        p = out * scale[-1] + s["mean"][-1]
        err = float(np.clip(out - (y - s["mean"][-1]) / scale[-1], -self.clip, self.clip))
        eps = 1e-4
        slope = np.einsum("im,im->i", s["w"][1][0], (spline(a1 + eps, self.grid) - spline(a1 - eps, self.grid)) / (2 * eps))
        back = err * slope * (1 - a1 * a1)
        for i, g in enumerate((back[:, None, None] * b0, err * b1[None])):
            s["v"][i] = self.momentum * s["v"][i] - self.rate * np.clip(g, -self.clip, self.clip)
            s["w"][i] = s["w"][i] + s["v"][i]
        s["n"] += 1
        gap = at - s["mean"]
        s["mean"] = s["mean"] + gap / s["n"]
        s["var"] = s["var"] + (gap * (at - s["mean"]) - s["var"]) / s["n"] if s["n"] > 1 else np.maximum(np.abs(gap), 1.0)
        return float(p), s


@dataclass
class NeuralMoE:
    """Learners behind a linear router with a bias that evens the load; the `top` experts of the greatest score answer by softmax and learn.

    An expert that got no row for `dead` rows starts again.
    """

    dim: int
    experts: tuple
    top: int = 2
    rate: float = 0.01
    balance: float = 0.01
    dead: int = 500

    def new(self):
        n = len(self.experts)
        return {"w": np.zeros((n, self.dim)), "bias": np.zeros(n), "at": [e.new() for e in self.experts], "idle": np.zeros(n), "error": np.ones(n)}

    def step(self, s, x, y):
        n = len(self.experts)
        score = s["w"] @ x
        on = np.argsort(-(score + s["bias"]), kind="stable")[: self.top]
        gate = np.exp(score[on] - score[on].max())
        gate /= gate.sum()
        p, errors = 0.0, []
        for i, g in zip(on, gate, strict=True):
            q, s["at"][i] = self.experts[i].step(s["at"][i], x, y)
            p += g * q
            errors.append(abs(q - y))
            s["error"][i] = 0.99 * s["error"][i] + 0.01 * errors[-1]
        best = np.arange(len(on)) == int(np.argmin(errors))
        s["w"][on] -= self.rate * np.outer(gate - best, x)
        load = np.bincount(on, minlength=n) / len(on)
        s["bias"] += self.balance * np.sign(1 / n - load)
        s["idle"] = np.where(load > 0, 0, s["idle"] + 1)
        for i in np.flatnonzero(s["idle"] >= self.dead):
            s["at"][i], s["idle"][i], s["w"][i] = self.experts[i].new(), 0, 0.0
        return float(p), s


@dataclass
class ElasticLinear:
    """Linear SGD that resists forgetting: weights are pulled to an anchor by their Fisher information (EWC), the anchor follows every `every` rows;
    at a drift of the error (the share `frozen` of) the most important weights are frozen, unused ones are drawn anew.
    """

    dim: int
    rate: float = 0.01
    pull: float = 0.1
    every: int = 200
    frozen: float = 0.2
    seed: int = 0

    def new(self):
        n = self.dim + 1
        return {"w": np.zeros(n), "anchor": np.zeros(n), "fisher": np.zeros(n), "n": 0, "mask": np.ones(n), "rng": np.random.default_rng(self.seed)}

    def step(self, s, x, y):
        z = np.append(x, 1.0)
        p = float(s["w"] @ z)
        g = (p - y) * z
        s["fisher"] = 0.99 * s["fisher"] + 0.01 * g * g
        s["w"] = s["w"] - s["mask"] * self.rate * (g + self.pull * s["fisher"] / (s["fisher"].max() + 1e-12) * (s["w"] - s["anchor"]))
        s["n"] += 1
        if s["n"] % self.every == 0:
            s["anchor"] = s["w"].copy()
        return p, s

    def on_drift(self, s):
        k = int(self.frozen * len(s["w"]))
        order = np.argsort(-s["fisher"], kind="stable")
        s["mask"] = np.ones(len(s["w"]))
        s["mask"][order[:k]] = 0.0
        idle = s["fisher"] < 1e-12
        s["w"] = np.where(idle, s["rng"].normal(0, 0.01, len(s["w"])), s["w"])
        s["anchor"] = s["w"].copy()
        return s
