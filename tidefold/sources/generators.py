"""Seeded synthetic streams with concept drift as a Spark data source.

`spark.dataSource.register(GeneratorSource)`, then `spark.read.format("tidefold_stream").option("kind", "sea")
.option("seed", 1).option("rows", 1000).load()`; a comma-separated list of seeds makes one ordered partition each.
Rows: seed, seq, features, target, drift. Other options (noise, changes, drift, ...) go to the generator, as JSON values.
"""

from __future__ import annotations

import inspect
import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ALL = (1 << 64) - 1


class Xorshift:
    """xorshift64 with shifts 13, 7, 17, started at seed + 1."""

    def __init__(self, seed: int):
        self.s = (seed + 1) & _ALL

    def next(self) -> int:
        s = self.s
        s ^= (s << 13) & _ALL
        s ^= s >> 7
        s ^= (s << 17) & _ALL
        self.s = s
        return s

    def uniform(self, lo: float = 0.0, hi: float = 1.0) -> float:
        return lo + self.next() / _ALL * (hi - lo)

    def below(self, n: int) -> int:
        return self.next() % n

    def coin(self, p: float) -> bool:
        return self.uniform() < p

    def normal(self, sd: float = 1.0) -> float:
        u = max(self.uniform(), 1e-15)
        return sd * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.uniform())


Rows = Iterator[tuple[list[float], float, bool]]

#: SEA thresholds by concept, segments of the digits 0 to 9, Friedman coefficients with the size, speed and phase of their drift.
SEA_THRESHOLDS = (8.0, 9.0, 7.0, 9.5)
LED_SEGMENTS = ("1111110", "0110000", "1101101", "1111001", "0110011", "1011011", "1011111", "1110000", "1111111", "1111011")
FRIEDMAN = ((10.0, 5.0, 0.001, math.sin), (20.0, 10.0, 0.0007, math.cos), (10.0, 5.0, 0.0013, math.sin), (5.0, 2.5, 0.0009, math.cos))
#: The ten rules of loan applications.
AGRAWAL = (
    lambda r: not 40 <= r["age"] < 60,
    lambda r: r["salary"] < 60_000,
    lambda r: 40 <= r["age"] < 60 or r["salary"] >= 100_000,
    lambda r: r["elevel"] >= 3 or r["salary"] < 40_000,
    lambda r: r["salary"] + r["commission"] - r["loan"] > 50_000,
    lambda r: r["car"] > 15 or r["hvalue"] > 300_000,
    lambda r: r["hyears"] > 10 and r["loan"] < 200_000,
    lambda r: r["age"] > 50 and r["zipcode"] >= 4,
    lambda r: r["commission"] > 40_000 or r["hvalue"] > 400_000,
    lambda r: r["salary"] > 80_000 and r["age"] < 50 and r["elevel"] >= 2,
)


def sea(seed: int, rows: int, changes: tuple[int, ...] = (12_500, 25_000, 37_500), noise: float = 0.1) -> Rows:
    """Three features in [0, 10); label by the first two against a threshold that changes at `changes`; labels flip with `noise`."""
    rng = Xorshift(seed)
    for i in range(rows):
        x = [rng.uniform(0, 10) for _ in range(3)]
        concept = min(sum(i >= c for c in changes), len(SEA_THRESHOLDS) - 1)
        label = x[0] + x[1] <= SEA_THRESHOLDS[concept]
        yield x, float(label != rng.coin(noise)), i in changes


def agrawal(seed: int, rows: int, rule: int = 0, changes: tuple[tuple[int, int], ...] = (), noise: float = 0.05) -> Rows:
    """Nine features of a loan application, labelled by one of ten rules; changes are (row, new rule)."""
    rng, turns = Xorshift(seed), dict(changes)
    for i in range(rows):
        rule = turns.get(i, rule)
        r = {"salary": rng.uniform(20_000, 150_000)}
        r["commission"] = rng.uniform(10_000, 75_000) if r["salary"] < 75_000 else 0.0
        r["age"] = rng.uniform(20, 80)
        r["elevel"], r["car"], r["zipcode"] = rng.below(5), rng.below(20) + 1, rng.below(9)
        r["hvalue"] = (r["zipcode"] + 1) * 100_000 * (1 + rng.uniform(-0.3, 0.3))
        r["hyears"], r["loan"] = rng.uniform(1, 30), rng.uniform(0, 500_000)
        yield [float(v) for v in r.values()], float(AGRAWAL[rule](r) != rng.coin(noise)), i in turns


def hyperplane(seed: int, rows: int, d: int = 10, drifting: int = 3, magnitude: float = 0.01, noise: float = 0.05) -> Rows:
    """Uniform features against a plane whose first weights move, even ones up and odd ones down, before each row."""
    rng = Xorshift(seed)
    w = [(i + 1) / d + rng.uniform(-0.1, 0.1) for i in range(d)]
    moves = magnitude > 0 and drifting > 0
    for i in range(rows):
        if moves:
            w[:drifting] = [min(10.0, max(0.01, v + (-magnitude if j % 2 else magnitude))) for j, v in enumerate(w[:drifting])]
        x = [rng.uniform() for _ in range(d)]
        total = sum(a * b for a, b in zip(x, w, strict=True))
        yield x, float(total + rng.normal(noise) > sum(w) * 0.5), moves and i > 0 and i % 100 == 0


def led(seed: int, rows: int, noise: float = 0.1, changes: tuple[int, ...] = ()) -> Rows:
    """A digit by seven noisy segments, whose places are shuffled at `changes`, and seventeen coin flips."""
    rng, place = Xorshift(seed), list(range(7))
    for i in range(rows):
        if i in changes:
            for k in range(6, 0, -1):
                j = rng.below(k + 1)
                place[k], place[j] = place[j], place[k]
        digit = rng.below(10)
        x = [0.0] * 24
        for k, lit in enumerate(LED_SEGMENTS[digit]):
            x[place[k]] = float((lit == "1") != rng.coin(noise))
        x[7:] = [float(rng.coin(0.5)) for _ in range(17)]
        yield x, float(digit), i in changes


def rbf(seed: int, rows: int, centroids: int = 50, d: int = 10, classes: int = 2, speed: float = 0.0001, spread: float = 0.1) -> Rows:
    """Normal clouds around weighted centroids that wander within the unit cube."""
    rng, at = Xorshift(seed), []
    for _ in range(centroids):
        center = [rng.uniform() for _ in range(d)]
        label, weight = rng.below(classes), rng.uniform(0.1, 1.0)
        way = [rng.normal() for _ in range(d)]
        norm = max(math.sqrt(sum(v * v for v in way)), 1e-10)
        at.append((center, label, weight, [v / norm for v in way]))
    upto = list(accumulate(c[2] for c in at))
    for i in range(rows):
        if speed > 0:
            for center, _, _, way in at:
                center[:] = [min(1.0, max(0.0, c + v * speed)) for c, v in zip(center, way, strict=True)]
        center, label, _, _ = at[min(bisect_left(upto, rng.uniform(0, upto[-1])), centroids - 1)]
        yield [c + rng.normal(spread) for c in center], float(label), speed > 0 and i > 0 and i % 100 == 0


def waveform(seed: int, rows: int, noisy: bool = False) -> Rows:
    """Three classes, each a random mixture of two of three triangles over 21 places, with unit noise; 19 places of noise alone on request."""
    rng = Xorshift(seed)
    peak = lambda lo, top: [max(0.0, min(i - lo, 2 * top - lo - i)) for i in range(1, 22)]
    shapes = peak(0, 7), peak(4, 11), peak(8, 15)
    for _ in range(rows):
        label, u = rng.below(3), rng.uniform()
        one, other = ((0, 1), (0, 2), (1, 2))[label]
        x = [u * a + (1 - u) * b + rng.normal() for a, b in zip(shapes[one], shapes[other], strict=True)]
        yield x + [rng.normal() for _ in range(19 * noisy)], float(label), False


def friedman(seed: int, rows: int, noise: float = 1.0, drift: float = 0.0) -> Rows:
    """Friedman's first function of ten uniform features; drift scales slow waves of its coefficients."""
    rng = Xorshift(seed)
    for i in range(rows):
        a, b, c, e = (base + drift * wave(speed * i) * size for base, size, speed, wave in FRIEDMAN)
        x = [rng.uniform() for _ in range(10)]
        y = a * math.sin(math.pi * x[0] * x[1]) + b * (x[2] - 0.5) ** 2 + c * x[3] + e * x[4] + rng.normal(noise)
        yield x, y, drift > 0 and i > 0 and i % 500 == 0


def mackey_glass(seed: int, rows: int, tau: int = 17, lags: int = 6, warm: int = 500) -> Rows:
    """Windows of the delay equation with beta 0.2, gamma 0.1, n 10; the target lies one step beyond the next value."""
    rng = Xorshift(seed)
    s = [0.9 + rng.uniform(-0.1, 0.1) for _ in range(tau)]
    while len(s) < warm + rows + lags + 2:
        back = s[-tau]
        s.append(s[-1] + 0.2 * back / (1 + back**10) - 0.1 * s[-1])
    for i in range(warm, warm + rows):
        yield s[i : i + lags], s[i + lags + 1], False


def lorenz(seed: int, rows: int, dt: float = 0.01, every: int = 10, warm: int = 1000) -> Rows:
    """The Lorenz system from (1, 1, 1) by fourth-order Runge-Kutta, each `every`-th step after a warm-up; the target is the next x. It has no randomness."""

    def slope(v):
        return np.array([10.0 * (v[1] - v[0]), v[0] * (28.0 - v[2]) - v[1], v[0] * v[1] - 8 / 3 * v[2]])

    v, last = np.ones(3), None
    for step in range(warm + (rows + 1) * every):
        k1 = slope(v)
        k2 = slope(v + dt / 2 * k1)
        k3 = slope(v + dt / 2 * k2)
        v = v + dt / 6 * (k1 + 2 * k2 + 2 * k3 + slope(v + dt * k3))
        if step >= warm and (step - warm) % every == 0:
            if last is not None:
                yield last.tolist(), float(v[0]), False
            last = v


KINDS = {
    "sea": sea, "agrawal": agrawal, "hyperplane": hyperplane, "led": led, "rbf": rbf, "waveform": waveform, "friedman": friedman,
    "mackey_glass": mackey_glass, "lorenz": lorenz,
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.rows = options.get("kind", "sea"), int(options.get("rows", "1000"))
        self.seeds = [int(s) for s in str(options.get("seed", "42")).split(",")]
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        known = inspect.signature(KINDS[self.kind]).parameters
        self.more = {k: json.loads(v) for k, v in options.items() if k in known and k not in ("seed", "rows")}

    def partitions(self):
        return [InputPartition(s) for s in self.seeds]

    def read(self, partition: InputPartition):
        for i, (x, y, drift) in enumerate(KINDS[self.kind](partition.value, self.rows, **self.more)):
            yield partition.value, i, [float(v) for v in x], float(y), bool(drift)


class GeneratorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidefold_stream"

    def schema(self) -> str:
        return "seed long, seq long, features array<double>, target double, drift boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
