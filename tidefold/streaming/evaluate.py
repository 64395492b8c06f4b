"""Evaluation of ordered learners: prequential and progressive runs, members of an ensemble as parallel groups, pipelines, drift wrappers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import run_batch


def prequential(df: DataFrame, learner, key: list[str], order: list[str], x: str, y: str, warmup: int = 0, every: int = 1) -> DataFrame:
    """Test, then train: (key, order, target, prediction) of the rows that count: past the first `warmup` of a key, and each `every`-th."""
    from pyspark.sql import Window

    out = run_batch(df, learner, key, order, x, y)
    if warmup == 0 and every == 1:
        return out
    seen = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return out.withColumn("_seen", seen).where((F.col("_seen") > warmup) & (F.col("_seen") % every == 0)).drop("_seen")


@dataclass
class HeldOut:
    """Passes rows over the learner's training: every `period`-th row, or a random `share` of them; they are predicted all the same."""

    model: object
    period: int = 0
    share: float = 0.0
    seed: int = 0

    def new(self):
        return [0, np.random.default_rng(self.seed), self.model.new()]

    def step(self, s, x, y):
        import copy

        s[0] += 1
        out = s[0] % self.period == 0 if self.period else s[1].random() < self.share
        if out:
            return self.model.step(copy.deepcopy(s[2]), x, y)[0], s
        p, s[2] = self.model.step(s[2], x, y)
        return p, s


def progressive(df: DataFrame, learner, key: list[str], order: list[str], x: str, y: str, period: int = 0, share: float = 0.0) -> DataFrame:
    """Scores every row; held-out rows are not learned (none, periodic, or random)."""
    return run_batch(df, HeldOut(learner, period, share) if period or share else learner, key, order, x, y)


def run_members(df: DataFrame, members: list, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """(key, member, order, target, prediction): independent learners as (key, member) groups, so that an ensemble spreads over tasks."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        model = members[int(pdf["member"].iloc[0])]
        state, out = model.new(), np.empty(len(pdf))
        for i, (a, b) in enumerate(zip(pdf[x], pdf[y], strict=True)):
            out[i], state = model.step(state, np.asarray(a, float), float(b))
        return pdf[[*key, "member", *order]].assign(target=pdf[y].astype(float), prediction=out)

    rows = df.select(*key, *order, x, y).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(len(members) - 1))))
    schema = T.StructType([*[df.schema[c] for c in key], T.StructField("member", T.IntegerType()), *[df.schema[c] for c in order], T.StructField("target", T.DoubleType()), T.StructField("prediction", T.DoubleType())])
    return rows.groupBy(*key, "member").applyInPandas(each, schema)


@dataclass
class PoissonTimes:
    """A bag's member: learns a row as often as a Poisson(1) draw says, and predicts every row."""

    model: object
    seed: int

    def new(self):
        return [np.random.default_rng(self.seed), self.model.new()]

    def step(self, s, x, y):
        import copy

        k = int(s[0].poisson(1.0))
        p, state = self.model.step(s[1] if k else copy.deepcopy(s[1]), x, y)
        if k:
            for _ in range(k - 1):
                _, state = self.model.step(state, x, y)
            s[1] = state
        return p, s


def bagged(df: DataFrame, learner, size: int, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """The mean prediction of `size` bagged members; each is its own group of rows."""
    out = run_members(df, [PoissonTimes(learner, i) for i in range(size)], key, order, x, y)
    return out.groupBy(*key, *order).agg(F.first("target").alias("target"), F.avg("prediction").alias("prediction"))


def multi_target(df: DataFrame, learner, key: list[str], order: list[str], x: str, ys: list[str]) -> DataFrame:
    """(key, target_name, order, target, prediction): one model a target, each its own group."""
    rows = df.select(*key, *order, x, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in ys])).alias("_t"))
    rows = rows.select(*key, F.col("_t.name").alias("target_name"), *order, x, F.col("_t.v").alias("_y"))
    return run_batch(rows, learner, [*key, "target_name"], order, x, "_y")


@dataclass
class Pipeline:
    """Preprocessors, then a learner. In training each one is updated by the row and then transforms it; `predict` transforms with frozen states.

    A preprocessor has new(), update(state, x) -> (x, state) and transform(state, x); so have the reservoirs and layers of `operators.neural`.
    """

    stages: tuple
    model: object

    def new(self):
        return [p.new() for p in self.stages], self.model.new()

    def step(self, s, x, y):
        states, model = s
        z, after = np.asarray(x, float), []
        for p, a in zip(self.stages, states, strict=True):
            z, a = p.update(a, z)
            after.append(a)
        out, model = self.model.step(model, z, y)
        return out, (after, model)

    def predict(self, s, x):
        import copy

        z = np.asarray(x, float)
        for p, a in zip(self.stages, s[0], strict=True):
            z = p.transform(a, z)
        return self.model.step(copy.deepcopy(s[1]), z, 0.0)[0]


@dataclass
class Scale:
    """Running mean and population deviation: (x - mean) / sqrt(variance + floor), this row included."""

    floor: float = 1e-12

    def new(self):
        return 0, 0.0, 0.0

    def update(self, s, x):
        n, mean, m2 = s
        gap = x - mean
        mean = mean + gap / (n + 1)
        s = n + 1, mean, m2 + gap * (x - mean)
        return self.transform(s, x), s

    def transform(self, s, x):
        n, mean, m2 = s
        return (x - mean) / np.sqrt(m2 / max(n, 1) + self.floor)


@dataclass
class Continual:
    """A learner whose error feeds a drift detector; at a drift it starts again, if `restart`, or its on_drift is called, if it has one."""

    model: object
    detector: object
    restart: bool = True

    def new(self):
        return {"model": self.model.new(), "detector": self.detector.new(), "drifts": 0}

    def step(self, s, x, y):
        p, s["model"] = self.model.step(s["model"], x, y)
        signal, s["detector"] = self.detector.step(s["detector"], [abs(p - y)], 0.0)
        if signal == 2:
            s["drifts"] += 1
            if self.restart:
                s["model"] = self.model.new()
            elif hasattr(self.model, "on_drift"):
                s["model"] = self.model.on_drift(s["model"])
        return p, s


@dataclass
class AutoTuner:
    """Champions and challengers: `factory(config)` learners of random configurations race on the same rows; every `round_` rows the worse half goes.

    Prediction: the best one's by smoothed error, raised by `cost` per unit of its complexity. When one is left, a new race starts with it and
    perturbed copies; so it does when the detector finds a drift of the champion's error. space: name -> (low, high), (low, high, "log") or a list.
    """

    factory: object
    space: dict
    size: int = 8
    round_: int = 200
    cost: float = 0.0
    detector: object = None
    seed: int = 0

    def sample(self, rng) -> dict:
        out = {}
        for name, v in self.space.items():
            if isinstance(v, list):
                out[name] = v[int(rng.integers(len(v)))]
            elif len(v) == 3:
                out[name] = float(np.exp(rng.uniform(np.log(v[0]), np.log(v[1]))))
            else:
                out[name] = int(rng.integers(v[0], v[1] + 1)) if isinstance(v[0], int) else float(rng.uniform(v[0], v[1]))
        return out

    def latin(self, rng, n: int) -> list[dict]:
        """n configurations, one in each n-th of every numeric range."""
        out = [self.sample(rng) for _ in range(n)]
        for name, v in self.space.items():
            if isinstance(v, list):
                continue
            u = (rng.permutation(n) + rng.random(n)) / n
            at = np.exp(np.log(v[0]) + u * (np.log(v[1]) - np.log(v[0]))) if len(v) == 3 else v[0] + u * (v[1] - v[0])
            for c, x in zip(out, at, strict=True):
                c[name] = int(round(x)) if isinstance(v[0], int) and len(v) == 2 else float(x)
        return out

    def perturb(self, rng, config: dict, share: float = 0.2) -> dict:
        other = self.sample(rng)
        out = {}
        for k, a in config.items():
            v, b = self.space[k], other[k]
            out[k] = (b if rng.random() < share else a) if isinstance(v, list) else type(a)(a + share * (b - a))
        return out

    def _race(self, rng, best):
        configs = self.latin(rng, self.size) if best is None else [best["config"], *(self.perturb(rng, best["config"]) for _ in range(self.size - 1))]
        out = [{"config": c, "model": (m := self.factory(c)), "state": m.new(), "error": None} for c in configs]
        if best is not None:
            out[0] = best
        return out

    def new(self):
        rng = np.random.default_rng(self.seed)
        return {"rng": rng, "all": self._race(rng, None), "n": 0, "detector": self.detector.new() if self.detector else None, "races": 1}

    def score(self, c):
        return float("inf") if c["error"] is None else c["error"] * (1 + self.cost * getattr(c["model"], "complexity", 0.0))

    def step(self, s, x, y):
        best = min(s["all"], key=self.score)
        out = 0.0
        for c in s["all"]:
            p, c["state"] = c["model"].step(c["state"], x, y)
            if c is best:
                out = p
            e = (p - y) ** 2
            c["error"] = e if c["error"] is None else 0.98 * c["error"] + 0.02 * e
        s["n"] += 1
        drift = False
        if self.detector:
            signal, s["detector"] = self.detector.step(s["detector"], [abs(out - y)], 0.0)
            drift = signal == 2
        if s["n"] % self.round_ == 0 or drift:
            order = sorted(s["all"], key=self.score)
            if drift or len(order) == 1:
                s["all"], s["races"] = self._race(s["rng"], order[0]), s["races"] + 1
            else:
                s["all"] = order[: max(1, len(order) // 2)]
        return out, s
