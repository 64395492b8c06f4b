"""Learners, generators, model tables and exports against plain loops, brute force and each other."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tidefold.operators import adaptive, boosting, forests, learners, neural
from tidefold.plans import catalog
from tidefold.sinks import models as sinks
from tidefold.sources.generators import KINDS, LED_SEGMENTS, SEA_THRESHOLDS
from tidefold.streaming import evaluate, fold


def data(n=600, dim=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, dim))
    return x, 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=n)


def run(model, x, y):
    s, out = model.new(), []
    for a, b in zip(x, y, strict=True):
        p, s = model.step(s, a, float(b))
        out.append(p)
    return np.array(out), s


class PlainTree:
    """One Hoeffding tree by the book, in dictionaries."""

    def __init__(self, m):
        self.m, self.root = m, self.leaf(0)

    def leaf(self, depth, value=0.0, edges=None):
        return {"depth": depth, "value": value, "n": 0, "g": 0.0, "h": 0.0, "edges": edges, "seen": [], "cells": {}}

    def find(self, x):
        t = self.root
        while "f" in t:
            t = t["left"] if x[t["f"]] <= t["cut"] else t["right"]
        return t

    def learn(self, x, g, h):
        t, m = self.find(x), self.m
        t["n"], t["g"], t["h"] = t["n"] + 1, t["g"] + g, t["h"] + h
        t["value"] = -t["g"] / (t["h"] + m.reg)
        ready = t["edges"] is not None
        if not ready:
            t["seen"].append(list(x))
            if t["n"] >= m.grace:
                t["edges"] = []
                for col in zip(*t["seen"], strict=True):
                    lo, hi = min(col), max(col)
                    t["edges"].append([lo] if hi - lo < 2.3e-16 else [lo + (hi - lo) / m.bins * i for i in range(1, m.bins)])
        if t["edges"] is not None:
            for f, v in enumerate(x):
                c = t["cells"].setdefault((f, sum(e <= v for e in t["edges"][f])), [0.0, 0.0])
                c[0], c[1] = c[0] + g, c[1] + h
        if ready and t["n"] % m.grace == 0 and t["depth"] < m.depth:
            self.split(t)

    def split(self, t):
        m, best = self.m, []
        for f, edges in enumerate(t["edges"]):
            cells = [t["cells"].get((f, b), [0.0, 0.0]) for b in range(len(edges) + 1)]
            g, h = (sum(c[i] for c in cells) for i in (0, 1))
            top, gl, hl = None, 0.0, 0.0
            for b, c in enumerate(cells[:-1]):
                gl, hl = gl + c[0], hl + c[1]
                if hl < 1 or h - hl < 1:
                    continue
                gain = 0.5 * (gl**2 / (hl + m.reg) + (g - gl) ** 2 / (h - hl + m.reg) - g * g / (h + m.reg)) - m.gamma
                if top is None or gain > top[0]:
                    top = (gain, f, edges[b], (gl, hl), (g - gl, h - hl))
            if top and top[0] > 0:
                best.append(top)
        best.sort(key=lambda v: -v[0])
        if not best:
            return
        eps = math.sqrt(math.log(1 / m.delta) / (2 * t["n"]))
        if best[0][0] - (best[1][0] if len(best) > 1 else 0.0) <= eps and eps >= 0.05:
            return
        _, f, cut, a, b = best[0]
        kids = [self.leaf(t["depth"] + 1, -v[0] / (v[1] + m.reg), t["edges"]) for v in (a, b)]
        t.clear()
        t.update(f=f, cut=cut, left=kids[0], right=kids[1])


@pytest.mark.parametrize("loss", ["squared", "logistic", "huber", "quantile", "expectile"])
def test_boosting_against_plain_trees(loss):
    m = boosting.SGBT(3, steps=4, rate=0.2, depth=3, bins=8, grace=25, delta=0.05, subsample=1.0, loss=loss, tau=0.7, start=20, drift=(0.005, 1e9))
    x, y = data()
    y = (y > 0.5).astype(float) if loss == "logistic" else y
    got, s = run(m, x, y)
    trees, base, first, want = [PlainTree(m) for _ in range(4)], 0.0, [], []
    for a, b in zip(x, y, strict=True):
        if first is not None:
            first.append(b)
            if len(first) == 20:
                base, first = boosting.first_prediction(loss, first, 0.7), None
        p = base
        for t in trees:
            g, h = boosting.gradients(loss, b, np.array([p]), 0.7)
            own = t.find(a)["value"]
            t.learn(a, float(g[0]), float(h[0]))
            p += 0.2 * own
        want.append(m.output(p))
    np.testing.assert_allclose(got, want, atol=1e-8)
    assert sum(n[2] >= 0 for n in m.nodes(s)) >= 3 or loss in ("logistic",)


@pytest.mark.parametrize("make", [
    lambda: boosting.SGBT(3, steps=4, rate=0.3, depth=3, bins=8, grace=20, start=10, drift=(0.005, 8.0)), lambda: boosting.SGBT(3, steps=3, rate=0.3, grace=20, start=10, loss="logistic", shared=True, lifetime=60),
    lambda: boosting.SGBT(3, steps=2, rate=0.3, grace=20, start=10, variant=("skip", 4)), lambda: learners.RLS(3, 0.98, adaptive=True), lambda: learners.RLS(3, 0.95),
])
def test_series_together_equal_series_alone(make):
    """Also of different lengths, with drifts, replacements and restarts."""
    rng = np.random.default_rng(9)
    xs, ys = [], []
    for n in (150, 3, 0, 200, 77):
        x, y = data(n, seed=n)
        y[n // 2 :] += 4
        xs.append(x)
        ys.append((y > 1).astype(float) if n % 2 == 0 else y + rng.normal(size=n))
    for got, x, y in zip(make().fold_many(xs, ys), xs, ys, strict=True):
        np.testing.assert_allclose(got, run(make(), x, y)[0], atol=1e-7)


def test_boosting_replaces_trees_at_a_drift():
    x, y = data(2000)
    y[1000:] = 40 - 5 * x[1000:, 2]
    # five steps at a rate of 0.5 leave 0.5^5 of a shift of some 37
    m = boosting.SGBT(3, steps=5, rate=0.5, grace=20, start=10)
    p, s = run(m, x, y)
    assert s["replaced"] >= 5 and np.abs(p[-100:] - y[-100:]).mean() < 4 and np.isfinite(p).all()
    old = boosting.SGBT(3, steps=5, rate=0.2, grace=20, start=10, lifetime=200, drift=(0.005, 1e9))
    assert run(old, x, y)[1]["replaced"] >= 5 * 7


@pytest.mark.parametrize("name", sorted({**catalog.LEARNERS, **catalog.CLASSIFIERS}))
def test_no_learner_looks_ahead(name):
    """Predictions depend on earlier rows alone, repeat exactly, and are finite."""
    make = {**catalog.LEARNERS, **catalog.CLASSIFIERS}[name]
    x, y = data(160)
    x[:, 0] = 1.0
    if name in catalog.CLASSIFIERS:
        y = np.clip(np.floor(y + 1), 0, 2)
    one, _ = run(make(), x, y)
    again, _ = run(make(), x, y)
    assert np.isfinite(one).all() and (one == again).all()
    other = y.copy()
    other[120:] = 0.0
    late, _ = run(make(), x, other)
    assert (one[:121] == late[:121]).all()


LEARN = ["adaptive_rls", "polynomial_rls", "next_generation_reservoir", "diagonal_ssm", "mamba", "test_time_training", "kan", "neural_moe", "mondrian_forest", "stacked", "pipeline_scaled", "auto_tuner"]


@pytest.mark.parametrize("name", LEARN)
def test_learners_learn(name):
    x, y = data(900)
    x[:, 2] = 1.0
    e = (run(catalog.LEARNERS[name](), x, y)[0] - y) ** 2
    assert e[-200:].mean() < 0.5 * y.var()


@pytest.mark.parametrize("mode", neural.MODES)
def test_attention_learns(mode):
    x, y = data(900)
    e = (run(neural.Attention(3, mode), x, y)[0] - y) ** 2
    assert e[-200:].mean() < 0.2 * y.var()


def test_attention_state_by_its_rule():
    m = neural.Attention(3, "delta", 1, 2, seed=3)
    x, _ = data(5)
    state, s = m.begin(), np.zeros((2, 2))
    for a in x:
        z, state = m.features(state, a)
        k = m.wk[0] @ a
        k /= np.linalg.norm(k)
        s = s + np.outer(k, m.wv[0] @ a - s.T @ k)
        np.testing.assert_allclose(state[0], s)
        np.testing.assert_allclose(z[:2], s.T @ (m.wq[0] @ a))


def test_classifiers_learn():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = (x[:, 0] > 0.5).astype(float)
    for m, least in ((forests.HoeffdingClassifier(4, grace=100), 0.9), (forests.AdaptiveForest(4, 7, share=0.8), 0.85), (boosting.Multiclass(2, boosting.SGBT(4, steps=10, rate=0.3, grace=30, loss="softmax", start=10)), 0.9), (forests.Classifier(learners.RLS(4)), 0.7)):
        p, _ = run(m, x, y)
        assert (p[-500:] == y[-500:]).mean() >= least, m


def test_linear_keeps_its_bias_free_of_regularisation():
    m, s, w, b = learners.Linear(2, 0.05, ridge=0.1, lasso=0.01), None, [0.0, 0.0], 0.0
    x, y = data(50, 2)
    s = m.new()
    for a, t in zip(x, y, strict=True):
        p, s = m.step(s, a, t)
        e = w[0] * a[0] + w[1] * a[1] + b - t
        w = [v * (1 - 0.05 * 0.1) - 2 * 0.05 * e * c for v, c in zip(w, a, strict=True)]
        w = [math.copysign(max(abs(v) - 0.05 * 0.01, 0), v) for v in w]
        b -= 2 * 0.05 * e
        np.testing.assert_allclose(s, [*w, b])


def test_rls_against_least_squares():
    x, y = data(200)
    _, s = run(learners.RLS(3, 1.0, 1e6), x, y)
    np.testing.assert_allclose(s[0], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-4)
    mean, low, high = learners.RLS(3).interval(s, x[0])
    assert low < mean < high
    wild, fresh = learners.RLS(3, 0.5).step((np.zeros(3), np.eye(3) * 1e11, 0.0, 0.0), np.array([1e-9, 0, 0]), 1.0)
    assert wild == 0 and (fresh[1] == np.eye(3) * 100).all() and (fresh[0] == 0).all()


def test_adwin_windows():
    m = learners.ADWIN()

    def signals(values):
        s, out = m.new(), []
        for v in values:
            p, s = m.step(s, [v], 0.0)
            out.append(p)
        return out, s

    assert not any(v == 2 for v in signals([0.5] * 2000)[0])
    out, s = signals([0.0] * 500 + [1.0] * 500)
    first = out.index(2.0)
    assert 500 <= first < 560
    flat = [b for row in s for b in row]
    assert sum(n for n, _ in flat) < 600 and sum(t for _, t in flat) / sum(n for n, _ in flat) > 0.8
    # by the definition, over single rows: the first window that any cut of its buckets splits
    w, d = 32, math.log
    values, s = [0.2] * 20 + [0.9] * 60, m.new()
    for i, v in enumerate(values):
        p, s = m.step(s, [v], 0.0)
        if p == 2:
            n = i + 1
            cuts = [(n - r, r) for r in range(1, n)]
            assert n > w and any(abs(np.mean(values[:a]) - np.mean(values[a:n])) >= math.sqrt((1 / a + 1 / b) / 2 * d(4 * d(n) / 0.002)) for a, b in cuts)
            break


def test_half_space_score_sums_the_path():
    m = adaptive.HalfSpaceTrees(2, 3, 2, 4, seed=1)
    rows = np.random.default_rng(0).random((12, 2))
    got, _ = run(m, rows, np.zeros(12))
    last, now = [{} for _ in range(3)], [{} for _ in range(3)]
    for i, x in enumerate(rows):
        total = 0.0
        for t in range(3):
            lo, hi, node = [0.0, 0.0], [1.0, 1.0], 0
            for level in range(3):
                total += last[t].get(node, 0) * 2 ** (2 - level)
                now[t][node] = now[t].get(node, 0) + 1
                if level < 2:
                    f = m.features[t, node]
                    mid = (lo[f] + hi[f]) / 2
                    if x[f] < mid:
                        hi[f], node = mid, 2 * node + 1
                    else:
                        lo[f], node = mid, 2 * node + 2
        assert got[i] == pytest.approx(1 - min(total / (3 * 4 * 7), 1))
        if (i + 1) % 4 == 0:
            last, now = now, [{} for _ in range(3)]


def test_dbstream_moves_the_nearest_alone():
    m = adaptive.DBStream(1.0, decay=0.0)
    s = m.new()
    for v in (0.0, 1.5, 0.8):
        _, s = m.step(s, np.array([v]), 0.0)
    assert [round(float(c[0]), 6) for c, _ in s["at"].values()] == [0.0, 1.15]  # 0.8 lies within both; 1.5 is nearer
    assert s["ties"] == {(0, 1): (1, 2)} and m.macro(s) == {0: 0, 1: 0}


def test_kmeans_forgets_after_the_step():
    m = learners.KMeans(1, 0.5)
    s = m.new()
    for v in (0.0, 4.0, 4.0):
        _, s = m.step(s, np.array([v]), 0.0)
    # counts: 1, then 2 -> center 2 -> 1, then 2 -> center 3
    assert s[0][0][0] == pytest.approx(3.0) and s[1] == [1.0]


def test_snarimax_forecasts_and_holt_winters():
    y = np.sin(np.arange(400) / 3) + 2
    p, s = run(adaptive.Snarimax(p=3, q=0, rate=0.01), np.zeros((400, 0)), y)
    assert ((p - y) ** 2)[-50:].mean() < 0.3 * y.var()
    assert len(adaptive.Snarimax(p=3, q=0).forecast(s, 5)) == 5
    season = np.tile([1.0, 2.0, 4.0, 3.0], 60) * (1 + np.arange(240) / 240)
    for multiplicative in (False, True):
        p, s = run(learners.HoltWinters(4, multiplicative=multiplicative), np.zeros((240, 0)), season)
        assert np.abs(p - season)[-20:].max() < 0.5
    assert learners.HoltWinters(4, multiplicative=True).forecast(s, 4) == pytest.approx(season[-1] * 1.01, rel=0.1)


def test_ccipca_finds_the_wide_direction():
    x = np.random.default_rng(0).normal(size=(800, 3)) * [0.2, 3.0, 0.2]
    m = forests.CCIPCA(2)
    s = m.new()
    for a in x:
        _, s = m.update(s, a)
    assert abs(s["dir"][0][1]) > 0.99 and m.explained(s)[0] > 0.9


def test_feature_selector():
    m = forests.FeatureSelector(4, 0.5, warmup=2)
    s = m.new()
    s = m.learn(s, [1, 1, 5, 1])
    assert s["mask"].all()
    s = m.learn(s, [1, 1, 5, 1])
    assert m.transform(s, np.ones(4)).tolist() == [1, 0, 1, 0]


def test_splines_and_discretisation():
    b = neural.spline(np.linspace(-1, 1, 21), 5)
    np.testing.assert_allclose(b.sum(axis=-1), 1)
    assert b.shape == (21, 8) and (b >= -1e-12).all()
    a, g = neural.discretise(np.array([-1.0, 0.0]), np.ones(2), 0.1)
    np.testing.assert_allclose(a, [math.exp(-0.1), 1.0])
    np.testing.assert_allclose(g, [1 - math.exp(-0.1), 0.1])
    a, g = neural.discretise(np.array([-1.0]), np.ones(1), 0.1, "bilinear")
    np.testing.assert_allclose([a[0], g[0]], [0.95 / 1.05, 0.1 / 1.05])


def test_pooled_quantiles_ascend():
    assert boosting.pooled([1.0, 3.0, 2.0, 4.0]) == [1.0, 2.5, 2.5, 4.0]
    assert boosting.pooled([3.0, 2.0, 1.0]) == [2.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        boosting.Quantiles((0.9, 0.1), boosting.SGBT(1))


def test_schedules():
    m = boosting.SGBT(1, steps=1, rate=0.1)
    rate = lambda n, *k: boosting.Scheduled(m, k).rate({"n": n, "rate": 0.1, "best": math.inf, "bad": 0}, 1.0)
    assert rate(5, "constant") == 0.1 and rate(5, "linear", 0.0, 10) == pytest.approx(0.05) and rate(3, "exponential", 0.5) == pytest.approx(0.0125)
    assert rate(5, "cosine", 0.0, 10) == pytest.approx(0.0) and rate(10, "cosine", 0.0, 10) == pytest.approx(0.1)
    s, p = {"n": 0, "rate": 0.1, "best": math.inf, "bad": 0}, boosting.Scheduled(m, ("plateau", 0.5, 2, 0.01))
    assert [round(p.rate(s, v), 4) for v in (1, 2, 2, 2, 2)] == [0.1, 0.1, 0.1, 0.05, 0.05]


def test_soft_predictions_and_diagnostics():
    x, y = data(1500)
    m = boosting.SGBT(3, steps=6, rate=0.2, grace=30, bins=16, subsample=1.0, start=10, depth=3)
    _, s = run(m, x, y)
    for a in x[:20]:
        assert m.smooth(s, a, 1e-9) == pytest.approx(m.raw(s, a)) and abs(m.smooth(s, a, 0.02) - m.raw(s, a)) < 1.5
        assert abs(m.interpolated(s, a) - m.raw(s, a)) < 1.5 and m.variance(s, a) > 0
    nodes = m.nodes(s)
    assert [(t, n) for t, n, *_ in m.diagnostics(s)] == [(t, sum(v[0] == t and v[2] < 0 for v in nodes)) for t in range(6)]
    assert m.importances(s).sum() == pytest.approx(1) and m.importances(s)[2] < 0.3


@pytest.mark.parametrize("kernel", ["polynomial", "linear"])
def test_kernels(kernel):
    x, y = data(300)
    p, s = run(adaptive.KernelRLS(budget=30, kernel=kernel, novelty=1e-3), x, y)
    assert np.abs(p[-100:] - y[-100:]).mean() < 0.2


@pytest.mark.parametrize("stage", [adaptive.EchoState(3, 8), neural.SpikeNet(3, 6, change=0.1), neural.Mamba(3, 2), neural.Attention(3, "gla", 1, 2), neural.DiagonalSSM(3)])
def test_layers_as_preprocessors(stage):
    """transform shows what update would give and moves nothing."""
    x, _ = data(30)
    s = stage.new()
    for a in x:
        seen = stage.transform(s, a)
        again = stage.transform(s, a)
        z, s = stage.update(s, a)
        assert (seen == again).all() and (seen == z).all()
    p, _ = run(evaluate.Pipeline((stage,), learners.RLS(len(z), 0.999)), *data(300))
    assert np.isfinite(p).all()


def test_packed_distributional():
    x, y = data(800)
    m = boosting.Distributional(boosting.SGBT(3, steps=5, rate=0.2, grace=30, start=10, depth=3))
    _, s = run(m, x, y)
    blob, sd = sinks.pack_distributional(m, s, 3)
    mean, dev, _ = m.forecast(s, x[0])
    assert sinks.predict_packed(blob, x[:1])[0] == pytest.approx(mean, abs=1e-5) and sd == pytest.approx(dev)


# ---- generators


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_generators_repeat(kind):
    one, two = list(KINDS[kind](3, 200)), list(KINDS[kind](3, 200))
    assert one == two and len(one) == 200 and all(len(x) == len(one[0][0]) and math.isfinite(y) for x, y, _ in one)


def test_generators_follow_their_laws():
    rows = list(KINDS["sea"](1, 400, changes=(100, 200, 300), noise=0.0))
    assert [i for i, r in enumerate(rows) if r[2]] == [100, 200, 300]
    assert all(y == float(x[0] + x[1] <= SEA_THRESHOLDS[i // 100]) for i, (x, y, _) in enumerate(rows))
    for x, y, _ in KINDS["led"](1, 50, noise=0.0):
        assert "".join("01"[int(v)] for v in x[:7]) == LED_SEGMENTS[int(y)]
    for x, y, _ in KINDS["agrawal"](1, 200, rule=1, noise=0.0):
        assert y == float(x[0] < 60_000) and (x[1] > 0) == (x[0] < 75_000)
    series = list(KINDS["mackey_glass"](1, 30))
    assert series[0][0][1:] == series[1][0][:-1] and series[0][1] == series[2][0][-1]
    path = list(KINDS["lorenz"](1, 20))
    assert all(a[1] == b[0][0] for a, b in itertools.pairwise(path)) and path == list(KINDS["lorenz"](2, 20))
    assert all(0 <= v for x, _, _ in KINDS["friedman"](1, 20) for v in x)


def test_generator_options(spark):
    from tidefold.sources.generators import GeneratorSource

    spark.dataSource.register(GeneratorSource)
    df = spark.read.format("tidefold_stream").option("kind", "sea").option("seed", "1").option("rows", "50").option("changes", "[20]").option("noise", "0.0").load()
    rows = df.orderBy("seq").collect()
    assert [r.seq for r in rows if r.drift] == [20] and all(r.target == float(r.features[0] + r.features[1] <= (8.0 if r.seq < 20 else 9.0)) for r in rows)


# ---- model tables, scoring, export, explanation


@pytest.fixture(scope="module")
def boosted():
    x, y = data(1500)
    m = boosting.SGBT(3, steps=6, rate=0.2, grace=30, bins=16, subsample=1.0, start=10, depth=3)
    _, s = run(m, x, y)
    return m, s, m.nodes(s), x[:60], np.array([m.raw(s, a) for a in x[:60]])


def test_node_tables_score_like_the_model(spark, boosted):
    m, s, nodes, x, raw = boosted
    assert sinks.node_table(spark, m, s).count() == len(nodes)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "i int, x array<double>")
    got = {r.i: r.prediction for r in sinks.score_nodes(df, nodes, s["base"], m.rate, "x").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], raw)


def test_exports(boosted):
    m, s, nodes, x, raw = boosted
    np.testing.assert_allclose(sinks.predict_packed(sinks.pack(nodes, s["base"], m.rate, 3), x), raw, atol=1e-5)
    assert np.abs(sinks.predict_packed(sinks.pack16(nodes, s["base"], m.rate, 3), x) - raw).mean() < 0.01
    for bad in (b"", b"x" * 40, sinks.pack(nodes, 0.0, 1.0, 3)[:-1]):
        with pytest.raises(ValueError):
            sinks.unpack(bad)
    ort = pytest.importorskip("onnxruntime")
    ses = ort.InferenceSession(sinks.to_onnx(nodes, s["base"], m.rate, 3))
    np.testing.assert_allclose(ses.run(None, {"X": x.astype("f4")})[0][:, 0], raw, atol=1e-4)


def test_shap_against_all_subsets(boosted):
    m, s, nodes, x, raw = boosted
    own = [n for n in nodes if n[0] == 0]
    at = {n[1]: n for n in own}

    def value(known, a, i=0):
        _, _, f, cut, left, right, v, n, _ = at[i]
        if f < 0:
            return v
        if f in known:
            return value(known, a, left if a[f] <= cut else right)
        total = at[left][7] + at[right][7]
        w = at[left][7] / total if total else 0.5
        return w * value(known, a, left) + (1 - w) * value(known, a, right)

    for a in x[:5]:
        got, base = sinks.tree_shap(own, a, 3)
        for f in range(3):
            others = [k for k in range(3) if k != f]
            want = sum(math.factorial(len(c)) * math.factorial(2 - len(c)) / 6 * (value({*c, f}, a) - value(set(c), a)) for r in range(3) for c in itertools.combinations(others, r))
            assert got[f] == pytest.approx(want, abs=1e-9)
        assert base == pytest.approx(value(set(), a))
    v, e = sinks.shap(nodes, s["base"], m.rate, x[7], 3)
    assert v.sum() + e == pytest.approx(raw[7])


def test_fit_save_load_score(spark, tmp_path):
    x, y = data(120)
    df = spark.createDataFrame([(i % 2, i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, t int, x array<double>, y double")
    m = learners.RLS(3)
    sinks.save(sinks.fit(df, m, ["k"], ["t"], "x", "y"), str(tmp_path / "m"))
    got = sinks.score(df.drop("y"), sinks.load(spark, str(tmp_path / "m")), m, ["k"], "x").collect()
    for k in (0, 1):
        _, s = run(m, x[k::2], y[k::2])
        assert all(r.prediction == pytest.approx(float(s[0] @ x[r.t])) for r in got if r.k == k)
    _, s = run(m, x, y)
    assert (sinks.from_json(sinks.to_json(m, s))[0] == s[0]).all()
    assert sinks.score(spark.createDataFrame([(9, [1.0, 1.0, 1.0])], "k int, x array<double>"), sinks.load(spark, str(tmp_path / "m")), m, ["k"], "x").first().prediction != 0


# ---- evaluation


def test_pipeline_predicts_with_frozen_states():
    x, y = data(80)
    pipe = evaluate.Pipeline((evaluate.Scale(),), learners.RLS(3))
    _, s = run(pipe, x, y)
    before = [np.copy(s[0][0][1]), s[0][0][0]]
    n, mean, m2 = s[0][0]
    p = pipe.predict(s, x[5])
    assert p == pytest.approx(float(s[1][0] @ ((x[5] - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-12))))
    assert (s[0][0][1] == before[0]).all() and s[0][0][0] == before[1] == 80


def test_held_out_rows_are_not_learned():
    x, y = data(90)
    p, s = run(evaluate.HeldOut(learners.RLS(3), period=3), x, y)
    keep = [i for i in range(90) if (i + 1) % 3]
    _, want = run(learners.RLS(3), x[keep], y[keep])
    assert (s[2][0] == want[0]).all() and np.isfinite(p).all()


def test_members_equal_single_runs(spark):
    x, y = data(60)
    df = spark.createDataFrame([(0, i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, t int, x array<double>, y double")
    members = [learners.RLS(3), learners.Linear(3, 0.1)]
    got = evaluate.run_members(df, members, ["k"], ["t"], "x", "y").toPandas()
    for i, m in enumerate(members):
        np.testing.assert_allclose(got[got.member == i].sort_values("t").prediction, run(m, x, y)[0])
    scored = evaluate.prequential(df, members[0], ["k"], ["t"], "x", "y", warmup=10, every=4).collect()
    assert sorted(r.t for r in scored) == [t for t in range(60) if t + 1 > 10 and (t + 1) % 4 == 0]
    assert isinstance(got, pd.DataFrame) and fold.run_batch(df, members[0], ["k"], ["t"], "x", "y").count() == 60


def test_continual_restarts_at_a_drift():
    x, y = data(1200)
    y[600:] += 30
    _, s = run(evaluate.Continual(learners.Linear(3, 0.01), learners.ADWIN()), x, y)
    assert s["drifts"] >= 1


def test_tuner_configurations():
    t = evaluate.AutoTuner(catalog._tuned, {"a": (1, 8), "b": (0.001, 1.0, "log"), "c": ["x", "y"]}, 8)
    rng = np.random.default_rng(0)
    some = t.latin(rng, 8)
    assert sorted(int((math.log10(c["b"]) + 3) // 0.375) for c in some) == list(range(8)) and all(1 <= c["a"] <= 8 and c["c"] in "xy" for c in some)
    near = t.perturb(rng, some[0])
    assert isinstance(near["a"], int) and 0.001 <= near["b"] <= 1.0
