"""The further learners on small streams with known outcomes."""

import numpy as np

from tidefold.operators import adaptive, learners


def run(model, xs, ys):
    s, out = model.new(), []
    for x, y in zip(xs, ys, strict=True):
        p, s = model.step(s, np.atleast_1d(np.asarray(x, float)), float(y))
        out.append(p)
    return np.array(out), s


def test_kernel_rls_learns_a_sine_within_its_budget():
    x = np.random.default_rng(0).uniform(-3, 3, 400)
    p, s = run(adaptive.KernelRLS(budget=30), x, np.sin(x))
    assert np.abs(p[300:] - np.sin(x[300:])).mean() < 0.05 and len(s[0]) <= 30


def test_kernel_rls_equals_the_batch_solution_when_every_row_enters():
    x, y = np.arange(5.0), np.array([1.0, -2, 0.5, 3, 1])
    _, (rows, _, _, w) = run(adaptive.KernelRLS(novelty=1e-9), x, y)
    gram = np.exp(-((rows - rows.T) ** 2))
    assert np.allclose(w, np.linalg.solve(gram, y))


def test_echo_state_and_snarimax_follow_a_wave():
    t = np.arange(600)
    wave = np.sin(t * 0.2)
    for model in (adaptive.EchoState(dim=1), adaptive.Snarimax(p=3, q=0, rate=0.1)):
        p, _ = run(model, wave[:-1], wave[1:])
        assert np.abs(p[500:] - wave[501:]).mean() < 0.2


def test_half_space_trees_score_the_far_row_higher():
    rng = np.random.default_rng(1)
    rows = [*rng.uniform(0.4, 0.45, (200, 2)), np.array([0.41, 0.42]), np.array([0.95, 0.05])]
    p, _ = run(adaptive.HalfSpaceTrees(dim=2), rows, [0] * len(rows))
    # the root holds the whole window, so that no score reaches 1
    assert p[-1] > p[-2] + 0.1 and p[-2] < 0.9 and ((p >= 0) & (p <= 1)).all()


def test_dbstream_keeps_two_clumps_apart():
    rng = np.random.default_rng(2)
    which = rng.integers(0, 2, 300)
    p, _ = run(adaptive.DBStream(radius=1.0), which * 10 + rng.normal(0, 0.1, 300), which)
    assert len(set(p)) == 2 and len(set(zip(p, which, strict=True))) == 2


def test_platt_moves_toward_the_rate_of_ones():
    p, _ = run(adaptive.Platt(), np.zeros(2000), np.random.default_rng(3).random(2000) < 0.8)
    assert abs(p[-500:].mean() - 0.8) < 0.05


def test_temperature_cools_scores_that_are_too_sure():
    rng = np.random.default_rng(5)
    z = rng.normal(0, 2, 5000)
    p, heat = run(adaptive.Temperature(), 3 * z, rng.random(5000) < 1 / (1 + np.exp(-z)))
    assert 2 < heat < 4.5 and ((p >= 0) & (p <= 1)).all()


def test_bagged_is_repeatable_and_learns():
    x = np.random.default_rng(4).normal(size=(300, 2))
    model = adaptive.Bagged(5, learners.RLS(dim=2))
    p, _ = run(model, x, x @ [2.0, -1])
    assert np.abs(p[200:] - x[200:] @ [2.0, -1]).max() < 0.05 and (p == run(model, x, x @ [2.0, -1])[0]).all()
