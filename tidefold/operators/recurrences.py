"""Small ordered recurrences, folded inside Spark by `aggregate` over a key's ordered rows: no Python at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordering import running


def _fold(rows: DataFrame, key: list[str], order: list[str], x: str, init: str, step: str, out: list[str]) -> DataFrame:
    """The state after the last row; init and step are SQL, with state s and value x."""
    seq = running(rows.where(F.col(x).isNotNull()).withColumn("_x", F.col(x).cast("double")), key, order, ["_x"])
    # let-binding: the step sees x alone, and the state's fields by name
    state = F.expr(f"aggregate(transform(rows, r -> r._x), {init}, (s, x) -> {step})")
    return seq.withColumn("_s", state).select(*key, *[F.col(f"_s.{c}").alias(c) for c in out])


def page_hinkley(rows: DataFrame, key: list[str], order: list[str], x: str, delta: float = 0.005, threshold: float = 50.0) -> DataFrame:
    """Two-sided Page-Hinkley: deviations from the running mean (this row included); on drift the sums restart, mean and count go on.

    warnings counts the rows beyond half the threshold that are no drift; state is the last row's signal: 0 stable, 1 warning, 2 drift.
    """
    m = "(s.mean + (x - s.mean) / (s.n + 1))"
    # term by term in the order of the SQL: sums of doubles in another order cross a threshold at other rows
    up, down = f"(s.up + x - {m} - {delta}D)", f"(s.down - {m} + {delta}D + x)"
    most = f"greatest({up} - least(s.low, {up}), greatest(s.high, {down}) - {down})"
    signal = f"if({most} > {threshold}D, 2, if({most} > {threshold / 2}D, 1, 0))"
    hit = f"{most} > {threshold}D"
    inf = "double('infinity')"
    step = (
        f"named_struct('n', s.n + 1, 'mean', {m}, 'up', if({hit}, 0D, {up}), 'low', if({hit}, {inf}, least(s.low, {up})),"
        f" 'down', if({hit}, 0D, {down}), 'high', if({hit}, -{inf}, greatest(s.high, {down})), 'drifts', s.drifts + if({hit}, 1L, 0L),"
        f" 'warnings', s.warnings + if({signal} = 1, 1L, 0L), 'state', {signal})"
    )
    init = f"named_struct('n', 0L, 'mean', 0D, 'up', 0D, 'low', {inf}, 'down', 0D, 'high', -{inf}, 'drifts', 0L, 'warnings', 0L, 'state', 0)"
    return _fold(rows, key, order, x, init, step, ["n", "mean", "drifts", "warnings", "state"])


def ewma(rows: DataFrame, key: list[str], order: list[str], x: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean, seeded by the first row."""
    return _fold(rows, key, order, x, "named_struct('n', 0L, 'ewma', 0D)", f"named_struct('n', s.n + 1, 'ewma', if(s.n = 0, x, {alpha}D * x + {1 - alpha}D * s.ewma))", ["n", "ewma"])


def quantile_track(rows: DataFrame, key: list[str], order: list[str], x: str, tau: float, rate: float) -> DataFrame:
    """A quantile followed from 0 by steps of rate * tau up where x lies above it, and rate * (1 - tau) down elsewhere."""
    return _fold(rows, key, order, x, "named_struct('n', 0L, 'q', 0D)", f"named_struct('n', s.n + 1, 'q', if(x > s.q, s.q + {rate * tau}D, s.q - {rate * (1 - tau)}D))", ["n", "q"])


def adaptive_conformal(rows: DataFrame, key: list[str], order: list[str], missed: str, alpha: float = 0.1, gamma: float = 0.01, beta: float = 0.0) -> DataFrame:
    """The level that follows misses (1 or 0): a += gamma / n^beta * (alpha - missed), within 0.001 and 0.999; the share of rows covered, and the quantiles a/2 and 1 - a/2."""
    step = f"least(0.999D, greatest(0.001D, s.level + {gamma}D / pow(s.n + 1, {beta}D) * ({alpha}D - x)))"
    out = _fold(rows, key, order, missed, f"named_struct('n', 0L, 'level', {alpha}D, 'missed', 0D)", f"named_struct('n', s.n + 1, 'level', {step}, 'missed', s.missed + x)", ["n", "level", "missed"])
    return out.select(*key, "n", "level", (1 - F.col("missed") / F.col("n")).alias("coverage"), (F.col("level") / 2).alias("lower"), (1 - F.col("level") / 2).alias("upper"))


def strongly_adaptive(rows: DataFrame, key: list[str], order: list[str], x: str, alpha: float = 0.1, experts: int = 10) -> DataFrame:
    """A threshold for scores x that all but a share alpha should stay under: expert i steps by 2^-i, bets on it, and is weighed by its wealth."""
    err = "(if(x > e, 1D, 0D))"
    est = f"transform(s.est, (e, i) -> greatest(0D, e + pow(0.5D, i) * ({alpha}D - {err})))"
    wealth = f"transform(s.wealth, (w, i) -> greatest(1e-10D, w * (1D + least(0.4D, greatest(-0.4D, pow(0.5D, i) * ({alpha}D - if(x > s.est[i], 1D, 0D)))))))"
    total = "aggregate(t.wealth, 0D, (a, w) -> a + w)"
    mean = f"aggregate(zip_with(t.wealth, t.est, (w, e) -> w * e), 0D, (a, v) -> a + v) / {total}"
    # the new experts are bound once (a let by an array of one), then the threshold is theirs
    step = f"""transform(transform(array(named_struct('est', {est}, 'wealth', {wealth})), t -> named_struct('est', t.est, 'wealth', t.wealth, 'at', {mean})),
        t -> named_struct('n', s.n + 1, 'est', t.est, 'wealth', t.wealth, 'threshold', t.at, 'covered', s.covered + if(x <= t.at, 1L, 0L)))[0]"""
    init = f"named_struct('n', 0L, 'est', array_repeat({alpha}D, {experts}), 'wealth', array_repeat(1D, {experts}), 'threshold', {alpha}D, 'covered', 0L)"
    return _fold(rows, key, order, x, init, step, ["n", "threshold", "covered"])


def decompose(rows: DataFrame, key: list[str], order: list[str], x: str, period: int, alpha: float = 0.1, gamma: float = 0.1) -> DataFrame:
    """Trend by exponential smoothing of the value, seasonal slots by smoothing of the detrended one, and the last residual."""
    slot = f"(cast(s.n % {period} as int))"
    trend = f"if(s.n = 0, x, {alpha}D * x + {1 - alpha}D * s.trend)"
    season = f"transform(s.season, (v, i) -> if(i = {slot}, {gamma}D * (x - ({trend})) + {1 - gamma}D * v, v))"
    step = f"named_struct('n', s.n + 1, 'trend', {trend}, 'season', {season}, 'residual', x - ({trend}) - ({season})[{slot}])"
    return _fold(rows, key, order, x, f"named_struct('n', 0L, 'trend', 0D, 'season', array_repeat(0D, {period}), 'residual', 0D)", step, ["n", "trend", "residual"])


def conformal_pid(rows: DataFrame, key: list[str], order: list[str], missed: str, alpha: float = 0.1, ki: float = 0.05, kp: float = 0.1, kd: float = 0.01) -> DataFrame:
    """The radius that follows misses (1 or 0) by their running error, level and change: a += ki e + kp s + kd (s - s'), within 0.001 and 10.

    e is alpha less the miss, s the sum of e so far.
    """
    e = f"({alpha}D - x)"
    step = f"named_struct('n', s.n + 1, 'sum', s.sum + {e}, 'level', least(10D, greatest(0.001D, s.level + {ki}D * {e} + {kp}D * (s.sum + {e}) + {kd}D * {e})))"
    return _fold(rows, key, order, missed, f"named_struct('n', 0L, 'sum', 0D, 'level', {alpha}D)", step, ["n", "level"])


def reward(rows: DataFrame, key: list[str], order: list[str], x: str, alpha: float = 0.1) -> DataFrame:
    """Rewards in [0, 1] from a metric that should be low: 1 - x / its exponential mean, 0.5 for the first; the last one and their sum."""
    mean = f"if(s.n = 0, x, {alpha}D * x + {1 - alpha}D * s.mean)"
    now = f"if(s.n = 0, 0.5D, if(abs({mean}) < 1e-15D, 0.5D, least(1D, greatest(0D, 1D - x / ({mean})))))"
    step = f"named_struct('n', s.n + 1, 'mean', {mean}, 'reward', {now}, 'total', s.total + {now})"
    return _fold(rows, key, order, x, "named_struct('n', 0L, 'mean', 0D, 'reward', 0D, 'total', 0D)", step, ["n", "reward", "total"])


def holt_winters(rows: DataFrame, key: list[str], order: list[str], x: str, period: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> DataFrame:
    """Level, trend and one-step forecast after the last row of additive triple smoothing (see `learners.HoltWinters`), in the JVM.

    Keys of fewer rows than a period have no forecast.
    """
    seq = running(rows.where(F.col(x).isNotNull()).withColumn("_x", F.col(x).cast("double")), key, order, ["_x"])
    i = f"cast(s.t % {period} as int)"
    level = f"({alpha}D * (v - s.season[{i}]) + {1 - alpha}D * (s.level + s.trend))"
    step = (
        f"named_struct('t', s.t + 1, 'level', {level}, 'trend', {beta}D * ({level} - s.level) + {1 - beta}D * s.trend,"
        f" 'season', transform(s.season, (u, j) -> if(j = {i}, {gamma}D * (v - {level}) + {1 - gamma}D * u, u)))"
    )
    mean = f"(aggregate(slice(v, 1, {period}), 0D, (a, b) -> a + b) / {period})"
    start = f"named_struct('t', 0L, 'level', {mean}, 'trend', 0D, 'season', transform(slice(v, 1, {period}), u -> u - {mean}))"
    # the first period starts level and seasons, and is then replayed
    state = f"if(size(v) < {period}, null, aggregate(v, {start}, (s, v) -> {step}))"
    out = seq.withColumn("v", F.expr("transform(rows, r -> r._x)")).withColumn("_s", F.expr(state))
    return out.select(*key, F.size("v").alias("n"), F.col("_s.level").alias("level"), F.col("_s.trend").alias("trend"), F.expr(f"_s.level + _s.trend + _s.season[cast(_s.t % {period} as int)]").alias("forecast"))
