"""Losses as column expressions: gradient and hessian by prediction p and target y, and the first prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def erf(x: Column) -> Column:
    """The error function to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def mat_vec(rows: list[list[float]], x: Column) -> Column:
    """A fixed matrix times an array."""
    return F.array(*[dot(F.array(*map(F.lit, r)), x) for r in rows])


def softmax(x: Column, heat: float = 1.0) -> Column:
    """exp(x / heat) of an array as shares."""
    e = F.transform(x, lambda v: F.exp((v - F.array_max(x)) / heat))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def softmax_loss(y: Column, p: Column, label: int) -> tuple[Column, Column]:
    """One class's gradient and hessian against the rest."""
    s = sigmoid(p)
    return s - (y == label).cast("double"), F.greatest(s * (1 - s), F.lit(1e-16))


def squared(y: Column, p: Column) -> tuple[Column, Column]:
    return p - y, F.lit(1.0)


def logistic(y: Column, p: Column) -> tuple[Column, Column]:
    s = sigmoid(p)
    return s - y, F.greatest(s * (1 - s), F.lit(1e-16))


def huber(y: Column, p: Column, delta: float = 1.0) -> tuple[Column, Column]:
    r = p - y
    return F.greatest(F.lit(-delta), F.least(F.lit(delta), r)), F.when(F.abs(r) <= delta, 1.0).otherwise(1e-6)


def quantile(y: Column, p: Column, tau: float) -> tuple[Column, Column]:
    return F.when(p >= y, 1 - tau).otherwise(-tau), F.lit(1.0)


def expectile(y: Column, p: Column, tau: float) -> tuple[Column, Column]:
    w = F.when(p >= y, tau).otherwise(1 - tau)
    return 2 * w * (p - y), 2 * w


def first_prediction(loss: str, y: Column, tau: float = 0.5) -> Column:
    """The aggregate that a loss starts from: mean, log odds of the clamped mean, median, quantile, or 0."""
    m = F.least(F.greatest(F.avg(y), F.lit(1e-7)), F.lit(1 - 1e-7))
    return {"squared": F.avg(y), "expectile": F.avg(y), "logistic": F.log(m / (1 - m)), "huber": F.median(y), "quantile": F.percentile(y, F.lit(tau)), "softmax": F.lit(0.0)}[loss]


def schedule(kind: str, step: Column, rate: float, **k: float) -> Column:
    """Learning rates by step: constant, linear, exponential (floored at 1e-8) and cosine annealing."""
    if kind == "constant":
        return F.lit(rate)
    if kind == "linear":
        return rate + (k["end"] - rate) * F.least(step / k["steps"], F.lit(1.0))
    if kind == "exponential":
        return F.greatest(rate * F.pow(F.lit(k["decay"]), step), F.lit(1e-8))
    if kind == "cosine":
        return k["least"] + 0.5 * (rate - k["least"]) * (1 + F.cos(2 * 3.141592653589793 * step / k["steps"]))
    raise ValueError(kind)
