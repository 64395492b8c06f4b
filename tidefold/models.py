"""Models by name, for the command line and for configuration files, with their settings checked before a job starts."""

from __future__ import annotations

import dataclasses
import tomllib
from collections.abc import Callable

from .errors import ConfigError
from .operators import adaptive, boosting, forests, learners, neural
from .streaming import evaluate

#: name -> (maker by number of features and settings, "regression" or "classification")
MODELS: dict[str, tuple[Callable, str]] = {
    "sgbt": (lambda dim, **k: boosting.SGBT(dim, **k), "regression"),
    "sgbt_binary": (lambda dim, **k: boosting.SGBT(dim, **{"loss": "logistic", **k}), "classification"),
    "multiclass": (lambda dim, classes=3, **k: boosting.Multiclass(classes, boosting.SGBT(dim, **{"loss": "softmax", **k})), "classification"),
    "quantile": (lambda dim, taus=(0.1, 0.5, 0.9), **k: boosting.Quantiles(tuple(taus), boosting.SGBT(dim, **k)), "regression"),
    "distributional": (lambda dim, mode="empirical", **k: boosting.Distributional(boosting.SGBT(dim, **k), mode), "regression"),
    "bagged": (lambda dim, size=5, **k: adaptive.Bagged(size, boosting.SGBT(dim, **k)), "regression"),
    "moe": (lambda dim, experts=2, **k: boosting.MixtureOfExperts(experts, boosting.SGBT(dim, **k)), "regression"),
    "linear": (lambda dim, **k: learners.Linear(dim, **k), "regression"),
    "rls": (lambda dim, **k: learners.RLS(dim, **{"adaptive": True, **k}), "regression"),
    "polynomial": (lambda dim, **k: learners.Polynomial(dim, **k), "regression"),
    "krls": (lambda dim, **k: adaptive.KernelRLS(**k), "regression"),
    "local": (lambda dim, **k: forests.LocalRegression(**k), "regression"),
    "mondrian": (lambda dim, **k: forests.MondrianForest(dim, **k), "regression"),
    "hoeffding": (lambda dim, **k: forests.HoeffdingClassifier(dim, **k), "classification"),
    "adaptive_forest": (lambda dim, **k: forests.AdaptiveForest(dim, **k), "classification"),
    "esn": (lambda dim, **k: adaptive.EchoState(dim, **k), "regression"),
    "ngrc": (lambda dim, **k: neural.NextGenReservoir(dim, **k), "regression"),
    "mamba": (lambda dim, **k: neural.Mamba(dim, **k), "regression"),
    "attention": (lambda dim, **k: neural.Attention(dim, **k), "regression"),
    "spikenet": (lambda dim, **k: neural.SpikeNet(dim, **k), "regression"),
    "ttt": (lambda dim, **k: neural.TestTimeTraining(dim, **k), "regression"),
    "kan": (lambda dim, **k: neural.KAN(dim, **k), "regression"),
}


def build(name: str, dim: int, scaled: bool = False, **settings):
    """A learner of `dim` features; scaled puts a running normaliser before it."""
    if name not in MODELS:
        raise ConfigError(f"model is one of {', '.join(sorted(MODELS))}, not {name}")
    if dim < 1:
        raise ConfigError("a model needs a feature")
    try:
        model = MODELS[name][0](dim, **settings)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{name}: {e}") from e
    check(model)
    return evaluate.Pipeline((evaluate.Scale(),), model) if scaled else model


def check(model) -> None:
    """The ranges that every boosted model, and every rate, has to keep."""
    for part in (model, getattr(model, "model", None)):
        if isinstance(part, boosting.SGBT):
            for ok, what in (
                (part.steps >= 1, "steps is 1 or more"), (0 < part.rate <= 1, "rate lies above 0 and up to 1"), (part.depth >= 1, "depth is 1 or more"), (part.bins >= 2, "bins is 2 or more"),
                (part.reg >= 0 and part.gamma >= 0, "reg and gamma are not negative"), (part.grace >= 1, "grace is 1 or more"), (0 < part.delta < 1, "delta lies between 0 and 1"),
                (0 < part.subsample <= 1, "subsample lies above 0 and up to 1"), (part.variant[0] in ("standard", "skip", "repeat"), "variant is standard, skip or repeat"),
                (part.loss in ("squared", "logistic", "softmax", "huber", "quantile", "expectile"), "loss is squared, logistic, softmax, huber, quantile or expectile"),
            ):
                if not ok:
                    raise ConfigError(what)


def read_config(path: str) -> tuple[str, dict]:
    """(model, settings) of a TOML file with `model` and a table [settings]."""
    try:
        with open(path, "rb") as f:
            c = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return c.get("model", "sgbt"), dict(c.get("settings", {}))


def template(name: str = "sgbt") -> str:
    """A configuration file with the defaults of a model."""
    model = build(name, 1)
    lines = [f'model = "{name}"', "", "[settings]"]
    for f in dataclasses.fields(model):
        v = getattr(model, f.name)
        if f.name != "dim" and isinstance(v, bool | int | float | str):
            lines.append(f"{f.name} = {str(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else chr(34) + v + chr(34)}")
    return "\n".join(lines) + "\n"
