"""Incremental metrics as aggregations: partial before the shuffle, mergeable, keyed or not.

Edge cases are fixed: R2 is 0 with fewer than two rows or without target variance, kappas are
0 where chance agreement is 1, precision, recall and F1 are 0 on an empty denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import running


def _safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def regression(y: Column, p: Column) -> dict[str, Column]:
    """MAE, MSE, RMSE and R2 as aggregates over rows of target y and prediction p."""
    e = y - p
    mse = F.avg(e * e)
    total = F.var_pop(y) * F.count(y)
    return {"n": F.count("*"), "mae": F.avg(F.abs(e)), "mse": mse, "rmse": F.sqrt(mse), "r2": F.when((F.count(y) > 1) & (total > 0), 1 - F.sum(e * e) / total).otherwise(0.0)}


def classification(y: Column, p: Column, proba: Column | None = None, clip: float = 1e-15) -> dict[str, Column]:
    """Accuracy, and precision, recall and F1 of class 1; log loss of proba if given."""
    tp, pp, ap = (F.sum(c.cast("int")).cast("double") for c in ((y == 1) & (p == 1), p == 1, y == 1))
    out = {"n": F.count("*"), "accuracy": F.avg((y == p).cast("double")), "precision": _safe(tp, pp), "recall": _safe(tp, ap), "f1": _safe(2 * tp, pp + ap)}
    if proba is not None:
        q = F.least(F.greatest(proba, F.lit(clip)), F.lit(1 - clip))
        out["log_loss"] = -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))
    return out


def kappa(rows: DataFrame, y: str, p: str, key: list[str]) -> DataFrame:
    """Cohen's kappa and kappa M (against the majority class) per key, from the confusion counts."""
    cells = rows.groupBy(*key, y, p).agg(F.count("*").alias("n"))
    t = cells.groupBy(*key, y).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)).alias("hit"))
    q = cells.groupBy(*key, p).agg(F.sum("n").alias("q")).withColumnRenamed(p, y)
    m = t.join(q, [*key, y], "full").fillna(0, ["t", "hit", "q"])
    m = m.groupBy(*key).agg(F.sum("t").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.max("t").alias("top"))
    po, pe, pm = F.col("hit") / F.col("n"), F.col("tq") / (F.col("n") * F.col("n")), F.col("top") / F.col("n")
    return m.select(*key, "n", _safe(po - pe, 1 - pe).alias("kappa"), _safe(po - pm, 1 - pm).alias("kappa_m"))


def kappa_t(rows: DataFrame, y: str, p: str, key: list[str], order: list[str]) -> DataFrame:
    """Kappa against the classifier that repeats the last target; its accuracy is over n - 1 rows, the model's over n."""
    last = F.lag(y).over(Window.partitionBy(*key).orderBy(*order))
    m = rows.withColumn("_last", last).groupBy(*key).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("po"), F.sum((F.col(y) == F.col("_last")).cast("double")).alias("same"))
    pt = _safe(F.coalesce("same", F.lit(0.0)), F.col("n") - 1)
    return m.select(*key, "n", _safe(F.col("po") - pt, 1 - pt).alias("kappa_t"))


def auc(rows: DataFrame, y: str, score: str, key: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums, ties one half; null with one class."""
    w = Window.partitionBy(*key).orderBy(score)
    ranks = rows.withColumn("_r", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*key, score)) - 1) / 2.0)
    pos, n = F.sum((F.col(y) == 1).cast("long")), F.count("*")
    u = F.sum(F.when(F.col(y) == 1, F.col("_r"))) - pos * (pos + 1) / 2.0
    return ranks.groupBy(*key).agg(F.when((pos > 0) & (pos < n), u / (pos * (n - pos))).alias("auc"))


def rolling_regression(rows: DataFrame, y: str, p: str, key: list[str], order: list[str], size: int) -> DataFrame:
    """MAE, MSE and R2 over the last `size` rows, at every row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - size, 0)
    m = regression(F.col(y), F.col(p))
    e = F.col(y) - F.col(p)
    n, total = F.count(F.col(y)).over(w), F.var_pop(y).over(w) * F.count(F.col(y)).over(w)
    r2 = F.when((n > 1) & (total > 0), 1 - F.sum(e * e).over(w) / total).otherwise(0.0)
    return rows.select(*key, *order, m["mae"].over(w).alias("mae"), m["mse"].over(w).alias("mse"), r2.alias("r2"))


def rolling_accuracy(rows: DataFrame, y: str, p: str, key: list[str], order: list[str], size: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - size, 0)
    return rows.select(*key, *order, F.avg((F.col(y) == F.col(p)).cast("double")).over(w).alias("accuracy"))


def rolling_classification(rows: DataFrame, y: str, p: str, key: list[str], order: list[str], size: int) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1, over the last `size` rows, at every row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - size, 0)
    t, q = F.col(y) == 1, F.col(p) == 1
    tp, pp, ap = (F.sum(c.cast("int")).over(w).cast("double") for c in (t & q, q, t))
    return rows.select(
        *key, *order, F.avg((F.col(y) == F.col(p)).cast("double")).over(w).alias("accuracy"),
        _safe(tp, pp).alias("precision"), _safe(tp, ap).alias("recall"), _safe(2 * tp, pp + ap).alias("f1"),
    )


def windowed_auc(rows: DataFrame, y: str, score: str, key: list[str], order: list[str], size: int) -> DataFrame:
    """Area under the ROC curve of each key's last `size` rows."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))
    return auc(rows.withColumn("_last", last).where(F.col("_last") <= size).drop("_last"), y, score, key)


def metric_set(y: Column, p: Column, yc: Column, pc: Column) -> dict[str, Column]:
    """Regression metrics of (y, p) and classification metrics of (yc, pc) in one pass."""
    return {**regression(y, p), **{k: v for k, v in classification(yc, pc).items() if k != "n"}}


def ewma_classification(rows: DataFrame, y: str, p: str, proba: str, key: list[str], order: list[str], span: int, clip: float = 1e-15) -> DataFrame:
    """Exponentially weighted accuracy and log loss after the last row."""
    q = F.least(F.greatest(F.col(proba), F.lit(clip)), F.lit(1 - clip))
    loss = -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))
    seq = running(rows.withColumns({"_a": (F.col(y) == F.col(p)).cast("double"), "_s": loss}), key, order, ["_a", "_s"])
    return seq.select(*key, _smooth("_a", span).alias("accuracy"), _smooth("_s", span).alias("log_loss"))


def ewma_r2(rows: DataFrame, y: str, p: str, key: list[str], order: list[str], span: int) -> DataFrame:
    """1 - smoothed squared error / smoothed squared distance from the smoothed mean of the rows before; 0 without variance."""
    a = 2.0 / (span + 1)
    mix = lambda old, new: f"if(s.n = 0, {new}, {a}D * {new} + {1 - a}D * {old})"
    step = (
        f"named_struct('n', s.n + 1, 'mse', {mix('s.mse', 'r._e')}, 'var', if(s.n = 0, 0D, {a}D * (r._y - s.mean) * (r._y - s.mean) + {1 - a}D * s.var),"
        f" 'mean', {mix('s.mean', 'r._y')})"
    )
    seq = running(rows.withColumns({"_e": F.pow(F.col(y) - F.col(p), 2), "_y": F.col(y).cast("double")}), key, order, ["_e", "_y"])
    s = F.expr(f"aggregate(rows, named_struct('n', 0L, 'mse', 0D, 'var', 0D, 'mean', 0D), (s, r) -> {step})")
    return seq.withColumn("_s", s).select(*key, F.expr("if(_s.var > 1e-15, 1 - _s.mse / _s.var, 0D)").alias("r2"))


def _smooth(field: str, span: int) -> Column:
    a = 2.0 / (span + 1)
    return F.aggregate(F.transform("rows", lambda r: r[field]), F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(a * x + (1 - a) * acc))


def ewma_error(rows: DataFrame, y: str, p: str, key: list[str], order: list[str], span: int) -> DataFrame:
    """Exponentially weighted MAE and MSE after the last row; alpha = 2 / (span + 1), the first row is the seed."""
    a = 2.0 / (span + 1)
    e = F.col(y) - F.col(p)
    fold = lambda c: F.aggregate(
        c, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(a * x + (1 - a) * acc)
    )
    seq = running(rows.withColumns({"_a": F.abs(e), "_s": e * e}), key, order, ["_a", "_s"])
    return seq.select(*key, fold(F.transform("rows", lambda r: r["_a"])).alias("mae"), fold(F.transform("rows", lambda r: r["_s"])).alias("mse"))


def importance(rows: DataFrame, feature: str, gain: str, top: int) -> DataFrame:
    """Gains added up by feature, as shares, the `top` largest; ties by name."""
    g = rows.groupBy(feature).agg(F.sum(gain).alias("gain"))
    total = g.agg(F.sum("gain").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(feature, F.when(F.col("total") > 0, F.col("gain") / F.col("total")).otherwise(0.0).alias("importance")).orderBy(F.col("importance").desc(), feature).limit(top)
