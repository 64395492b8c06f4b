"""Models whose statistics are sums: naive Bayes, cluster features, bandits. All merge, so Spark combines them before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian_moments(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Count, prior, and mean and population variance of each x by class."""
    cols = [c for i, x in enumerate(xs) for c in (F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}"))]
    m = rows.groupBy(y).agg(F.count("*").alias("n"), *cols)
    return m.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def gaussian_predict(moments: DataFrame, y: str, xs: list[str], smoothing: float = 1e-9) -> Column:
    """The class of the greatest log posterior, as an expression over xs; classes are few and their moments become constants. Variances are raised by `smoothing` times the greatest one. Ties: the first class."""
    classes = moments.orderBy(y).collect()
    smoothing *= max((r[f"var{i}"] for r in classes for i in range(len(xs))), default=0.0) or 1.0
    best = score = None
    for r in classes:
        s = F.lit(math.log(r["prior"]))
        for i, x in enumerate(xs):
            v = r[f"var{i}"] + smoothing
            s = s - 0.5 * (math.log(2 * math.pi * v) + F.pow(F.col(x) - r[f"mean{i}"], 2) / v)
        s = F.round(s, 9)
        best, score = (F.lit(r[y]), s) if best is None else (F.when(s > score, r[y]).otherwise(best), F.greatest(s, score))
    return best


def multinomial(rows: DataFrame, y: str, feature: str, weight: str, alpha: float, size: int) -> DataFrame:
    """log (n_cf + alpha) / (n_c + alpha * size) by class and feature."""
    n = rows.groupBy(y, feature).agg(F.sum(weight).alias("n"))
    return n.select(y, feature, F.log((F.col("n") + alpha) / (F.sum("n").over(Window.partitionBy(y)) + alpha * size)).alias("log_p"))


def bernoulli(rows: DataFrame, y: str, thresholds: dict[str, float], alpha: float) -> DataFrame:
    cols = [F.log((F.sum((F.col(x) > t).cast("int")) + alpha) / (F.count("*") + 2 * alpha)).alias(f"log_p{i}") for i, (x, t) in enumerate(thresholds.items())]
    return rows.groupBy(y).agg(*cols)


def cluster_features(rows: DataFrame, key: str, x: str) -> DataFrame:
    """The additive summary of each group by coordinate: count, linear sum and sum of squares."""
    e = rows.select(key, F.posexplode(x).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return e.groupBy(key, "i").agg(F.count("*").alias("n"), F.sum("v").alias("ls"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def assign(x: Column, centers: list[list[float]]) -> Column:
    """The nearest center's number by squared distance; ties to the smaller number."""
    d = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centers]
    return F.array_min(F.array(*[F.struct(v.alias("d"), F.lit(i).alias("i")) for i, v in enumerate(d)]))["i"]


def ucb1(pulls: DataFrame) -> DataFrame:
    """(arm, n, bound) of pulls(arm, reward)."""
    a = pulls.groupBy("arm").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"))
    t = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return a.select("arm", "n", (F.col("mean") + F.sqrt(2 * F.log(t) / F.col("n"))).alias("bound"))


def thompson(pulls: DataFrame) -> DataFrame:
    """Beta posteriors of pulls(arm, reward 0 or 1), from a uniform prior."""
    return pulls.groupBy("arm").agg((1 + F.sum("reward")).cast("double").alias("alpha"), (1 + F.sum(1 - F.col("reward"))).cast("double").alias("beta"))


def ucb_tuned(pulls: DataFrame) -> DataFrame:
    """(arm, n, bound) of pulls(arm, reward), with the bound's width by the arm's variance, at most a quarter."""
    a = pulls.groupBy("arm").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.var_pop("reward").alias("var"))
    log = F.log(F.sum("n").over(Window.partitionBy(F.lit(1))))
    width = F.least(F.lit(0.25), F.col("var") + F.sqrt(2 * log / F.col("n")))
    return a.select("arm", "n", (F.col("mean") + F.sqrt(log / F.col("n") * width)).alias("bound"))


def epsilon_greedy(pulls: DataFrame, epsilon: float, decay: float = 1.0) -> DataFrame:
    """(arm, n, mean, share): the chance of each arm to be pulled next; the best mean (ties: the first arm) unless exploring, epsilon * decay^pulls."""
    a = pulls.groupBy("arm").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"))
    every = Window.partitionBy(F.lit(1))
    eps = epsilon * F.pow(F.lit(decay), F.sum("n").over(every))
    best = F.row_number().over(every.orderBy(F.col("mean").desc(), "arm")) == 1
    return a.select("arm", "n", "mean", (eps / F.count("*").over(every) + F.when(best, 1 - eps).otherwise(0.0)).alias("share"))


def discounted_thompson(pulls: DataFrame, order: list[str], discount: float) -> DataFrame:
    """Beta posteriors of pulls(arm, reward 0 to 1) that fade toward the uniform prior by `discount` at every pull of any arm.

    A pull's weight is discount^(pulls after it), so the fold is a weighted sum and needs no state.
    """
    after = F.row_number().over(Window.orderBy(*[F.col(c).desc() for c in order])) - 1
    w = F.pow(F.lit(discount), after)
    p = pulls.select("arm", "reward", w.alias("w"))
    return p.groupBy("arm").agg((1 + F.sum(F.col("w") * F.col("reward"))).alias("alpha"), (1 + F.sum(F.col("w") * (1 - F.col("reward")))).alias("beta"))


def posterior(rows: DataFrame, y: str, feature: str, weight: str, alpha: float, size: int, doc: str) -> DataFrame:
    """(doc, class, p) by multinomial naive Bayes, for every doc of rows(doc, feature, weight) that `y` labels; normalised by log-sum-exp."""
    logs = multinomial(rows, y, feature, weight, alpha, size)
    totals = rows.groupBy(y).agg(F.sum(weight).alias("_t"), F.countDistinct(doc).alias("_docs"))
    totals = totals.withColumn("_prior", F.log(F.col("_docs") / F.sum("_docs").over(Window.partitionBy(F.lit(1)))))
    # a feature that a class lacks has the class's floor
    floor = totals.select(y, "_prior", F.log(alpha / (F.col("_t") + alpha * size)).alias("_floor"))
    bag = rows.groupBy(doc, feature).agg(F.sum(weight).alias("_w"))
    base = bag.groupBy(doc).agg(F.sum("_w").alias("_w")).join(F.broadcast(floor)).select(doc, y, (F.col("_prior") + F.col("_w") * F.col("_floor")).alias("_base"))
    gain = bag.join(logs.join(F.broadcast(floor), y), feature).groupBy(doc, y).agg(F.sum(F.col("_w") * (F.col("log_p") - F.col("_floor"))).alias("_gain"))
    score = base.join(gain, [doc, y], "left").select(doc, y, (F.col("_base") + F.coalesce("_gain", F.lit(0.0))).alias("_s"))
    by = Window.partitionBy(doc)
    score = score.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(by)))
    return score.select(doc, y, (F.col("_e") / F.sum("_e").over(by)).alias("p"))
