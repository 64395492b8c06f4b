"""The registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import losses
from ..operators import adaptive, boosting, forests, learners, metrics, models, neural
from ..operators import preprocess as prep
from ..operators import recurrences as rec
from ..sinks import models as sinks
from ..streaming import evaluate, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "prequential_last_value",
    """
    with p as (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) as pred from events)
    select user_id, count(*) as n, round(avg(abs(value - pred)), 6) as mae, round(avg((value - pred) * (value - pred)), 6) as mse
    from p where pred is not null group by user_id
    """,
)
def prequential_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-then-train error of the predictor that repeats a user's last value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").select("user_id", "value", F.lag("value").over(w).alias("pred")).where("pred is not null")
    err = F.col("value") - F.col("pred")
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(err)), 6).alias("mae"), F.round(F.avg(err * err), 6).alias("mse"))


# ---- metrics: predictions are a user's last value; classes are value modulo 2 or 3

_P = """p as (select *, lag(value) over (partition by user_id order by ts, event_id) as pred from events),
q as (select user_id, ts, event_id, value as y, pred as p, floor(value)::bigint % 2 as yb, floor(pred)::bigint % 2 as pb,
  floor(value)::bigint % 3 as yc, floor(pred)::bigint % 3 as pc, 1 / (1 + exp(-(pred - 50) / 25)) as s from p where pred is not null)"""


def folded(source: str, state: dict[str, tuple[str, str]], out: str, lets: tuple[dict[str, str], ...] = ()) -> str:
    """SQL of an ordered fold per user by a recursive CTE: source gives (user_id, i from 1, ...), state maps a name to its first value and next value.

    The next values see the state before the row, the row, and the lets (each of which sees the ones before it).
    """
    row = "select s.* exclude (i), b.* exclude (user_id) from s join base b on b.user_id = s.user_id and b.i = s.i + 1"
    for names in lets:
        row = f"select *, {', '.join(f'{v} as {k}' for k, v in names.items())} from ({row})"
    first = ", ".join(f"{v[0]} as {k}" for k, v in state.items())
    step = ", ".join(f"{v[1]} as {k}" for k, v in state.items())
    return f"""with recursive base as ({source}), s as (select user_id, 0::bigint as i, {first} from (select distinct user_id from base)
 union all select user_id, i, {step} from ({row})), last as (select * from s where (user_id, i) in (select user_id, max(i) from base group by 1)) {out}"""


_I = "row_number() over (partition by user_id order by ts, event_id)"
_VALUES = f"select user_id, {_I} as i, value as x from events where value is not null"
#: Rows of the metrics' predictions, numbered.
_SCORED = f"with {_P} select user_id, {_I} as i, event_id, y, p, yb, pb, yc, pc, s as proba from q"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("y"), F.lag("value").over(w).alias("p")).where("p is not null")
    code = lambda c, k: F.floor(c) % k
    return p.withColumns({"yb": code("y", 2), "pb": code("p", 2), "yc": code("y", 3), "pc": code("p", 3), "s": 1 / (1 + F.exp(-(F.col("p") - 50) / 25))})


def rounded(df: DataFrame, digits: int = 6, tie: float = 0.0) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order; tie moves halves to one side; a negative zero becomes zero.

    Rounded is the product with the power of ten, as the SQL's engine does it; Spark's own round takes the shortest decimal, and puts a double just below a half elsewhere.
    """
    power = F.lit(10.0**digits)

    def near(x):
        y = F.round(x * power) / power
        return F.when(F.abs(y) < float("inf"), y).otherwise(x) + F.lit(0.0)

    return df.select([near(F.col(c) + tie).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _by(rows: DataFrame, cols: dict, *key: str) -> DataFrame:
    return rounded(rows.groupBy(*key).agg(*[v.alias(k) for k, v in cols.items()]))


@query("regression_metrics", f"""with {_P}, a as (select user_id, count(*) as n, avg(abs(y - p)) as mae, avg((y - p) * (y - p)) as mse, sum((y - p) * (y - p)) as sse,
 var_pop(y) * count(*) as tot from q group by user_id)
select user_id, n, round(mae, 6) as mae, round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(case when n > 1 and tot > 0 then 1 - sse / tot else 0 end, 6) as r2 from a""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(scored(spark, sf_dir), metrics.regression(F.col("y"), F.col("p")), "user_id")


@query("classification_metrics", f"""with {_P}, a as (select user_id, count(*) as n, avg((yb = pb)::int::double) as accuracy, sum((yb = 1 and pb = 1)::int)::double as tp,
 sum((pb = 1)::int)::double as pp, sum((yb = 1)::int)::double as ap, -avg(case when yb = 1 then ln(least(greatest(s, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)) end) as ll
 from q group by user_id)
select user_id, n, round(accuracy, 6) as accuracy, round(case when pp <> 0 then tp / pp else 0 end, 6) as "precision", round(case when ap <> 0 then tp / ap else 0 end, 6) as recall,
 round(case when pp + ap <> 0 then 2 * tp / (pp + ap) else 0 end, 6) as f1, round(ll, 6) as log_loss from a""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(scored(spark, sf_dir), metrics.classification(F.col("yb"), F.col("pb"), F.col("s")), "user_id")


@query("cohen_kappa", f"""with {_P}, n as (select user_id, count(*) as n, sum((yc = pc)::int) as hit from q group by user_id),
t as (select user_id, yc as c, count(*) as t from q group by all), r as (select user_id, pc as c, count(*) as r from q group by all),
e as (select t.user_id, sum(t * r) as tq from t join r on t.user_id = r.user_id and t.c = r.c group by 1), m as (select user_id, max(t) as top from t group by 1),
a as (select n.user_id, n, hit / n as po, coalesce(tq, 0) / (n * n) as pe, top / n as pm from n left join e on n.user_id = e.user_id join m on n.user_id = m.user_id)
select user_id, n, round(case when 1 - pe <> 0 then (po - pe) / (1 - pe) else 0 end, 6) as kappa, round(case when 1 - pm <> 0 then (po - pm) / (1 - pm) else 0 end, 6) as kappa_m from a""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kappa(scored(spark, sf_dir), "yc", "pc", ["user_id"]))


@query("kappa_t", f"""with {_P}, l as (select *, lag(yc) over (partition by user_id order by ts, event_id) as last from q),
a as (select user_id, count(*) as n, avg((yc = pc)::int::double) as po, coalesce(sum((yc = last)::int), 0)::double as same from l group by 1),
b as (select *, case when n > 1 then same / (n - 1) else 0 end as pt from a)
select user_id, n, round(case when 1 - pt <> 0 then (po - pt) / (1 - pt) else 0 end, 6) as kappa_t from b""")
def kappa_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kappa_t(scored(spark, sf_dir), "yc", "pc", ["user_id"], ["ts", "event_id"]))


@query("auc", f"""with {_P}, r as (select *, rank() over (partition by user_id order by s) + (count(*) over (partition by user_id, s) - 1) / 2.0 as r from q),
a as (select user_id, sum((yb = 1)::int) as pos, count(*) as n, sum(case when yb = 1 then r end) as rs from r group by 1)
select user_id, round(case when pos > 0 and pos < n then (rs - pos * (pos + 1) / 2.0) / (pos * (n - pos)) end, 6) as auc from a""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(scored(spark, sf_dir), "yb", "s", ["user_id"]))


_W50 = "over (partition by user_id order by ts, event_id rows between 49 preceding and current row)"


@query("rolling_regression", f"""with {_P}, a as (select user_id, ts, event_id, avg(abs(y - p)) {_W50} as mae, avg((y - p) * (y - p)) {_W50} as mse,
 sum((y - p) * (y - p)) {_W50} as sse, var_pop(y) {_W50} * count(y) {_W50} as tot, count(y) {_W50} as n from q)
select user_id, ts, event_id, round(mae + 1e-7, 4) as mae, round(mse + 1e-7, 4) as mse, round(case when n > 1 and tot > 0 then 1 - sse / tot else 0 end + 1e-7, 4) as r2 from a""")
def rolling_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rolling_regression(scored(spark, sf_dir), "y", "p", ["user_id"], ["ts", "event_id"], 50), 4, 1e-7)


@query("rolling_accuracy", f"with {_P} select user_id, ts, event_id, round(avg((yc = pc)::int::double) {_W50}, 6) as accuracy from q")
def rolling_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rolling_accuracy(scored(spark, sf_dir), "yc", "pc", ["user_id"], ["ts", "event_id"], 50))


@query("rolling_classification", f"""with {_P}, a as (select user_id, ts, event_id, avg((yb = pb)::int::double) {_W50} as accuracy, sum((yb = 1 and pb = 1)::int)::double {_W50} as tp,
 sum((pb = 1)::int)::double {_W50} as pp, sum((yb = 1)::int)::double {_W50} as ap from q)
select user_id, ts, event_id, round(accuracy, 6) as accuracy, round(case when pp <> 0 then tp / pp else 0 end, 6) as "precision", round(case when ap <> 0 then tp / ap else 0 end, 6) as recall,
 round(case when pp + ap <> 0 then 2 * tp / (pp + ap) else 0 end, 6) as f1 from a""".replace(f"::double {_W50} as", f" {_W50} as"))
def rolling_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rolling_classification(scored(spark, sf_dir), "yb", "pb", ["user_id"], ["ts", "event_id"], 50))


@query("windowed_auc", f"""with {_P}, w as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as back from q) where back <= 40),
r as (select *, rank() over (partition by user_id order by s) + (count(*) over (partition by user_id, s) - 1) / 2.0 as r from w),
a as (select user_id, sum((yb = 1)::int) as pos, count(*) as n, sum(case when yb = 1 then r end) as rs from r group by 1)
select user_id, round(case when pos > 0 and pos < n then (rs - pos * (pos + 1) / 2.0) / (pos * (n - pos)) end, 6) as auc from a""")
def windowed_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.windowed_auc(scored(spark, sf_dir), "yb", "s", ["user_id"], ["ts", "event_id"], 40))


@query("metric_set", f"""with {_P}, a as (select user_id, count(*) as n, avg(abs(y - p)) as mae, avg((y - p) * (y - p)) as mse, sum((y - p) * (y - p)) as sse, var_pop(y) * count(*) as tot,
 avg((yb = pb)::int::double) as accuracy, sum((yb = 1 and pb = 1)::int)::double as tp, sum((pb = 1)::int)::double as pp, sum((yb = 1)::int)::double as ap from q group by user_id)
select user_id, n, round(mae, 6) as mae, round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(case when n > 1 and tot > 0 then 1 - sse / tot else 0 end, 6) as r2, round(accuracy, 6) as accuracy,
 round(case when pp <> 0 then tp / pp else 0 end, 6) as "precision", round(case when ap <> 0 then tp / ap else 0 end, 6) as recall, round(case when pp + ap <> 0 then 2 * tp / (pp + ap) else 0 end, 6) as f1 from a""")
def metric_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(scored(spark, sf_dir), metrics.metric_set(F.col("y"), F.col("p"), F.col("yb"), F.col("pb")), "user_id")


@query("ewma_classification", f"""with {_P}, l as (select user_id, list((yb = pb)::int::double order by ts, event_id) as a, list(-case when yb = 1 then ln(least(greatest(s, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)) end order by ts, event_id) as e from q group by 1)
select user_id, round(list_reduce(a, lambda a, x : (2.0 / 21)::double * x + (1 - (2.0 / 21)::double) * a), 6) as accuracy,
 round(list_reduce(e, lambda a, x : (2.0 / 21)::double * x + (1 - (2.0 / 21)::double) * a), 6) as log_loss from l""")
def ewma_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ewma_classification(scored(spark, sf_dir), "yb", "pb", "s", ["user_id"], ["ts", "event_id"], 20))


@query("ewma_r2", folded(_SCORED, {
    "n": ("0::bigint", "n + 1"), "mse": ("0::double", "case when n = 0 then e else k * e + (1 - k) * mse end"), "var": ("0::double", "case when n = 0 then 0 else k * (y - mean) * (y - mean) + (1 - k) * var end"),
    "mean": ("0::double", "case when n = 0 then y else k * y + (1 - k) * mean end"),
}, "select user_id, round(case when var > 1e-15 then 1 - mse / var else 0 end, 6) as r2 from last", ({"e": "(y - p) * (y - p)", "k": "(2.0 / 21)::double"},)))
def ewma_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ewma_r2(scored(spark, sf_dir), "y", "p", ["user_id"], ["ts", "event_id"], 20))


@query("ewma_error", f"""with {_P}, l as (select user_id, list(abs(y - p) order by ts, event_id) as e from q group by 1)
select user_id, round(list_reduce(e, lambda a, x : (2.0 / 21)::double * x + (1 - (2.0 / 21)::double) * a), 6) as mae,
 round(list_reduce(list_transform(e, lambda x : x * x), lambda a, x : (2.0 / 21)::double * x + (1 - (2.0 / 21)::double) * a), 6) as mse from l""")
def ewma_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ewma_error(scored(spark, sf_dir), "y", "p", ["user_id"], ["ts", "event_id"], 20))


@query("feature_importance", """with g as (select event_type, sum(value) as gain from events group by 1)
select event_type, round(gain / (select sum(gain) from g), 6) as importance from g order by gain desc, event_type limit 3""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.importance(table(spark, sf_dir, "events"), "event_type", "value", 3))


# ---- preprocessors over events, keyed by user

_U = "(partition by user_id order by ts, event_id rows between unbounded preceding and current row)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


@query("normalizer", f"select event_id, round((value - avg(value) over {_U}) / sqrt(var_pop(value) over {_U} + 1e-12), 4) as z from events")
def normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir).select("event_id", prep.normalize("value", ["user_id"], ["ts", "event_id"]).alias("z")), 4)


@query("min_max", f"""with a as (select event_id, value, min(value) over {_U} as lo, max(value) over {_U} as hi from events)
select event_id, round(case when hi - lo < 1e-12 then 0.5 else (value - lo) / (hi - lo) end, 6) as scaled from a""")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir).select("event_id", prep.min_max("value", ["user_id"], ["ts", "event_id"]).alias("scaled")))


@query("target_encoder", """select event_id, round((sum(value) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding)
 + 10.0::double * avg(value) over (partition by user_id order by ts, event_id rows unbounded preceding))
 / (count(value) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) + 10.0::double) + 1e-8, 6) as encoded from events""")
def target_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir).select("event_id", prep.target_encode("event_type", "value", ["user_id"], ["ts", "event_id"], 10.0).alias("encoded")), 6, 1e-8)


@query("one_hot", "select event_id, " + ", ".join(f"(event_type = '{c}')::int::double as x{i}" for i, c in enumerate(["click", "error", "purchase", "signup", "view"])) + " from events")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    seen = prep.discover(rows, "event_type")
    return rows.withColumn("x", prep.one_hot(F.col("event_type"), seen)).select("event_id", *[F.col("x")[i].alias(f"x{i}") for i in range(len(seen))])


_LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("polynomial", f"""select {_LI}, round(l_quantity * l_quantity, 6) as f2, round(l_quantity * l_discount, 6) as f3, round(l_discount * l_discount, 6) as f4,
 round(l_quantity * l_quantity * l_discount, 6) as m from lineitem""")
def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = [F.col("l_quantity"), F.col("l_discount")]
    p, m = prep.polynomial(xs), prep.monomials(xs, 3)
    return rounded(table(spark, sf_dir, "lineitem").select(*_LI.split(", "), p[2].alias("f2"), p[3].alias("f3"), p[4].alias("f4"), m[1].alias("m")))


@query("lag_features", "select event_id, " + ", ".join(f"lag(value, {k}) over (partition by user_id order by ts, event_id) as lag{k}" for k in (1, 2, 3)) + " from events")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", *[c.alias(f"lag{k + 1}") for k, c in enumerate(prep.lags("value", 3, ["user_id"], ["ts", "event_id"]))])


@query("label_encode", """with f as (select event_type, min(event_id) as first from events group by 1), c as (select event_type, row_number() over (order by first)::int - 1 as code from f)
select event_id, code::int as code from events join c using (event_type)""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.label_encode(_events(spark, sf_dir), "event_type", ["event_id"]).select("event_id", F.col("event_type_code").cast("int").alias("code"))


@query("feature_hasher")
def feature_hasher(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return table(spark, sf_dir, "lineitem").select(*_LI.split(", "), prep.hash_features(xs, 8).alias("hashed"))


# ---- losses

@query("losses", """with a as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount as y, l_tax as p, 1 / (1 + exp(-l_tax)) as s from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(p - y, 6) as squared_g, round(s - y, 6) as logistic_g, round(s * (1 - s), 6) as logistic_h,
 round(greatest(-0.02::double, least(0.02::double, p - y)), 6) as huber_g, case when p >= y then 0.1::double else -0.9::double end as quantile_g,
 round(2 * (case when p >= y then 0.9::double else 1 - 0.9::double end) * (p - y), 6) as expectile_g from a""")
def all_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("l_discount"), F.col("l_tax")
    cols = {
        "squared_g": losses.squared(y, p)[0], "logistic_g": losses.logistic(y, p)[0], "logistic_h": losses.logistic(y, p)[1],
        "huber_g": losses.huber(y, p, 0.02)[0], "quantile_g": losses.quantile(y, p, 0.9)[0], "expectile_g": losses.expectile(y, p, 0.9)[0],
    }
    return rounded(table(spark, sf_dir, "lineitem").select(*_LI.split(", "), *[c.alias(k) for k, c in cols.items()]))


@query("first_predictions", """select round(avg(l_tax), 6) as squared, round(ln(avg(l_tax) / (1 - avg(l_tax))), 6) as logistic, round(median(l_tax), 6) as huber, round(quantile_cont(l_tax, 0.9), 6) as quantile from lineitem""")
def first_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = {k: losses.first_prediction(k, F.col("l_tax"), 0.9) for k in ("squared", "logistic", "huber", "quantile")}
    return rounded(table(spark, sf_dir, "lineitem").agg(*[c.alias(k) for k, c in first.items()]))


# ---- recurrences, naive Bayes, clustering, bandits

_E = "with l as (select user_id, list(value order by ts, event_id) as v from events where value is not null group by 1)"


@query("ewma", f"{_E} select user_id, len(v)::bigint as n, round(list_reduce(v, lambda a, x : 0.1::double * x + 0.9::double * a), 6) as ewma from l")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec.ewma(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 0.1))


@query("quantile_tracker", """with l as (select user_id, list_concat([0.0::double], list(value order by ts, event_id)) as v from events where value is not null group by 1)
select user_id, (len(v) - 1)::bigint as n, round(list_reduce(v, lambda a, x : case when x > a then a + 0.45::double else a - (0.5::double * (1 - 0.9::double)) end), 4) as q from l""")
def quantile_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec.quantile_track(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 0.9, 0.5), 4)


@query("adaptive_conformal", """with l as (select user_id, list_concat([0.1::double], list((value > 60)::int::double order by ts, event_id)) as v, avg((value > 60)::int::double) as missed from events where value is not null group by 1),
a as (select user_id, (len(v) - 1)::bigint as n, list_reduce(v, lambda a, x : least(0.999::double, greatest(0.001::double, a + 0.01::double * (0.1::double - x)))) as level, missed from l)
select user_id, n, round(level, 6) as level, round(1 - missed, 6) as coverage, round(level / 2, 6) as lower, round(1 - level / 2, 6) as upper from a""")
def adaptive_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("missed", (F.col("value") > 60).cast("double"))
    return rounded(rec.adaptive_conformal(rows, ["user_id"], ["ts", "event_id"], "missed"))


@query("strongly_adaptive", folded("select user_id, " + _I + " as i, value / 100 as x from events where value is not null", {
    "n": ("0::bigint", "n + 1"), "est": ("[0.1::double for k in range(10)]", "e2"), "wealth": ("[1::double for k in range(10)]", "w2"), "threshold": ("0.1::double", "t"),
    "covered": ("0::bigint", "covered + (x <= t)::int"),
}, "select user_id, n, round(threshold, 6) as threshold, covered from last", (
    {"e2": "list_transform(est, lambda e, k : greatest(0, e + pow(0.5::double, k - 1) * (0.1::double - (x > e)::int)))",
     "w2": "list_transform(wealth, lambda w, k : greatest(1e-10, w * (1 + least(0.4, greatest(-0.4, pow(0.5::double, k - 1) * (0.1::double - (x > est[k])::int))))))"},
    {"t": "list_sum(list_transform(e2, lambda e, k : e * w2[k])) / list_sum(w2)"},
)))
def strongly_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("value", F.col("value") / 100)
    return rounded(rec.strongly_adaptive(rows, ["user_id"], ["ts", "event_id"], "value"))


_PH_STATE = {
    "n": ("0::bigint", "n + 1"), "mean": ("0::double", "m"), "up": ("0::double", "case when most > 50 then 0 else u end"),
    "low": ("'infinity'::double", "case when most > 50 then 'infinity'::double else lo end"), "down": ("0::double", "case when most > 50 then 0 else d end"),
    "low2": ("'infinity'::double", "case when most > 50 then 'infinity'::double else lo2 end"), "drifts": ("0::bigint", "drifts + (most > 50)::int"),
    "warnings": ("0::bigint", "warnings + (most > 25 and most <= 50)::int"), "state": ("0", "case when most > 50 then 2 when most > 25 then 1 else 0 end"),
}
_PH_LETS = (
    {"m": "mean + (x - mean) / (n + 1)"}, {"u": "up + x - m - 0.005", "d": "down + m - 0.005 - x"}, {"lo": "least(low, u)", "lo2": "least(low2, d)"},
    {"most": "greatest(u - lo, d - lo2)"},
)


@query("page_hinkley", folded(_VALUES, _PH_STATE, "select user_id, n, round(mean, 6) + 0 as mean, drifts, warnings, state from last", _PH_LETS))
def page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec.page_hinkley(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 0.005, 50.0))


@query("decomposition", folded(_VALUES, {
    "n": ("0::bigint", "n + 1"), "trend": ("0::double", "t"), "residual": ("0::double", "x - t - v"), "season": ("[0::double for k in range(7)]", "list_concat(season[1:n % 7], [v], season[n % 7 + 2:7])"),
}, "select user_id, n, round(trend, 6) as trend, round(residual, 6) as residual from last", ({"t": "case when n = 0 then x else 0.1 * x + 0.9 * trend end"}, {"v": "0.1 * (x - t) + 0.9 * season[n % 7 + 1]"})))
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec.decompose(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 7))


@query("conformal_pid", folded(f"select user_id, {_I} as i, (value > 60)::int::double as x from events where value is not null", {
    "n": ("0::bigint", "n + 1"), "total": ("0::double", "total + e"), "level": ("0.1::double", "least(10::double, greatest(0.001::double, level + 0.05 * e + 0.1 * (total + e) + 0.01 * e))"),
}, "select user_id, n, round(level, 6) as level from last", ({"e": "0.1::double - x"},)))
def conformal_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("missed", (F.col("value") > 60).cast("double"))
    return rounded(rec.conformal_pid(rows, ["user_id"], ["ts", "event_id"], "missed"))


@query("reward_normalizer", folded(_VALUES, {
    "n": ("0::bigint", "n + 1"), "mean": ("0::double", "m"), "reward": ("0::double", "r"), "total": ("0::double", "total + r"),
}, "select user_id, n, round(reward, 6) as reward, round(total, 6) as total from last", (
    {"m": "case when n = 0 then x else 0.1 * x + 0.9 * mean end"},
    {"r": "case when n = 0 or abs(m) < 1e-15 then 0.5 else least(1, greatest(0, 1 - x / m)) end"},
)))
def reward_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rec.reward(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value"))


@query("holt_winters", folded("""select v.*, f.mean, f.first from (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, value as x from events where value is not null) v
 join (select user_id, list_avg(list_slice(list(value order by ts, event_id), 1, 5)) as mean, list_slice(list(value order by ts, event_id), 1, 5) as first from events where value is not null group by 1 having count(*) >= 5) f using (user_id)""", {
    "n": ("0", "(n + 1)::int"), "level": ("0::double", "l"), "trend": ("0::double", "0.1 * (l - case when n = 0 then mean else level end) + 0.9 * trend"),
    "season": ("[]::double[]", "list_concat(se[1:n % 5], [0.1 * (x - l) + 0.9 * se[n % 5 + 1]], se[n % 5 + 2:5])"),
}, "select user_id, n, round(level, 6) as level, round(trend, 6) as trend, round(level + trend + season[n % 5 + 1], 6) as forecast from last", (
    {"se": "case when n = 0 then list_transform(first, lambda u : u - mean) else season end"},
    {"l": "0.3 * (x - se[n % 5 + 1]) + 0.7 * (case when n = 0 then mean else level end + trend)"},
)))
def holt_winters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rec.holt_winters(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 5)
    return rounded(out.where("level is not null"))


@query("gaussian_nb_moments", """select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean0, round(var_pop(l_quantity), 6) as var0, round(avg(l_discount), 6) as mean1,
 round(var_pop(l_discount), 6) as var1, round(count(*) / (select count(*) from lineitem), 6) as prior from lineitem group by 1""")
def gaussian_nb_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.gaussian_moments(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]))


@query("gaussian_nb_predict", """with m as (select l_returnflag as c, ln(count(*) / (select count(*) from lineitem)) as prior, avg(l_quantity) as m0, var_pop(l_quantity) as w0,
 avg(l_discount) as m1, var_pop(l_discount) as w1 from lineitem group by 1),
n as (select *, w0 + 1e-9 * max(greatest(w0, w1)) over () as v0, w1 + 1e-9 * max(greatest(w0, w1)) over () as v1 from m),
l as (select *, row_number() over () as r from lineitem),
s as (select r, l_orderkey, l_partkey, l_suppkey, l_linenumber, c, prior - 0.5 * (ln(2 * pi() * v0) + (l_quantity - m0) ** 2 / v0 + ln(2 * pi() * v1) + (l_discount - m1) ** 2 / v1) as s from l, n),
b as (select *, row_number() over (partition by r order by round(s, 9) desc, c) as k from s)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, c as class from b where k = 1""")
def gaussian_nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line."""
    rows = table(spark, sf_dir, "lineitem")
    moments = models.gaussian_moments(rows, "l_returnflag", ["l_quantity", "l_discount"])
    return rows.select(*_LI.split(", "), models.gaussian_predict(moments, "l_returnflag", ["l_quantity", "l_discount"]).alias("class"))


@query("multinomial_nb", """with c as (select user_id % 2 as c, event_type, sum(value) as n from events group by all), t as (select c, sum(n) as t from c group by 1)
select c.c as class, event_type, round(ln((n + 1) / (t + 5)), 6) as log_p from c join t using (c)""")
def multinomial_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("class", F.col("user_id") % 2)
    return rounded(models.multinomial(rows, "class", "event_type", "value", 1.0, 5))


@query("bernoulli_nb", """select l_returnflag, round(ln((sum((l_quantity > 25)::int) + 1.0::double) / (count(*) + 2)), 6) as log_p0, round(ln((sum((l_discount > 0.05)::int) + 1.0::double) / (count(*) + 2)), 6) as log_p1 from lineitem group by 1""")
def bernoulli_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.bernoulli(table(spark, sf_dir, "lineitem"), "l_returnflag", {"l_quantity": 25.0, "l_discount": 0.05}, 1.0))


@query("cluster_features", """with x as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings)
select label, i::int as i, count(*) as n, round(sum(x::double), 4) as ls, round(sum(x::double * x::double), 4) as ss from x group by all""")
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "embedding")
    return rounded(models.cluster_features(rows, "label", "embedding"), 4)


@query("ucb1", """with a as (select event_type as arm, count(*) as n, avg(value / 100) as mean from events group by 1)
select arm, n, round(mean + sqrt(2 * ln((select sum(n) from a)) / n), 6) as bound from a""")
def ucb1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.ucb1(table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100).alias("reward"))))


@query("thompson", """select event_type as arm, 1 + sum((value > 50)::int)::double as alpha, 1 + sum((value <= 50)::int)::double as beta from events group by 1""")
def thompson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.thompson(table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") > 50).cast("int").alias("reward")))


@query("ucb_tuned", """with a as (select event_type as arm, count(*) as n, avg(value / 100) as mean, var_pop(value / 100) as var from events group by 1), t as (select ln(sum(n)) as l from a)
select arm, n, round(mean + sqrt(l / n * least(0.25, var + sqrt(2 * l / n))), 6) as bound from a, t""")
def ucb_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.ucb_tuned(_pulls(spark, sf_dir)))


@query("epsilon_greedy", """with a as (select event_type as arm, count(*) as n, avg(value / 100) as mean from events group by 1), e as (select *, 0.3 * pow(0.9999::double, sum(n) over ()) as eps,
 row_number() over (order by mean desc, arm) = 1 as best, count(*) over () as k from a) select arm, n, round(mean, 6) as mean, round(eps / k + case when best then 1 - eps else 0 end, 6) as share from e""")
def epsilon_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.epsilon_greedy(_pulls(spark, sf_dir), 0.3, 0.9999))


@query("discounted_thompson", """with p as (select event_type as arm, (value > 50)::int as reward, pow(0.999::double, row_number() over (order by ts desc, event_id desc) - 1) as w from events)
select arm, round(1 + sum(w * reward), 6) as alpha, round(1 + sum(w * (1 - reward)), 6) as beta from p group by 1""")
def discounted_thompson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", "event_id", F.col("event_type").alias("arm"), (F.col("value") > 50).cast("int").alias("reward"))
    pulls = rows.select("arm", "reward", F.struct("ts", "event_id").alias("at"))
    return rounded(models.discounted_thompson(pulls, ["at"], 0.999))


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100).alias("reward"))


@query("nb_posterior", """with r as (select user_id, user_id % 2 as class, event_type, value from events), c as (select class, event_type, sum(value) as n from r group by all),
t as (select class, sum(value) as t, count(distinct user_id) as d from r group by 1), pr as (select *, ln(d / sum(d) over ()) as prior from t),
f as (select distinct event_type from r), lp as (select pr.class, f.event_type, ln((coalesce(n, 0) + 1) / (t + 5)) as lp from pr cross join f left join c on c.class = pr.class and c.event_type = f.event_type),
b as (select user_id, event_type, sum(value) as w from r group by all),
sc as (select user_id, lp.class, any_value(prior) + sum(w * lp) as s from b join lp using (event_type) join pr on pr.class = lp.class group by all),
e as (select *, exp(s - max(s) over (partition by user_id)) as e from sc) select user_id, class, round(e / sum(e) over (partition by user_id), 6) as p from e""")
def nb_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of users by their bags of events."""
    rows = table(spark, sf_dir, "events").withColumn("class", F.col("user_id") % 2)
    return rounded(models.posterior(rows, "class", "event_type", "value", 1.0, 5, "user_id"))


#: Lags 2 and 1 before a value, and a constant.
_LAGGED = f"""select user_id, {_I} as i, event_id, a, b, value as y from (select user_id, ts, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as a,
 lag(value, 2) over (partition by user_id order by ts, event_id) as b from events) where a is not null and b is not null and value is not null"""
_ERRORS = "select user_id, n, round(mae / n, 6) as mae, round(mse / n, 6) as mse from last"


@query("prequential_linear", folded(_LAGGED, {
    "n": ("0::bigint", "n + 1"), "w0": ("0::double", "w0 - g"), "w1": ("0::double", "w1 - g * a"), "w2": ("0::double", "w2 - g * b"), "w3": ("0::double", "w3 - g"),
    "mae": ("0::double", "mae + abs(y - p)"), "mse": ("0::double", "mse + (y - p) * (y - p)"),
}, _ERRORS, ({"p": "w0 + w1 * a + w2 * b + w3"}, {"g": "2 * 1e-5::double * (p - y)"})))
def prequential_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-then-train of a linear model on a constant and lags, per user, with its errors."""
    return _learned(spark, sf_dir, learners.Linear(dim=3, rate=1e-5)).select("user_id", "n", "mae", "mse")


@query("prequential_rls")
def prequential_rls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir, learners.RLS(dim=3, forgetting=0.99))


@query("prequential_boosting")
def prequential_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 trees of depth 4."""
    return _learned(spark, sf_dir, boosting.SGBT(dim=3, steps=25, depth=4, rate=0.05, grace=20, bins=16))


@query("prequential_kernel_rls")
def prequential_kernel_rls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir, adaptive.KernelRLS(budget=40, gamma=1e-3))


@query("prequential_echo_state")
def prequential_echo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir, adaptive.EchoState(dim=3, units=20, scale=0.01))


@query("prequential_snarimax", folded(_LAGGED, {
    "n": ("0::bigint", "n + 1"), "c": ("0::double", "c + g"), "u": ("0::double", "u + g * y1"), "v": ("0::double", "v + g * e1"), "y1": ("0::double", "y"), "e1": ("0::double", "e"),
    "mae": ("0::double", "mae + abs(y - p)"), "mse": ("0::double", "mse + (y - p) * (y - p)"),
}, _ERRORS, ({"p": "c + u * y1 + v * e1"}, {"e": "least(1e6, greatest(-1e6, y - p))"}, {"g": "1e-5::double * e"})))
def prequential_snarimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir, adaptive.Snarimax(p=1, q=1, rate=1e-5)).select("user_id", "n", "mae", "mse")


@query("prequential_bagged")
def prequential_bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir, adaptive.Bagged(5, learners.RLS(dim=3, forgetting=0.99)))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("x", F.array(F.col("value") / 200, F.hour("ts") / 24))


@query("half_space_trees")
def half_space_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly scores of a user's values and hours against the window before."""
    return fold.run_batch(_unit(spark, sf_dir), adaptive.HalfSpaceTrees(dim=2, window=20, depth=4), ["user_id"], ["ts", "event_id"], "x", "value")


@query("dbstream")
def dbstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.run_batch(_unit(spark, sf_dir), adaptive.DBStream(radius=0.2), ["user_id"], ["ts", "event_id"], "x", "value")


@query("platt")
def platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.run_batch(scored(spark, sf_dir).withColumn("x", F.array("s")), adaptive.Platt(), ["user_id"], ["ts", "event_id"], "x", "yb")


@query("ddm", folded(_SCORED, {
    "n": ("0::bigint", "case when drift then 0 else n + 1 end"), "mean": ("0::double", "case when drift then 0 else m end"), "m2": ("0::double", "case when drift then 0 else q end"),
    "least_": ("'infinity'::double", "lo"), "dev": ("'infinity'::double", "de"), "event_id": ("0::bigint", "event_id_1"),
    "signal": ("0::double", "case when drift then 2 when n + 1 > 30 and m + sd >= lo + 2 * de then 1 else 0 end"),
}, "select user_id, event_id, signal from s where i > 0", (
    {"x": "(yc <> pc)::int::double"}, {"m": "mean + (x - mean) / (n + 1)"}, {"q": "m2 + (x - mean) * (x - m)"}, {"sd": "sqrt(greatest(q / (n + 1), 0))"},
    {"lo": "case when n + 1 > 30 and m + sd < least_ then m + sd else least_ end", "de": "case when n + 1 > 30 and m + sd < least_ then sd else dev end"},
    {"drift": "n + 1 > 30 and m + sd >= lo + 3 * de"},
)).replace("b.* exclude (user_id)", "b.* exclude (user_id, event_id), b.event_id as event_id_1"))
def ddm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("x", F.array((F.col("yc") != F.col("pc")).cast("double")))
    return fold.run_batch(rows, learners.DDM(), ["user_id"], ["ts", "event_id"], "x", "y").select("user_id", "event_id", F.col("prediction").alias("signal"))


@query("adwin")
def adwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.run_batch(scored(spark, sf_dir).withColumn("x", F.array("y")), learners.ADWIN(), ["user_id"], ["ts", "event_id"], "x", "y")


def _learned(spark: SparkSession, sf_dir: str, learner) -> DataFrame:
    rows = _events(spark, sf_dir)
    xs = prep.lags("value", 2, ["user_id"], ["ts", "event_id"])
    rows = prep.finite(rows.withColumns({"a": xs[0], "b": xs[1]}), ["a", "b", "value"]).withColumn("x", F.array(F.lit(1.0), "a", "b"))
    out = fold.run_batch(rows, learner, ["user_id"], ["ts", "event_id"], "x", "value")
    return _by(out, metrics.regression(F.col("target"), F.col("prediction")), "user_id")


@query("generators")
def generators_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every synthetic stream, two seeds each."""
    from ..sources.generators import KINDS, GeneratorSource

    spark.dataSource.register(GeneratorSource)
    out = None
    for kind in KINDS:
        df = spark.read.format("tidefold_stream").option("kind", kind).option("seed", "1,2").option("rows", "500").load().withColumn("kind", F.lit(kind))
        out = df if out is None else out.union(df)
    return out


# ---- further learners: prequential errors by user; classes are the value's halves


def _small(**k) -> boosting.SGBT:
    return boosting.SGBT(**{"dim": 3, "steps": 8, "depth": 3, "rate": 0.2, "grace": 15, "bins": 16, "start": 10, **k})


LEARNERS = {
    "parallel_boosting": lambda: _small(shared=True), "skipping_boosting": lambda: _small(variant=("skip", 5)), "repeating_boosting": lambda: _small(variant=("repeat", 2.0)),
    "huber_boosting": lambda: _small(loss="huber"), "expectile_boosting": lambda: _small(loss="expectile", tau=0.8), "scheduled_boosting": lambda: boosting.Scheduled(_small(), ("plateau", 0.5, 20, 1e-3)),
    "quantile_boosting": lambda: boosting.Quantiles((0.1, 0.5, 0.9), _small()), "distributional_boosting": lambda: boosting.Distributional(_small(), "chain"),
    "mixture_of_experts": lambda: boosting.MixtureOfExperts(2, _small()), "stacked": lambda: boosting.Stacked((learners.RLS(3, 0.99), _small()), learners.RLS(2, 0.99)),
    "adaptive_rls": lambda: learners.RLS(3, 0.99, adaptive=True), "polynomial_rls": lambda: learners.Polynomial(3, 2, 0.99), "local_regression": lambda: forests.LocalRegression(30, 20.0),
    "mondrian_forest": lambda: forests.MondrianForest(3, 5), "next_generation_reservoir": lambda: neural.NextGenReservoir(3), "diagonal_ssm": lambda: neural.DiagonalSSM(3),
    "mamba": lambda: neural.Mamba(3, 4), "spike_net": lambda: neural.SpikeNet(3, 8, change=5.0), "test_time_training": lambda: neural.TestTimeTraining(3, 4), "kan": lambda: neural.KAN(3, 4),
    "neural_moe": lambda: neural.NeuralMoE(3, (learners.RLS(3, 0.99), learners.RLS(3, 0.9), learners.Linear(3, 1e-5))),
    "continual": lambda: evaluate.Continual(neural.ElasticLinear(3, 1e-5), learners.ADWIN(), restart=False),
    "auto_tuner": lambda: evaluate.AutoTuner(_tuned, {"forgetting": (0.9, 1.0), "start": (1.0, 1000.0, "log")}, 4, 20),
    "pipeline_scaled": lambda: evaluate.Pipeline((evaluate.Scale(),), learners.RLS(3, 0.99)), "pipeline_ccipca": lambda: evaluate.Pipeline((forests.CCIPCA(3),), learners.RLS(3, 0.99)),
    "pipeline_selected": lambda: evaluate.Pipeline((forests.FeatureSelector(3, 0.5),), learners.RLS(3, 0.99)), "pipeline_mamba": lambda: evaluate.Pipeline((neural.Mamba(3, 2),), learners.RLS(9, 0.99)),
    "pipeline_attention": lambda: evaluate.Pipeline((neural.Attention(3, "gla", 1, 2),), learners.RLS(6, 0.99)),
}
CLASSIFIERS = {
    "multiclass_boosting": lambda: boosting.Multiclass(3, _small(loss="softmax")), "hoeffding_classifier": lambda: forests.HoeffdingClassifier(3, 3, grace=20),
    "adaptive_forest": lambda: forests.AdaptiveForest(3, 5, 3, share=0.7), "classifier_wrapper": lambda: forests.Classifier(learners.RLS(3, 0.99), 3), "one_vs_rest": lambda: learners.OneVsRest(3, learners.RLS(3, 0.99)),
}


def _tuned(config: dict) -> learners.RLS:
    return learners.RLS(3, **config)


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant and the last two values, scaled to about 1, and the value."""
    xs = prep.lags("value", 2, ["user_id"], ["ts", "event_id"])
    rows = prep.finite(_events(spark, sf_dir).withColumns({"a": xs[0] / 100, "b": xs[1] / 100}), ["a", "b", "value"])
    return rows.select("user_id", "ts", "event_id", F.array(F.lit(1.0), "a", "b").alias("x"), (F.col("value") / 100).alias("y"), F.least(F.floor(F.col("value") / 50), F.lit(2)).cast("double").alias("c"))


def _register(name: str, make, classes: bool) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fold.run_batch(_lagged(spark, sf_dir), make(), ["user_id"], ["ts", "event_id"], "x", "c" if classes else "y")
        y, p = F.col("target"), F.col("prediction")
        return _by(out, {"n": F.count("*"), "accuracy": F.avg((y == p).cast("double"))} if classes else metrics.regression(y, p), "user_id")


for _name, _make in LEARNERS.items():
    _register(f"prequential_{_name}", _make, False)
for _name, _make in CLASSIFIERS.items():
    _register(f"prequential_{_name}", _make, True)


@query("prequential_attention")
def prequential_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven update rules as parallel members."""
    members = [neural.Attention(3, mode, 1, 3) for mode in neural.MODES]
    out = evaluate.run_members(_lagged(spark, sf_dir), members, ["user_id"], ["ts", "event_id"], "x", "y")
    return _by(out, metrics.regression(F.col("target"), F.col("prediction")), "user_id", "member")


@query("bagged_members")
def bagged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.bagged(_lagged(spark, sf_dir), learners.RLS(3, 0.99), 5, ["user_id"], ["ts", "event_id"], "x", "y")
    return _by(out, metrics.regression(F.col("target"), F.col("prediction")), "user_id")


@query("multi_target")
def multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.multi_target(_lagged(spark, sf_dir), _small(), ["user_id"], ["ts", "event_id"], "x", ["y", "c"])
    return _by(out, metrics.regression(F.col("target"), F.col("prediction")), "user_id", "target_name")


@query("progressive_validation")
def progressive_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.progressive(_lagged(spark, sf_dir), learners.RLS(3, 0.99), ["user_id"], ["ts", "event_id"], "x", "y", period=5)
    return _by(out, metrics.regression(F.col("target"), F.col("prediction")), "user_id")


_SECOND = f"select user_id, {_I} as i, value as x from events where value is not null"


@query("prequential_warm", """with l as (select user_id, value as y, lag(value) over w as p, row_number() over w as k from events window w as (partition by user_id order by ts, event_id))
select user_id, count(*) as n, round(avg(abs(y - p)), 6) as mae from l where k > 10 and k % 3 = 0 group by 1""")
def prequential_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value as prediction, scored past a warm-up at each third row."""
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.array("value").alias("x"), F.col("value").alias("y"))
    out = evaluate.prequential(rows, LastValue(), ["user_id"], ["ts", "event_id"], "x", "y", 10, 3)
    return _by(out, {"n": F.count("*"), "mae": F.avg(F.abs(F.col("target") - F.col("prediction")))}, "user_id")


class LastValue:
    """Predicts the last target."""

    def new(self):
        return 0.0

    def step(self, s, x, y):
        return s, y


@query("kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.run_batch(_unit(spark, sf_dir), learners.KMeans(3, 0.99), ["user_id"], ["ts", "event_id"], "x", "value")
    return out.groupBy("user_id", F.col("prediction").cast("int").alias("cluster")).agg(F.count("*").alias("n"))


@query("clustream")
def clustream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.run_batch(_unit(spark, sf_dir), forests.CluStream(8), ["user_id"], ["ts", "event_id"], "x", "value")
    return out.groupBy("user_id", F.col("prediction").cast("int").alias("cluster")).agg(F.count("*").alias("n"))


@query("lin_ucb")
def lin_ucb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms are event types in order, contexts a constant and the hour; per user the arm that the bandit would pull last."""
    types = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    rows = _events(spark, sf_dir).withColumn("x", F.array((F.array_position(types, F.col("event_type")) - 1).cast("double"), F.lit(1.0), F.hour("ts") / 24))
    return fold.run_batch(rows, learners.LinUCB(5, 2), ["user_id"], ["ts", "event_id"], "x", "value")


@query("temperature")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.run_batch(scored(spark, sf_dir).withColumn("x", F.array("s")), adaptive.Temperature(), ["user_id"], ["ts", "event_id"], "x", "yb")


#: Lines that the scored model is fitted on, the first by a hash of the line; every line is scored.
FIT_LINES = 5_000


def _boosted(spark: SparkSession, sf_dir: str):
    """One boosted model of the discount by three columns of a bounded sample of lines, fitted by one task; and its nodes."""
    import pickle

    rows = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount", F.array("l_quantity", "l_tax", F.col("l_extendedprice") / 1000).alias("x"))
    model = _small(subsample=1.0, grace=100)
    keyed = rows.withColumn("h", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount"))
    sample = keyed.orderBy("h", "l_orderkey", "l_linenumber").limit(FIT_LINES)
    fitted = sinks.fit(sample, model, ["k"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax"], "x", "l_discount").first()
    state = pickle.loads(fitted.state)
    return rows, model, state, model.nodes(state)


@query("score_boosted")
def score_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line scored from the node table."""
    rows, model, state, nodes = _boosted(spark, sf_dir)
    out = sinks.score_nodes(rows.select(*_LI.split(", "), "x"), nodes, state["base"], model.rate, "x")
    return rounded(out.drop("x"))


@query("tree_shap")
def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size of the features' Shapley values over the customers' averages of all lines."""
    rows, model, state, nodes = _boosted(spark, sf_dir)
    by = rows.groupBy("l_suppkey").agg(*[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(3)]).select("l_suppkey", F.array("x0", "x1", "x2").alias("x"))
    return rounded(sinks.mean_shap(sinks.explain(by, nodes, state["base"], model.rate, "x", 3)))


@query("vector_functions", """with v as (select vec_id, list_transform(embedding, lambda x : x::double) as v from embeddings),
q as (select vec_id, list_sum(list_transform(v, lambda x : x * x)) as dot, list_max(v) as top, v from v),
e as (select vec_id, dot, list_transform(v, lambda x : exp(x - top)) as e from q) select vec_id, round(dot, 6) as dot, round(e[1] / list_sum(e), 6) as first_share from e""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return rounded(rows.select("vec_id", losses.dot(F.col("v"), F.col("v")).alias("dot"), losses.softmax(F.col("v"))[0].alias("first_share")))


@query("scalar_functions", """select event_id, round(ln(1 + exp(-abs(value / 50))) + greatest(value / 50, 0), 6) as softplus, round(1 / (1 + exp(-value / 50)), 6) as sigmoid,
 round(tanh(value / 50), 6) as tanh from events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 50
    return rounded(table(spark, sf_dir, "events").select("event_id", losses.softplus(x).alias("softplus"), losses.sigmoid(x).alias("sigmoid"), F.tanh(x).alias("tanh")))
