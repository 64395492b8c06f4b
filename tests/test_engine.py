"""Operators against their SQL, plain Python, and each other (batch and stream)."""

import math
import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import boosting, learners, metrics, models
from tidefold.operators import preprocess as prep
from tidefold.operators import recurrences as rec
from tidefold.plans import catalog
from tidefold.sources.generators import KINDS, GeneratorSource, Xorshift
from tidefold.streaming import fold

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(([str(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


def test_page_hinkley_as_its_sql_at_the_edges(spark, duck, tmp_path):
    """A sum that lands on the threshold but for its last bit, and a mean next to a half of the last digit."""
    values = {1: [125.11, 25.1, 82.97, 147.55, 35.93], 2: np.round(np.random.default_rng(561).uniform(0, 100, 32), 2).tolist()}
    rows = [(u, i, float(v)) for u, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double").selectExpr("event_id", "timestamp_seconds(event_id) as ts", "user_id", "'view' as event_type", "value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["page_hinkley"](spark, str(tmp_path))
    con = duck.cursor()
    con.execute(f"create temp view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.SQL["page_hinkley"])
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidefold.llm", None)
    import __spark_entry__

    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)


def test_metric_edges(spark):
    one = spark.createDataFrame([(1.0, 1.0)], "y double, p double")
    r = one.agg(*[c.alias(k) for k, c in metrics.regression(F.col("y"), F.col("p")).items()]).first()
    assert r.r2 == 0 and r.mae == 0
    c = spark.createDataFrame([(0, 0)], "y int, p int").agg(*[v.alias(k) for k, v in metrics.classification(F.col("y"), F.col("p")).items()]).first()
    assert (c.accuracy, c.precision, c.recall, c.f1) == (1, 0, 0, 0)


def test_page_hinkley_against_a_loop(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(5, 1, 200)])
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, t int, x double")
    got = rec.page_hinkley(df, ["k"], ["t"], "x", 0.005, 50.0).first()
    n = mean = up = down = drifts = warnings = 0.0
    low, high = math.inf, -math.inf
    for v in x:
        n += 1
        mean += (v - mean) / n
        up, down = up + v - mean - 0.005, down + v - mean + 0.005
        low, high = min(low, up), max(high, down)
        most = max(up - low, high - down)
        state = 2 if most > 50 else int(most > 25)
        warnings += state == 1
        if state == 2:
            up = down = 0.0
            low, high = math.inf, -math.inf
            drifts += 1
    assert got.n == n and got.drifts == drifts >= 1 and got.warnings == warnings and got.state == state and got["mean"] == pytest.approx(mean)


def test_learners_learn_and_detectors_detect():
    rng = np.random.default_rng(1)
    xs = rng.uniform(-5, 5, (2000, 2))
    ys = xs @ [2.0, 3.0]
    for model in (learners.Linear(2, 0.005), learners.RLS(2), boosting.SGBT(2, steps=20, depth=4, rate=0.3, grace=30)):
        s, err = model.new(), []
        for x, y in zip(xs, ys, strict=True):
            p, s = model.step(s, x, y)
            err.append((p - y) ** 2)
        assert np.mean(err[-500:]) < 0.5 * np.mean(err[:200]) and all(map(math.isfinite, err))
    # the bound is for values within [0, 1]
    z = np.concatenate([rng.normal(0.2, 0.05, 500), rng.normal(0.8, 0.05, 500)])
    model, s, hits = learners.ADWIN(), [], []
    for i, v in enumerate(z):
        signal, s = model.step(s, [v], 0.0)
        if signal == 2:
            hits.append(i)
    assert hits and 500 <= hits[0] < 600
    model = learners.DDM()
    s, hits = model.new(), []
    for i, v in enumerate(np.concatenate([rng.random(500) < 0.1, rng.random(500) < 0.8])):
        level, s = model.step(s, [float(v)], 0.0)
        if level == 2:
            hits.append(i)
    assert hits and hits[0] >= 500


def test_split_gain_of_known_sums():
    """Gradients -5, -5, 5, 5 and hessians 2, 2, 2, 2 split in the middle with a gain of 20."""
    forest = boosting.Forest(1, 1, 4)
    k = forest.slot[0, 0]
    forest.sums[k, 0, 0], forest.sums[k, 1, 0] = [-5, -5, 5, 5], [2, 2, 2, 2]
    forest.edges[k, 0], forest.ready[k], forest.n[0, 0] = [1.0, 2.0, 3.0], True, 1000
    assert forest.split(np.array([0]), np.array([0]), None, 1.0, 0.0, 1e-7, 6) == 1
    assert forest.gains[0, 0] == 20 and forest.threshold[0, 0] == 2.0 and forest.value[0, 1:].tolist()[:2] == [2.0, -2.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = catalog._events(spark, SF).withColumn("x", F.array(F.lit(1.0), "value")).withColumn("part", F.ntile(3).over(catalog.Window.orderBy("ts", "event_id")))
    for i in (1, 2, 3):
        rows.where(f"part = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = fold.run_batch(rows, learners.RLS(2), ["user_id"], ["ts", "event_id"], "x", "value")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = fold.run_stream(stream, learners.RLS(2), ["user_id"], ["ts", "event_id"], "x", "value")
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.event_id, round(r.prediction, 6))
    assert sorted(map(key, spark.table("streamed").collect())) == sorted(map(key, batch.collect()))


def test_generators(spark):
    spark.dataSource.register(GeneratorSource)
    for kind in KINDS:
        load = lambda k=kind: spark.read.format("tidefold_stream").option("kind", k).option("seed", "1,2").option("rows", 50).load()
        rows = sorted(tuple(r) for r in load().collect())
        assert len(rows) == 100 and rows == sorted(tuple(r) for r in load().collect())
        assert all(math.isfinite(v) for r in rows for v in [*r[2], r[3]])
    assert Xorshift(0).next() == 1082269761


def test_preprocessors(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (1, 2, float("nan")), (1, 3, None)], "k int, t int, x double")
    assert prep.finite(df, ["x"]).count() == 2
    assert [r.z for r in prep.finite(df, ["x"]).select("t", prep.min_max("x", ["k"], ["t"]).alias("z")).orderBy("t").collect()] == [0.5, 1.0]
    a = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "x array<double>")
    assert [r.c for r in a.select(models.assign(F.col("x"), [[0.0, 1.0], [3.0, 3.0]]).alias("c")).collect()] == [0, 1]
    h = spark.createDataFrame([(1.0, 2.0)], "a double, b double").select(prep.hash_features([F.col("a"), F.col("b")], 4).alias("h")).first().h
    assert sum(map(abs, h)) in (3.0, 1.0)


sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))


def test_more_learners():
    hw = learners.HoltWinters(4)
    s, err = hw.new(), []
    for t in range(200):
        y = 10 + 0.1 * t + [3, -1, -4, 2][t % 4]
        p, s = hw.step(s, None, y)
        err.append(abs(p - y))
    assert max(err[-20:]) < 0.5
    km, rng = learners.KMeans(2), np.random.default_rng(0)
    s = km.new()
    for i in range(200):
        _, s = km.step(s, np.array([10.0 * (i % 2), 0.0]) + rng.normal(0, 0.1, 2), 0.0)
    assert sorted(round(c[0] / 10) for c in s[0]) == [0, 1]
    poly, err = learners.Polynomial(2), []
    s = poly.new()
    for x in rng.uniform(-1, 1, (300, 2)):
        p, s = poly.step(s, x, 1 + x[0] * x[1] - x[1] ** 2)
        err.append(abs(p - (1 + x[0] * x[1] - x[1] ** 2)))
    assert np.mean(err[-50:]) < 0.05
    many, hit = learners.OneVsRest(3, learners.RLS(3)), []
    s = many.new()
    for i in range(300):
        x = np.eye(3)[i % 3] + rng.normal(0, 0.1, 3)
        p, s = many.step(s, x, float(i % 3))
        hit.append(p == i % 3)
    assert np.mean(hit[-100:]) > 0.95
    ucb, s, picks = learners.LinUCB(2, 2, 0.1), None, []
    s = ucb.new()
    for i in range(400):
        arm, c = i % 2, np.array([1.0, rng.uniform(-1, 1)])
        p, s = ucb.step(s, [arm, *c], c[1] if arm else -c[1])
        picks.append(p == (c[1] > 0))
    assert np.mean(picks[-100:]) > 0.9


def test_file_sources(spark, tmp_path):
    from tidefold.sources import files

    (tmp_path / "a.csv").write_text("x,kind,y\n1,b,0\n2,a,1\n3,b,\n4,c,1\n")
    rows = [(list(r.features), r.target) for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()]
    assert rows == [([1.0, 0.0], 0.0), ([2.0, 1.0], 1.0), ([4.0, 2.0], 1.0)]
    got = files.read_parquet(spark, f"{SF}/lineitem.parquet", "l_tax").first()
    assert len(got.features) == 3
    files.write_predictions(spark.createDataFrame([(1 / 3,)], "prediction double"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()[0] == "0.333333"
