"""Command line: train, predict, eval, inspect, export and config, each a Spark job over a CSV with a header or a Parquet table.

python -m tidefold.cli train data.csv model --model sgbt --set steps=50 --set rate=0.1
"""

from __future__ import annotations

import argparse
import ast
import json
import pickle
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .errors import ConfigError, FormatError, TidefoldError
from .operators import metrics
from .sinks import models as sinks
from .sources import files
from .streaming import fold


def _rows(spark: SparkSession, path: str, target: str | None) -> DataFrame:
    """(k, seq, features, target): one key, in the order of the file."""
    if path.endswith(".csv"):
        rows = files.read_csv(spark, path, target)
    else:
        if target is None:
            raise ConfigError("a Parquet table needs --target")
        rows = files.read_parquet(spark, path, target).withColumn("seq", F.monotonically_increasing_id())
    return rows.withColumn("k", F.lit(0))


def _settings(args) -> tuple[str, dict]:
    name, settings = models.read_config(args.config) if args.config else (args.model, {})
    for s in args.set:
        k, _, v = s.partition("=")
        try:
            settings[k] = ast.literal_eval(v)
        except (ValueError, SyntaxError):
            settings[k] = v
    return name, settings


def _learner(spark, args, rows):
    name, settings = _settings(args)
    first = rows.select(F.size("features").alias("n")).first()
    if first is None:
        raise FormatError(f"{args.data}: no rows")
    return models.build(name, first.n, args.scaled, **settings), name, settings, first.n


def _load(spark: SparkSession, path: str):
    meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
    return sinks.load(spark, f"{path}/state"), models.build(meta["model"], meta["dim"], meta["scaled"], **meta["settings"]), meta


def train(spark: SparkSession, args) -> None:
    rows = _rows(spark, args.data, args.target)
    learner, name, settings, dim = _learner(spark, args, rows)
    sinks.save(sinks.fit(rows, learner, ["k"], ["seq"], "features", "target"), f"{args.out}/state")
    meta = json.dumps({"model": name, "dim": dim, "scaled": args.scaled, "settings": settings})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/meta")


def predict(spark: SparkSession, args) -> None:
    fitted, learner, _ = _load(spark, args.out)
    scored = sinks.score(_rows(spark, args.data, args.target), fitted, learner, ["k"], "features")
    files.write_predictions(scored.orderBy("seq"), args.to)


def evaluate(spark: SparkSession, args) -> None:
    rows = _rows(spark, args.data, args.target)
    learner, name, _, _ = _learner(spark, args, rows)
    out = fold.run_batch(rows, learner, ["k"], ["seq"], "features", "target").cache()
    y, p = F.col("target"), F.col("prediction")
    found = out.agg(*[c.alias(k) for k, c in metrics.regression(y, p).items()], F.avg((F.round(p) == y).cast("double")).alias("accuracy")).first().asDict()
    if models.MODELS[name][1] == "classification":
        rounded = out.select("k", F.round(p).alias("p"), y.alias("y"))
        found["kappa"] = metrics.kappa(rounded, "y", "p", ["k"]).first().kappa
    for k, v in found.items():
        print(f"{k:10} {v}")


def inspect(spark: SparkSession, args) -> None:
    fitted, learner, meta = _load(spark, args.out)
    row = fitted.first()
    print(json.dumps(meta), f"rows {row.n}, state {len(row.state)} bytes", sep="\n")
    if hasattr(learner, "nodes"):
        state = pickle.loads(row.state)
        nodes = learner.nodes(state)
        print(f"trees {len({n[0] for n in nodes})}, leaves {sum(n[2] < 0 for n in nodes)}, importances {learner.importances(state).round(4).tolist()}")


def export(spark: SparkSession, args) -> None:
    fitted, learner, meta = _load(spark, args.out)
    if not hasattr(learner, "nodes"):
        raise ConfigError(f"{meta['model']} has no trees to export")
    state = pickle.loads(fitted.first().state)
    write = {"packed": sinks.pack, "packed16": sinks.pack16, "onnx": sinks.to_onnx}[args.format]
    with open(args.to, "wb") as f:
        f.write(write(learner.nodes(state), state["base"], learner.rate, meta["dim"]))


def config(spark: SparkSession | None, args) -> None:
    if args.check:
        name, settings = models.read_config(args.check)
        models.build(name, 1, **settings)
        print("fine")
    else:
        print(models.template(args.model), end="")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidefold")
    sub = parser.add_subparsers(dest="do", required=True)
    for name, f, needs in (("train", train, "data out"), ("predict", predict, "data out to"), ("eval", evaluate, "data"), ("inspect", inspect, "out"), ("export", export, "out to"), ("config", config, "")):
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        for a in needs.split():
            p.add_argument(a)
        p.add_argument("--target")
        p.add_argument("--model", default="sgbt", choices=sorted(models.MODELS))
        p.add_argument("--config")
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        p.add_argument("--scaled", action="store_true")
        p.add_argument("--format", default="packed", choices=["packed", "packed16", "onnx"])
        p.add_argument("--check")
    args = parser.parse_args(argv)
    try:
        if args.run is not config and spark is None:
            spark = SparkSession.builder.appName("tidefold").getOrCreate()
        args.run(spark, args)
    except TidefoldError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
