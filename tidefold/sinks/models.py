"""Fitted models as tables: fit, save, load, score, explain, and export of boosted trees as packed bytes and ONNX.

A model table has a row per key: key, kind (the learner's repr), rows seen and the state as bytes. It is written as Parquet, so it scales with the keys; a key's model
is fitted by one task. Node tables (one row per tree node) are what boosted trees are scored and explained from.
"""

from __future__ import annotations

import base64
import io
import json
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "tree int, node int, feature int, threshold double, left int, right int, value double, n long, depth int"
#: The first word and version of the packed formats.
MAGIC, MAGIC16, VERSION = int.from_bytes(b"TFP4", "little"), int.from_bytes(b"TFP2", "little"), 1


def fit(df: DataFrame, learner, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """(key, kind, n, state): one fitted model per key."""
    kind = repr(learner)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = learner.new()
        for a, b in zip(pdf[x], pdf[y], strict=True):
            _, state = learner.step(state, np.asarray(a, float), float(b))
        return pdf[key].head(1).assign(kind=kind, n=len(pdf), state=pickle.dumps(state))

    schema = T.StructType([*[df.schema[c] for c in key], T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("state", T.BinaryType())])
    return df.select(*key, *order, x, y).groupBy(*key).applyInPandas(each, schema)


def save(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score(df: DataFrame, models: DataFrame, learner, key: list[str], x: str) -> DataFrame:
    """df with `prediction` by each row's key's model, which does not learn; rows without a model have none. Rows meet their model by key, not by broadcast."""
    schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])

    def each(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model):
            return rows.assign(prediction=np.nan)
        state = pickle.loads(model["state"].iloc[0])
        if hasattr(learner, "raw"):
            out = [learner.output(learner.raw(state, np.asarray(a, float))) for a in rows[x]]
        else:
            blob = model["state"].iloc[0]
            out = [learner.step(pickle.loads(blob), np.asarray(a, float), 0.0)[0] for a in rows[x]]
        return rows.assign(prediction=np.asarray(out, float))

    return df.groupBy(*key).cogroup(models.groupBy(*key)).applyInPandas(each, schema)


def to_json(learner, state) -> str:
    """One model as JSON: its kind and its state."""
    return json.dumps({"kind": repr(learner), "state": base64.b64encode(pickle.dumps(state)).decode()})


class _Known(pickle.Unpickler):
    """Reads states of this package, numpy and plain values alone."""

    def find_class(self, module, name):
        if module.split(".")[0] in ("tidefold", "numpy", "builtins", "collections") and name not in ("eval", "exec", "open", "__import__", "getattr"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not part of a model")


def from_json(text: str):
    """The state of `to_json`."""
    return _Known(io.BytesIO(base64.b64decode(json.loads(text)["state"]))).load()


# ---- node tables


def node_table(spark: SparkSession, learner, state) -> DataFrame:
    """A boosted model's nodes as a table."""
    return spark.createDataFrame(learner.nodes(state), NODE)


def score_nodes(df: DataFrame, nodes: list[tuple], base: float, rate: float, x: str) -> DataFrame:
    """df with `prediction` of a boosted model, its nodes sent to the tasks once, rows walked in batches, level by level.

    A model's nodes are bounded by its trees and depth, whatever the data.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(walkable(nodes))
    schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(prediction=walk(sent.value, np.array(pdf[x].tolist(), float).reshape(len(pdf), -1), base, rate) if len(pdf) else [])

    return df.mapInPandas(run, schema)


def walkable(nodes: list[tuple]) -> tuple[np.ndarray, ...]:
    """(feature, threshold, left, value) by (tree, node)."""
    trees, most = max(n[0] for n in nodes) + 1, max(n[1] for n in nodes) + 1
    f, t, k, v = np.full((trees, most), -1), np.zeros((trees, most)), np.zeros((trees, most), int), np.zeros((trees, most))
    for a, b, feature, cut, left, _, value, *_ in nodes:
        f[a, b], t[a, b], k[a, b], v[a, b] = feature, cut, left, value
    return f, t, k, v


def walk(model: tuple[np.ndarray, ...], rows: np.ndarray, base: float, rate: float) -> np.ndarray:
    f, t, k, v = model
    out = np.full(len(rows), base)
    each = np.arange(len(rows))
    for tree in range(len(f)):
        node = np.zeros(len(rows), int)
        while True:
            feature = f[tree, node]
            inner = feature >= 0
            if not inner.any():
                break
            node = np.where(inner, k[tree, node] + (rows[each, feature] > t[tree, node]), node)
        out += rate * v[tree, node]
    return out


# ---- packed bytes: a header, tree offsets, and nodes; left and right children are neighbours


def pack(nodes: list[tuple], base: float, rate: float, dim: int) -> bytes:
    """Little-endian single-precision form: magic, version, trees, nodes, features and base; then each tree's first node; then per node
    threshold or (rate times) leaf value, feature (0xFFFF at leaves) and left child, 12 bytes.
    """
    trees = max(n[0] for n in nodes) + 1
    first, body, at = [], b"", 0
    for t in range(trees):
        own = [n for n in nodes if n[0] == t]
        first.append(at)
        for _, _, f, cut, left, _, value, *_ in own:
            body += struct.pack("<fHHI", cut if f >= 0 else rate * value, f if f >= 0 else 0xFFFF, 0, at + left if f >= 0 else 0)
        at += len(own)
    return struct.pack("<IIIIIf", MAGIC, VERSION, trees, at, dim, base) + struct.pack(f"<{trees}I", *first) + body


def pack_distributional(learner, state: dict, dim: int) -> tuple[bytes, float]:
    """The packed mean model of a distributional learner, and its deviation (empirical mode)."""
    mean = state["mean"]
    return pack(learner.model.nodes(mean), mean["base"], learner.model.rate, dim), float(np.sqrt(state["square"]))


def unpack(data: bytes) -> dict:
    """The arrays of `pack` or `pack16`; raises ValueError for anything else."""
    if len(data) < 24:
        raise ValueError("too short")
    magic, version, trees, n, dim, base = struct.unpack_from("<IIIIIf", data)
    if magic not in (MAGIC, MAGIC16) or version != VERSION:
        raise ValueError("not a packed model")
    small = magic == MAGIC16
    head = 24 + 4 * trees + (4 * (dim + 1) if small else 0)
    kind = np.dtype([("v", "<i2"), ("f", "<u2"), ("k", "<u4")]) if small else np.dtype([("v", "<f4"), ("f", "<u2"), ("_", "<u2"), ("k", "<u4")])
    if len(data) != head + n * kind.itemsize:
        raise ValueError("wrong length")
    scale = np.frombuffer(data, "<f4", dim + 1, 24 + 4 * trees) if small else None
    return {"base": base, "dim": dim, "first": np.frombuffer(data, "<u4", trees, 24), "nodes": np.frombuffer(data, kind, n, head), "scale": scale}


def pack16(nodes: list[tuple], base: float, rate: float, dim: int) -> bytes:
    """16-bit integers: thresholds by a scale per feature, 32767 / greatest size, leaves by one scale; 8 bytes a node."""
    cuts = np.zeros(dim)
    for n in nodes:
        if n[2] >= 0:
            cuts[n[2]] = max(cuts[n[2]], abs(n[3]))
    leaf = max((abs(rate * n[6]) for n in nodes if n[2] < 0), default=0.0)
    scale = np.array([*(32767 / c if c > 0 else 1.0 for c in cuts), 32767 / leaf if leaf > 0 else 1.0], "<f4")
    trees = max(n[0] for n in nodes) + 1
    first, body, at = [], b"", 0
    for t in range(trees):
        own = [n for n in nodes if n[0] == t]
        first.append(at)
        for _, _, f, cut, left, _, value, *_ in own:
            v = cut * scale[f] if f >= 0 else rate * value * scale[-1]
            body += struct.pack("<hHI", int(np.clip(np.round(v), -32768, 32767)), f if f >= 0 else 0xFFFF, at + left if f >= 0 else 0)
        at += len(own)
    return struct.pack("<IIIIIf", MAGIC16, VERSION, trees, at, dim, base) + struct.pack(f"<{trees}I", *first) + scale.tobytes() + body


def predict_packed(data: bytes, rows: np.ndarray) -> np.ndarray:
    """Predictions from packed bytes, all rows level by level."""
    m = unpack(data)
    v, f, k = m["nodes"]["v"].astype(float), m["nodes"]["f"].astype(int), m["nodes"]["k"].astype(int)
    x = np.asarray(rows, "f4")
    if m["scale"] is not None:
        x = np.round(x * m["scale"][:-1])  # not clipped: a value beyond the greatest threshold stays beyond it
    out, each = np.zeros(len(x)), np.arange(len(x))
    for first in m["first"]:
        node = np.full(len(x), int(first))
        while (inner := f[node] != 0xFFFF).any():
            feature = np.where(inner, f[node], 0)
            node = np.where(inner, k[node] + (x[each, feature] > v[node]), node)
        out += v[node]
    return m["base"] + (out / m["scale"][-1] if m["scale"] is not None else out)


# ---- ONNX: a TreeEnsembleRegressor, written field by field


def _field(number: int, value) -> bytes:
    """A protobuf field: integers, floats, strings, bytes and lists of them (packed numbers)."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def to_onnx(nodes: list[tuple], base: float, rate: float, dim: int) -> bytes:
    """An ONNX model with input `X` (rows, dim) and output `Y`."""

    def attribute(name: str, kind: int, values) -> bytes:
        body = _field(1, name)
        if kind in (6, 7, 8):
            body += b"".join(_field({6: 7, 7: 8, 8: 9}[kind], v) for v in values)
        else:
            body += _field({2: 3}[kind], values)
        return _field(5, body + _field(20, kind))

    inner = [n[2] >= 0 for n in nodes]
    leaves = [n for n in nodes if n[2] < 0]
    ints = lambda v: [int(a) for a in v]
    node = _field(1, "X") + _field(2, "Y") + _field(4, "TreeEnsembleRegressor") + _field(7, "ai.onnx.ml") + attribute("n_targets", 2, 1)
    node += attribute("nodes_treeids", 7, ints(n[0] for n in nodes)) + attribute("nodes_nodeids", 7, ints(n[1] for n in nodes))
    node += attribute("nodes_featureids", 7, ints(max(n[2], 0) for n in nodes)) + attribute("nodes_values", 6, [float(n[3]) for n in nodes])
    node += attribute("nodes_modes", 8, ["BRANCH_LEQ" if i else "LEAF" for i in inner])
    node += attribute("nodes_truenodeids", 7, ints(max(n[4], 0) for n in nodes)) + attribute("nodes_falsenodeids", 7, ints(max(n[5], 0) for n in nodes))
    node += attribute("target_treeids", 7, ints(n[0] for n in leaves)) + attribute("target_nodeids", 7, ints(n[1] for n in leaves))
    node += attribute("target_ids", 7, [0] * len(leaves)) + attribute("target_weights", 6, [float(rate * n[6]) for n in leaves]) + attribute("base_values", 6, [float(base)])

    def info(name: str, width: int) -> bytes:
        shape = _field(1, _field(2, "N")) + _field(1, _field(1, width))
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    graph = _field(1, node) + _field(2, "boosted") + _field(11, info("X", dim)) + _field(12, info("Y", 1))
    opset = _field(8, _field(1, "") + _field(2, 13)) + _field(8, _field(1, "ai.onnx.ml") + _field(2, 1))
    return _field(1, 7) + _field(7, graph) + opset


# ---- explanation


def tree_shap(nodes: list[tuple], x: np.ndarray, dim: int) -> tuple[np.ndarray, float]:
    """(values, expectation) of one tree's prediction by path-dependent Shapley values: exact over the features on the paths.

    For each leaf, the weight of a feature set is the product over its features of (x follows the path) and over the others of the share of rows that follow it; the sums over
    set sizes come from a polynomial per leaf, so the work is leaves * depth^2.
    """
    at = {n[1]: n for n in nodes}
    out, base = np.zeros(dim), 0.0

    def visit(i: int, path: dict[int, tuple[float, float]]) -> None:
        nonlocal base
        _, _, f, cut, left, right, value, n, _ = at[i]
        if f < 0:
            base += value * float(np.prod([z for _, z in path.values()]))
            fs = list(path)
            m = len(fs)
            for j, g in enumerate(fs):
                poly = np.ones(1)
                for k, h in enumerate(fs):
                    if k != j:
                        one, zero = path[h]
                        poly = np.convolve(poly, [zero, one])
                weight = sum(c * _weight(size, m) for size, c in enumerate(poly))
                one, zero = path[g]
                out[g] += weight * (one - zero) * value
            return
        covers = [max(at[c][7], 0) for c in (left, right)]
        total = sum(covers) or 2
        for child, cover, follows in ((left, covers[0], x[f] <= cut), (right, covers[1], x[f] > cut)):
            one, zero = path.get(f, (1.0, 1.0))
            visit(child, {**path, f: (one * float(follows), zero * (cover / total if sum(covers) else 0.5))})

    visit(0, {})
    return out, base


def _weight(size: int, m: int) -> float:
    from math import factorial

    return factorial(size) * factorial(m - size - 1) / factorial(m)


def shap(nodes: list[tuple], base: float, rate: float, x: np.ndarray, dim: int) -> tuple[np.ndarray, float]:
    """Of a boosted model: rate times the sum over its trees; values and expectation add up to the prediction."""
    values, expected = np.zeros(dim), base
    for t in range(max(n[0] for n in nodes) + 1):
        v, e = tree_shap([n for n in nodes if n[0] == t], x, dim)
        values, expected = values + rate * v, expected + rate * e
    return values, expected


def explain(df: DataFrame, nodes: list[tuple], base: float, rate: float, x: str, dim: int) -> DataFrame:
    """df with `shap` (an array by feature) and `expected`."""
    sent = df.sparkSession.sparkContext.broadcast(nodes)
    schema = T.StructType([*df.schema.fields, T.StructField("shap", T.ArrayType(T.DoubleType())), T.StructField("expected", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [shap(sent.value, base, rate, np.asarray(a, float), dim) for a in pdf[x]]
            yield pdf.assign(shap=[v.tolist() for v, _ in both], expected=[e for _, e in both])

    return df.mapInPandas(run, schema)


def mean_shap(explained: DataFrame) -> DataFrame:
    """(feature, importance): the mean size of the values, which merges over rows and runs."""
    e = explained.select(F.posexplode("shap").alias("feature", "v"))
    return e.groupBy("feature").agg(F.avg(F.abs("v")).alias("importance"))


def importance_drift(explained: DataFrame, key: list[str], order: list[str], delta: float = 0.005, threshold: float = 50.0) -> DataFrame:
    """A Page-Hinkley test a feature on the size of its values: (key, feature, n, mean, drifts, warnings, state)."""
    from ..operators.recurrences import page_hinkley

    e = explained.select(*key, *order, F.posexplode("shap").alias("feature", "v")).withColumn("v", F.abs("v"))
    return page_hinkley(e, [*key, "feature"], order, "v", delta, threshold)
