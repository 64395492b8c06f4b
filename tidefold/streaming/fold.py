"""One ordered fold for batch and stream.

A learner has `new() -> state` and `step(state, x, y) -> (prediction, state)`; the prediction is made before the
row is learned. run_batch folds a table's rows by key in order; run_stream folds a stream, with the state kept per key.
Fed in the same order they give the same predictions. A batch key's rows pass one worker; a key that outgrows it is folded by run_stream with trigger(availableNow=True).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _fold(learner, state, pdf: pd.DataFrame, order: list[str], x: str, y: str) -> tuple[object, np.ndarray]:
    out = np.empty(len(pdf))
    for i, (a, b) in enumerate(zip(pdf[x], pdf[y], strict=True)):
        out[i], state = learner.step(state, np.asarray(a, float), float(b))
    return state, out


def _schema(df: DataFrame, key: list[str], order: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in [*key, *order]], T.StructField("target", T.DoubleType()), T.StructField("prediction", T.DoubleType())])


#: Series that a task folds together, where a learner can.
TOGETHER = 256


def _run_many(df: DataFrame, learner, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """run_batch for learners with fold_many(xs, ys): keys are dealt and sorted by Spark, and a task folds TOGETHER of them at once."""

    def done(frames: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(frames, ignore_index=True)
        cuts = [0, *_starts(pdf[key])[1:], len(pdf)]
        rows = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        xs = [np.array(pdf[x].iloc[r].tolist(), float) for r in rows]
        ys = [pdf[y].iloc[r].to_numpy(float) for r in rows]
        return pdf[[*key, *order]].assign(target=pdf[y].astype(float), prediction=np.concatenate(learner.fold_many(xs, ys)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            every = pd.concat(held, ignore_index=True)
            starts = _starts(every[key])
            if len(starts) > TOGETHER:  # the last key may go on in the next batch
                yield done([every.iloc[: starts[-1]]])
                every = every.iloc[starts[-1] :]
            held = [every]
        if held:
            yield done(held)

    rows = df.select(*key, *order, x, y).repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInPandas(run, _schema(df, key, order))


def _starts(keys: pd.DataFrame) -> list[int]:
    """Where a new key begins; nulls are equal."""
    new = np.zeros(len(keys), bool)
    new[0] = True
    for c in keys.columns:
        a, b = keys[c].to_numpy()[1:], keys[c].to_numpy()[:-1]
        new[1:] |= ~((a == b) | (pd.isna(a) & pd.isna(b)))
    return np.flatnonzero(new).tolist()


def run_batch(df: DataFrame, learner, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """(key, order, target, prediction) of every row."""
    if hasattr(learner, "fold_many"):
        return _run_many(df, learner, key, order, x, y)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        _, out = _fold(learner, learner.new(), pdf, order, x, y)
        return pdf[[*key, *order]].assign(target=pdf[y].astype(float), prediction=out)

    return df.select(*key, *order, x, y).groupBy(*key).applyInPandas(each, _schema(df, key, order))


def run_stream(df: DataFrame, learner, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """The same over a stream; a key's rows are learned in order within a micro-batch, and batches in the order of arrival."""

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "blob binary")

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            state = pickle.loads(self.state.get()[0]) if self.state.exists() else learner.new()
            pdf = pd.concat(rows).sort_values(order, kind="stable")
            state, out = _fold(learner, state, pdf, order, x, y)
            self.state.update((pickle.dumps(state),))
            yield pdf[[*key, *order]].assign(target=pdf[y].astype(float), prediction=out)

        def close(self) -> None:
            pass

    return df.select(*key, *order, x, y).groupBy(*key).transformWithStateInPandas(Processor(), _schema(df, key, order), "Append", "None")
