"""The order contract: Spark has no arrival order, so every ordered operator takes `order`, which must be total within `key`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A row per key with `rows`, the array of (order, values) structs in order, for folds by `aggregate`.

    A key's rows are held by one task; use the keyed fold of `tidefold.streaming` where a key may outgrow it.
    """
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("rows"))


def check_total(rows: DataFrame, key: list[str], order: list[str]) -> bool:
    """Whether no two rows of a key tie in `order`."""
    return rows.groupBy(*key, *order).count().where("count > 1").isEmpty()
