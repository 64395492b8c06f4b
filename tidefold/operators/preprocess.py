"""Streaming preprocessors as windows: a row's output uses the rows up to and including it (update, then transform)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _up_to(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def normalize(x: str, key: list[str], order: list[str], floor: float = 1e-12) -> Column:
    """(x - mean) / sqrt(population variance + floor) of the rows so far."""
    w = _up_to(key, order)
    return (F.col(x) - F.avg(x).over(w)) / F.sqrt(F.var_pop(x).over(w) + floor)


def min_max(x: str, key: list[str], order: list[str], lo: float = 0.0, hi: float = 1.0) -> Column:
    """x scaled by the least and greatest so far; the middle where they are equal."""
    w = _up_to(key, order)
    least, span = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    return F.when(span < 1e-12, F.lit((lo + hi) / 2)).otherwise(lo + (F.col(x) - least) / span * (hi - lo))


def target_encode(category: str, y: str, key: list[str], order: list[str], smoothing: float) -> Column:
    """(n_c mean_c + m mean) / (n_c + m) of the rows so far."""
    every, own = _up_to(key, order), _up_to([*key, category], order)
    return (F.sum(y).over(own) + smoothing * F.avg(y).over(every)) / (F.count(y).over(own) + smoothing)


def one_hot(x: Column, categories: list) -> Column:
    """An array of 0 and 1 by the sorted categories; an unseen value gives zeros."""
    return F.array(*[F.coalesce((x == c).cast("double"), F.lit(0.0)) for c in sorted(categories)])


def discover(rows: DataFrame, x: str, most: int = 64) -> list:
    """The sorted distinct values, the first `most` in sort order; further ones have no place and encode as zeros (a fixed limit of the method, 64)."""
    return [r[0] for r in rows.select(x).where(F.col(x).isNotNull()).distinct().orderBy(x).limit(most).collect()]


def polynomial(xs: list[Column], interaction_only: bool = False) -> list[Column]:
    """xs, then the products of pairs i <= j (i < j)."""
    n = len(xs)
    return [*xs, *[xs[i] * xs[j] for i in range(n) for j in range(i + int(interaction_only), n)]]


def monomials(xs: list[Column], degree: int) -> list[Column]:
    """All monomials of exactly this degree."""
    from itertools import combinations_with_replacement

    out = []
    for c in combinations_with_replacement(range(len(xs)), degree):
        m = xs[c[0]]
        for i in c[1:]:
            m = m * xs[i]
        out.append(m)
    return out


def hash_features(xs: list[Column], buckets: int, seed: int = 0) -> Column:
    """Signed hashing of feature positions into buckets: a fixed linear map."""
    import zlib

    cells: list[list[Column]] = [[] for _ in range(buckets)]
    for i, x in enumerate(xs):
        h = zlib.crc32(f"{seed}:{i}".encode())
        cells[(h >> 1) % buckets].append(x if h & 1 else -x)
    return F.array(*[sum(c[1:], c[0]) if c else F.lit(0.0) for c in cells])


def lags(x: str, k: int, key: list[str], order: list[str]) -> list[Column]:
    """The last k values before the row, newest first."""
    w = Window.partitionBy(*key).orderBy(*order)
    return [F.lag(x, i).over(w) for i in range(1, k + 1)]


def finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.where(ok)


def label_encode(rows: DataFrame, x: str, order: list[str]) -> DataFrame:
    """x as 0, 1, ... by first appearance in `order`."""
    first = rows.groupBy(x).agg(F.min(F.struct(*order)).alias("_first"))
    codes = first.select(x, (F.row_number().over(Window.orderBy("_first")) - 1).alias(f"{x}_code"))
    return rows.join(codes, x)
