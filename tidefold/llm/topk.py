"""Exact top-k by inner product: norm buckets, length or coordinate pruning, verified products.

Components become floor(1024 * x) of x as double. A vector that is null or holds a null
or non-finite component takes no part; only vectors of one dimension are compared.
Queries take every other row (by vec_id) as candidates; scores are exact integers and
ties go to the smaller vec_id.

Method. Candidates are dealt by length into Arrow batches; each batch sorts its vectors by
length, longest first, and cuts them into buckets of at most BUCKET vectors.
Queries come in blocks of at most QUERY_BLOCK rows (so what is sent out is bounded by
QUERY_BLOCK whatever the input; more queries make more blocks). For a query q with k-th best score t so far
a bucket of greatest length m is skipped if |q| * m < t. Otherwise the local cosine threshold
c = t / (|q| * m) chooses the pruning: below COSINE only by length (a prefix of the bucket with
|p| >= t / |q|); above, by coordinates: a unit vector within cosine c of q/|q| lies, in each coordinate,
between q*c - s and q*c + s with s = sqrt((1 - q^2)(1 - c^2)), so sorted lists of the query's FOCUS largest coordinates
give the candidates. Bounds are widened for rounding, and the products that remain are
computed as exact integers. Each task keeps its k best rows a query over all its batches and returns them once; the last merge is by
query in two levels. A first pass over the longest vectors gives every query a starting threshold.

Defined cases: fewer than k candidates: all of them; repeated vec_ids are separate candidates with
equal ids (a query's own id is never its candidate; of a repeated query id the least vector asks); components beyond a long's range are
held at it, and so are scores; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUCKET, QUERY_BLOCK, COSINE, FOCUS, SEEDS = 1024, 4096, 0.5, 3, 1024
#: Bytes of candidates that a task searches at once.
TASK_BYTES = 32 << 20
SCALE = 1024


def integer_vectors(rows: DataFrame) -> DataFrame:
    """rows(vec_id, embedding) as (vec_id, v array<double> of integers, norm), without rows that take no part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    v = F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("double"))
    rows = rows.select("vec_id", v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _exact(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, by Python's integers."""
    if len(q) * max(1.0, np.abs(p).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) < 2.0**53:
        return (p @ q).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in p)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in sums], np.int64)


class _Best:
    """The k best (score, id) of one query, higher score first, then smaller id."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.scores, self.ids = k, floor, np.empty(0, np.int64), np.empty(0, np.int64)

    def threshold(self) -> float:
        return max(self.floor, float(self.scores[-1]) if len(self.scores) == self.k else -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.threshold()
        s, i = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, also at the least long
        self.scores, self.ids = s[order], i[order]


def search(ids: np.ndarray, p: np.ndarray, norms: np.ndarray, queries: list[tuple[int, np.ndarray, float, float]], best: list[_Best]) -> None:
    """Adds what of p is among the k best of each (query id, vector, length, starting threshold)."""
    order = np.argsort(-norms, kind="stable")
    ids, p, norms = ids[order], p[order], norms[order]
    for at in range(0, len(ids), BUCKET):
        b, n, own = p[at : at + BUCKET], norms[at : at + BUCKET], ids[at : at + BUCKET]
        top, lists = float(n[0]), {}
        unit = b / np.where(n > 0, n, 1)[:, None]
        for (qid, q, length, _), hold in zip(queries, best, strict=True):
            t = hold.threshold()
            if t > 0 and length * top * (1 + 1e-9) + 1e-6 < t:
                continue
            c = t / (length * top) if length * top > 0 else -np.inf
            if c < COSINE:
                # lengths fall along the bucket: those that can reach t are a prefix
                rows = np.arange(np.searchsorted(-n, -(t / length) * (1 - 1e-9) + 1e-6, "right") if t > 0 and length > 0 else len(n))
            else:
                c, u, rows = min(c * (1 - 1e-9), 1.0), q / length, None
                for f in np.argsort(-np.abs(u), kind="stable")[:FOCUS]:
                    if f not in lists:
                        by = np.argsort(unit[:, f], kind="stable")
                        lists[f] = by, unit[by, f]
                    by, values = lists[f]
                    s = np.sqrt(max(0.0, 1 - u[f] ** 2) * max(0.0, 1 - c * c)) + 1e-9
                    lo = -2.0 if u[f] <= -c else u[f] * c - s
                    hi = 2.0 if u[f] >= c else u[f] * c + s
                    hit = by[np.searchsorted(values, lo, "left") : np.searchsorted(values, hi, "right")]
                    rows = np.sort(hit) if rows is None else np.intersect1d(rows, hit, assume_unique=True)
            rows = rows[own[rows] != qid]
            if len(rows):
                hold.add(_exact(b[rows], q), own[rows])


def _searched(batches: Iterator[pa.RecordBatch], blocks, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's candidates for each query, held over all its batches and given once."""
    by_size: dict[int, list] = {}
    for q in blocks.value:
        by_size.setdefault(len(q[1]), []).append(q)
    best = {d: [_Best(k, floor) for *_, floor in own] for d, own in by_size.items()}
    held: list[pa.RecordBatch] = []

    def done() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        lists = table.column("v").combine_chunks()
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat, ids, norms = lists.flatten().to_numpy(), table.column("vec_id").to_numpy(), table.column("norm").to_numpy()
        at = np.concatenate([[0], np.cumsum(size)])
        for d, own in by_size.items():
            rows = np.flatnonzero(size == d)
            if len(rows):
                search(ids[rows], flat[at[rows][:, None] + np.arange(d)], norms[rows], own, best[d])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.nbytes for b in held) >= TASK_BYTES:
                done()
    if held:
        done()
    out = [(q[0], i, s) for d, own in by_size.items() for q, h in zip(own, best[d], strict=True) for s, i in zip(h.scores.tolist(), h.ids.tolist(), strict=True)]
    a = np.array(out, np.int64).reshape(-1, 3)
    yield pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(3)], ["query_id", "vec_id", "score"])


def _floors(block: list, longest: list, k: int) -> list[float]:
    """A lower bound of each query's k-th best score from the longest vectors, by one product a dimension."""
    out = [-np.inf] * len(block)
    for d in {len(r.v) for r in block}:
        own = [i for i, r in enumerate(block) if len(r.v) == d]
        seeds = [(r.vec_id, r.v) for r in longest if len(r.v) == d]
        if len(seeds) <= k:
            continue
        p, ids = np.array([v for _, v in seeds]), np.array([i for i, _ in seeds])
        q = np.array([block[i].v for i in own])
        scores = np.where(np.array([block[i].vec_id for i in own])[:, None] == ids, -np.inf, q @ p.T)
        kth = np.partition(scores, -k, axis=1)[:, -k]
        size = np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1).max()
        for i, t, m in zip(own, kth, size, strict=True):
            out[i] = float(t - 1e-9 * m - 1) if np.isfinite(t) and np.isfinite(m) else -np.inf
    return out


def _merge(found: DataFrame, k: int, by: list) -> DataFrame:
    w = Window.partitionBy("query_id", *by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of rows(vec_id, embedding) for each row that is_query selects."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.save(integer_vectors(rows))
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.v", "q.norm")
    width = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = scratch.save(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(width))))
    longest = vectors.orderBy(F.col("norm").desc(), "vec_id").limit(SEEDS).collect()
    dealt = scratch.save(vectors.repartitionByRange(max(1, spark.sparkContext.defaultParallelism * 2), F.col("norm").desc(), "vec_id"))
    found = None
    for part in range(width):
        rows_ = asked.where(F.col("part") == part).collect()
        block = [(r.vec_id, np.array(r.v), float(r.norm), t) for r, t in zip(rows_, _floors(rows_, longest, k), strict=True)]
        if not block:
            continue
        sent = spark.sparkContext.broadcast(block)
        part_found = scratch.save(dealt.mapInArrow(lambda batches, s=sent: _searched(batches, s, k), "query_id long, vec_id long, score long"))
        found = part_found if found is None else found.union(part_found)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = _merge(found, k, [F.pmod(F.xxhash64("vec_id"), F.lit(16))]).drop("rank")
    return _merge(first, k, []).select("query_id", "rank", "vec_id", "score")
