"""What the text operators share: written tables that cut lineage, size-checked
broadcasts, connected components, and a vectorised tokeniser over Arrow buffers."""

from __future__ import annotations

import functools
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-long table that may be broadcast (about 16 MB); larger tables are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of a table of strings or arrays that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of text handled at once by the numpy kernels, unless a single text is longer.
SLICE_BYTES = 1 << 20
#: Links that a single task may still join up.
ONE_TASK = 20_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables written to the folder in ``spark.checkpoint.dir`` and read back.

    A written table cuts the lineage and survives the loss of any executor.
    Where the setting is absent the tables go to the warehouse, which is shared too; a machine's own folder is never used on a cluster.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidefold-scratch"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if getattr(_local, "step", False):
            _local.made.append(self)

    def save(self, df: DataFrame, arrow_rows: int = 512) -> DataFrame:
        """arrow_rows bounds what a Python worker holds at once: few, as texts may be long."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(ARROW_ROWS)
        self.spark.conf.set(ARROW_ROWS, str(arrow_rows))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(ARROW_ROWS, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def sweep(self) -> None:
        """Lets Spark's cleaner delete the shuffles of finished queries now, not when the driver's memory next fills."""
        gc.collect()
        self.spark._jvm.System.gc()


_local = threading.local()


def step(f: Callable) -> Callable:
    """A pipeline's step (spark, docs, sf_dir) -> DataFrame, whose result is written and read again as the next one's docs.

    It begins by deleting the scratch tables that this thread's earlier steps, and only they, wrote, but for those that docs still reads.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made, read = getattr(_local, "made", []), docs.inputFiles()
        path = spark._jvm.org.apache.hadoop.fs.Path
        gone = [s for s in made if not any(path(s.root).toUri().getPath() in x for x in read)]
        for s in gone:
            path(s.root).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(s.root), True)
        if gone:
            gone[-1].sweep()
        _local.made, _local.step = [s for s in made if s not in gone], True
        try:
            return f(spark, docs, sf_dir)
        finally:
            _local.step = False

    return run


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows are within the bound; else Spark shuffles it."""
    return F.broadcast(df) if rows <= most else df


def light(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df, a written table or a short plan, for broadcast if its rows, written out, are within the bound in bytes; for strings and arrays."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: (node, label) with the least node as label."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["at", "to"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of links(a, b), with comp the smallest node reachable.

    Contraction: in each round every node moves to the least node among its
    neighbours and itself, links are rewritten to the new nodes, and loops go. From
    the fourth round on, "least" is by a random priority, so that a long path too takes
    a logarithmic number of rounds. No round gathers a neighbourhood: only minima
    are taken, which Spark computes before the shuffle. Once at most ONE_TASK links are
    left, a single task ends the work by union-find.
    """
    edges = scratch.save(links.select("a", "b").where("a <> b"))
    n, turn, label = edges.count(), 0, None
    while n > ONE_TASK:
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct((F.xxhash64(F.lit(turn), F.col(c)) if turn > 2 else F.col(c)).alias("p"), F.col(c).alias("v"))  # noqa: E731, B023
        m = F.least(F.min(rank("b")), F.min(rank("a")))
        step = scratch.save(both.groupBy(F.col("a").alias("at")).agg(m.alias("m")).select("at", F.col("m.v").alias("to")))
        # a node that an earlier round left has its label among the nodes of this one, or is done
        moved = step.toDF("node", "label") if label is None else label.join(step, label.label == step["at"], "left").select("node", F.coalesce("to", "label").alias("label"))
        label = scratch.save(moved)
        sa, sb = step.toDF("a", "a2"), step.toDF("b", "b2")
        edges = edges.join(sa, "a").join(sb, "b").where("a2 <> b2")
        edges = scratch.save(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        n, turn = edges.count(), turn + 1
    step = scratch.save(edges.coalesce(1).mapInArrow(_finish, "at long, to long"))
    if label is None:
        return step.toDF("node", "comp")
    label = label.join(small(step, n), label.label == step["at"], "left").select("node", F.coalesce("to", "label").alias("label"))
    least = label.groupBy("label").agg(F.min("node").alias("comp"))
    return scratch.save(label.join(least, "label").select("node", "comp"))


def merge_components(comp: DataFrame | None, found: DataFrame, scratch: Scratch) -> DataFrame:
    """comp(node, comp) after the further links found(a, b) between nodes: a component is a star of links."""
    return components(found if comp is None else found.union(comp.select("node", "comp").toDF("a", "b")), scratch)


# ---------------------------------------------------------------- numpy kernels

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_P, _PINV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POW, _INV = made
    return _POW, _INV


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
#: Bytes of words [^\x20\x09-\x0D]+ and, after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; a null is an empty text."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of text, or a single row."""
    if not batch.num_rows:
        return
    off = buffers(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def tokenise(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and the place of each text's first word (one more entry: the number of words)."""
    m = table[data]
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = m
    step = np.diff(edge)
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    cut = inner[(m[inner] & m[inner - 1])] if len(inner) else inner
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, off)


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: differences of prefix sums of byte value times a power, moved back to the start."""
    pw, inv = _powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=h[1:])
    x = (h[ends] - h[starts]) * inv[starts]
    return mix64(x + (ends - starts).astype(np.uint64) * _P)


def words(texts: pa.Array, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts with A-Z lower-cased, and the place of each text's first word."""
    data, off = buffers(texts)
    data = _LOWER[data]
    starts, ends, first = tokenise(data, off, table)
    return range_hash(data, starts, ends), first


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over pieces of bounded bytes of `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column):
                out = f(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
