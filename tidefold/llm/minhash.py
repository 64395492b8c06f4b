"""Near-duplicate documents by circulant MinHash.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased. A
document's set holds its distinct shingles of five consecutive words; with one to
four words the whole sequence is its one shingle; without words the set is empty.
Two documents are linked if ``100 * |A & B| >= 75 * |A | B|``.

Method. A shingle is hashed to 64 bits and its low 32 bits are its place in a universe
of 2**32. Two permutations of the universe are fixed: the first scrambles the place,
the second, shifted circularly by k, gives coordinate k of the signature (the
minimum over the set). Four coordinates form a band and 32 bands are made, so a
pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.

Documents with equal sets are one class with a representative, the smallest doc_id;
only representatives are compared. Within a band bucket no all-pairs list is made:
members are ranked, and in rounds members of few ranks (1, then 16, 256, ...) are
pivots tested against later members that still belong to another component, until no
bucket spans two components or every rank has been a pivot. A pair in one bucket is
thus either tested on its full sets, or already known to be in one component, or ruled
out by sizes or, after the first round, by bitmaps of 1024 bits: each bit of one set that the other
lacks is a shingle not shared, which bounds what they share without a test.

Defined cases: null or empty text and texts without words have an empty set, are
linked with nothing and are kept; rows that repeat a doc_id count as one document
that may be linked through any of them; a null doc_id takes no part in linking, has a
null component and is kept. Extra columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, merge_components, mix64, small, words

SHINGLE, BANDS, BAND_ROWS, PERCENT = 5, 32, 4, 75
#: Members of a bucket that are ranked by one task; larger buckets are salted.
RANKED = 50_000
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted within each text, and the place of each text's first (one more entry: the count)."""
    h, first = words(texts)
    n = np.diff(first)
    if len(h) >= SHINGLE:
        full = len(h) - SHINGLE + 1
        s = np.zeros(full, np.uint64)
        for i in range(SHINGLE):
            s += h[i : i + full] * _STEP[i]
        s = mix64(s)
        left = np.repeat(first[1:], n)[:full] - np.arange(full)
        ok = left >= SHINGLE
        s, count = s[ok], np.maximum(n - SHINGLE + 1, 0)
    else:
        s, count = np.empty(0, np.uint64), np.zeros(len(n), np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.array([np.sum(h[first[i] : first[i + 1]] * np.array(_STEP[: n[i]])) + np.uint64(n[i]) for i in short], np.uint64)
        at = np.concatenate([[0], np.cumsum(count)])[short]
        s, count = np.insert(s, at, mix64(own)), count.copy()
        count[short] = 1
    at = np.concatenate([[0], np.cumsum(count)])
    for i in range(len(count)):
        s[at[i] : at[i + 1]].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[at[:-1][count > 0]] = True
    places = np.concatenate([[0], np.cumsum(new)])
    return s[new], places[at]


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(s: np.ndarray, at: np.ndarray, size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """Circulant MinHash of each non-empty set: coordinate k is the least image of its scrambled places moved back by k."""
    places = _permute(s.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((size, len(at)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_permute(places - np.uint32(k), 0x21F0AAAD, 0xD35A2D97), at)
    return out


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    s, at = shingle_sets(batch.column("text"))
    n = np.diff(at)
    held = np.flatnonzero(n)
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    keys = np.empty((0, BANDS), np.uint64)
    if len(held):
        starts = at[:-1][held]
        a[held] = np.add.reduceat(mix64(s + np.uint64(1)), starts)
        b[held] = np.add.reduceat(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        sig = signatures(s, starts).astype(np.uint64).reshape(BANDS, BAND_ROWS, len(held))
        key = np.zeros((BANDS, len(held)), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
        for r in range(BAND_ROWS):
            key = mix64(key * _STEP[0] + sig[:, r])
        keys = key.T
    off = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))
    cols = [batch.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "fp1", "fp2", "bands"])


def _bitmaps(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 16 longs per set, with the bits that its shingles' top ten bits name; s is sorted within a set."""
    out = np.zeros((len(at) - 1) * 16, np.uint64)
    word = np.repeat(np.arange(len(at) - 1), np.diff(at)) * 16 + (s >> np.uint64(60)).astype(np.int64)
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << ((s >> np.uint64(54)) & np.uint64(63)), first)
    return out


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    s, at = shingle_sets(batch.column("text"))
    raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(s))])
    bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * 16), pa.array(_bitmaps(s, at).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), raw.cast(pa.binary()), bits], ["doc_id", "shingles", "bits"])


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        both = np.sort(np.concatenate([x, y]), kind="stable")
        n = int(np.count_nonzero(both[1:] == both[:-1]))
        keep.append(100 * n >= PERCENT * (len(x) + len(y) - n))
    return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a written table) whose full sets are similar enough."""
    few = small(pairs, pairs.count())
    sa, sb = (few.join(sets, F.col(x) == F.col("doc_id")).select("a", "b", F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = sa.join(sb, ["a", "b"])
    return scratch.save(both.mapInArrow(lambda batches: map(_linked, batches), "a long, b long"))


def near_links(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, comp): a row per document with its set's size and its class's
    representative, and (node, comp) of the representatives that have a link."""
    sketch = scratch.save(
        arrow_map(docs.select("doc_id", "text"), _sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")
    )
    classes = scratch.save(
        sketch.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    rows = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / RANKED))
    rank = Window.partitionBy("bucket", salt).orderBy("rep")
    members = scratch.save(rows.join(many, "bucket").select("bucket", "rep", "n", (F.row_number().over(rank) - 1).alias("rank")))
    wanted = scratch.save(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = scratch.save(
        arrow_map(
            docs.select("doc_id", "text").join(small(wanted, wanted.count()), "doc_id", "left_semi"), _sets, "doc_id long, shingles binary, bits array<long>"
        )
    )
    scratch.sweep()
    last = members.agg(F.max("rank")).first()[0]
    classed = sketch.join(classes.drop("bands"), ["fp1", "fp2", "n_shingles"], "left")
    active, low, width, once, comp = members.withColumn("comp", F.col("rep")), 0, 1, "", None
    while last is not None and low <= last:
        later = F.expr("(m.rank > p.rank or (m.rank = p.rank and m.rep > p.rep))")
        near = F.expr(
            f"p.bucket = m.bucket and p.comp <> m.comp and 100 * least(p.n, m.n) >= {PERCENT} * greatest(p.n, m.n){once}"
        )
        pivots = active.where((F.col("rank") >= low) & (F.col("rank") < low + width)).alias("p")
        pairs = pivots.join(active.alias("m"), near & later).select(F.expr("least(p.rep, m.rep)").alias("a"), F.expr("greatest(p.rep, m.rep)").alias("b"))
        found = _verify(scratch.save(pairs.distinct()), sets, scratch)
        comp = merge_components(comp, found, scratch)
        low, width = low + width, width * 16
        if low > last:
            break
        now = active.drop("comp").join(small(comp, comp.count()), active.rep == comp.node, "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")
        open_ = now.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.when(F.col("rank") >= low, 1)).alias("left"))
        active = now.join(open_.where("x <> y and left > 1").select("bucket"), "bucket", "left_semi")
        if not once:
            active = active.join(sets.select(F.col("doc_id").alias("rep"), *[F.col("bits")[i].alias(f"b{i}") for i in range(16)]), "rep")
            # a pair is made only if the bitmaps leave enough to share; few columns, so that the JVM still compiles the join
            lacks = lambda x, y: " + ".join(f"bit_count({x}.b{i} & ~{y}.b{i})" for i in range(16))
            most = f"least(p.n - ({lacks('p', 'm')}), m.n - ({lacks('m', 'p')}))"
            once = f" and {100 + PERCENT} * {most} >= {PERCENT} * (p.n + m.n)"
        active = scratch.save(active)
        last = active.agg(F.max("rank")).first()[0]
    # rows of one doc_id are one document: its classes are linked, as a star
    stars = classed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    stars = scratch.save(stars.where("a <> b").select("doc_id", "a"))
    if n := stars.count():
        own = classed.where("rep is not null").join(small(stars, n), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
        comp = merge_components(comp, own, scratch)
    if comp is None:
        comp = docs.sparkSession.createDataFrame([], "node long, comp long")
    return classed, comp


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, comp = near_links(docs, scratch)
    out = rows.join(comp, rows.rep == comp.node, "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; of rows that repeat a doc_id all stay or go together."""
    gone = Scratch(docs.sparkSession, "minhash-drop").save(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
