"""Quality by an interpolated modified Kneser-Ney model of trusted text, of trigrams or bigrams (`order`).

Words are `[^\\x20\\x09-\\x0D]+` as written. Trusted text is the text of documents labelled
quality 1, all of it, and the vocabulary is all its words (VOCAB may limit it to the most frequent ones); others are one unknown word, whose
probability is shared among as many words as trusted text has outside the vocabulary. A text
begins after start marks. With counts c of the n-grams, the three discounts D from the counts of counts, and g(v) the mass that
they free in context v, p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p'(w), where p' is the same over contexts shorter by a word, with the
number of different words before an n-gram in place of its count, and the shortest is interpolated with the uniform distribution. A trusted text is
scored without its own occurrences of the longest n-grams (the totals of their contexts and the shorter n-grams still count it, so that trusted
perplexities, and with them the thresholds, are a little low). Perplexity is exp(-log p / words); a document is kept if it is at
most its language's QUANTILE of trusted documents (of all documents, where a language has none).

Method. Words, contexts and n-grams are 64-bit hashes. Counts are sharded by n-gram: Python tasks count what they read in bounded tables, Spark
adds the counts up by key, and continuation counts, contexts and the probabilities of shorter n-grams are joined to them by key. A log probability
is a sum over the keys of a word, its contexts and its n-grams: log q(w), log g of each context, and the gain of each n-gram that was seen over its
shorter one. Where a document is read, the HOT most frequent keys (a bounded table) are looked up in place; its other keys, counted per document,
are joined with the values by key and added up by document. Nothing but the hot keys is broadcast or collected.
Language quantiles come from exact counts of log perplexities in steps of 0.001.

Defined cases: null and wordless texts have no perplexity and are not kept; rows that repeat a doc_id are one document, rows without one are a document each; a null lang is a language;
without trusted text every word is unknown; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, buffers, mix64, range_hash, slices, small, tokenise

#: Words of the vocabulary (None: all), keys that are broadcast, the share of trusted documents that is kept.
VOCAB: int | None = None
HOT, QUANTILE = 500_000, 0.99
#: Stand-ins for the hashes of the unknown word and the start mark.
UNKNOWN, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Entries of a task's table of counts before it is passed on.
TABLE = 2_000_000


def raw_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(texts)
    starts, ends, first = tokenise(data, off, NOT_SPACE)
    return range_hash(data, starts, ends), first


def ngrams(texts: pa.Array, vocab: np.ndarray | None, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each word: the keys of its n-grams up to order, and those of the n-grams that end right before it; and each text's first word."""
    w, first = raw_words(texts)
    if vocab is not None:
        at = np.minimum(np.searchsorted(vocab, w), max(len(vocab) - 1, 0))
        w = np.where(vocab[at] == w, w, UNKNOWN) if len(vocab) else np.full(len(w), UNKNOWN)
    begin = first[:-1][np.diff(first) > 0]
    own, before, mark = [mix64(w)], [], mix64(START.reshape(1))[0]
    for n in range(1, order):
        last = np.empty_like(w)
        last[1:] = own[-1][:-1]
        last[begin] = mark
        before.append(last)
        own.append(mix64(last * _ODD + own[0] + np.uint64(n)))
        mark = mix64((mark * _ODD + mix64(START.reshape(1))[0] + np.uint64(n)).reshape(1))[0]
    return own, before, first


def _rows(order: int, vocab: np.ndarray | None):
    """Of texts: the longest n-grams, their contexts, what is left without the first word, and for order 3 that one's context and last word."""

    def run(texts: pa.Array) -> list[np.ndarray]:
        own, before, _ = ngrams(texts, vocab, order)
        return [own[-1], before[-1], own[-2], before[0], own[0]]

    return run


def _counted(docs: DataFrame, keys, scratch: Scratch, names: tuple[str, ...] = ("key",)) -> DataFrame:
    """(*names, c): how often keys(texts), arrays of which the first decides the others, has each key over all docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            _, at, inv = np.unique(cols[0], return_index=True, return_inverse=True)
            return [x[at] for x in cols[:-1]] + [np.bincount(inv, weights=cols[-1], minlength=len(at)).astype(np.int64)]

        def batched(cols):
            for at in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].view(np.int64)) for x in cols], [*names, "c"])

        for batch in batches:
            for piece in slices(batch, "text"):
                cols = keys(piece.column("text"))
                _, at, n = np.unique(cols[0], return_index=True, return_counts=True)
                held.append([x[at] for x in cols] + [n.astype(np.int64)])
                size += len(at)
                if size > TABLE:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > TABLE // 2:
                        yield from batched(held[0])
                        held, size = [], 0
        if held:
            yield from batched(merged())

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "c"]))
    return scratch.save(rows.groupBy("key").agg(*(F.first(c).alias(c) for c in names[1:]), F.sum("c").alias("c")))


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of keys that occur 1, 2, 3 and 4 times; fixed ones where a number is 0."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def _cut(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c <= 0, c.cast("double")).when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    return discounts({r.c: r.n for r in counts.groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n")).collect()})


def values(trusted: DataFrame, order: int, scratch: Scratch) -> tuple[DataFrame, tuple[float, float, float], float, np.ndarray | None]:
    """(key, c, x, y) of all keys of trusted(text); the longest n-grams' discounts; the unknown word's log probability; and the vocabulary, if limited.

    A document's log probability adds x for each time a key is a word or n-gram and y for each time it is a context. Only the
    longest n-grams have c, their counts: for them x is what c less its discount is multiplied by within log1p.
    """
    vocab, others = None, 1
    if VOCAB is not None:
        words = _counted(trusted, lambda texts: [raw_words(texts)[0]], scratch)
        top = words.orderBy(F.col("c").desc(), "key").limit(VOCAB).select("key").collect()
        vocab = np.sort(np.array([r.key for r in top], np.int64).view(np.uint64))
        others = max(1, words.count() - len(vocab))
        scratch.drop(words)
    counts = {order: _counted(trusted, _rows(order, vocab), scratch, ("key", "ctx", "low", "ctx2", "low2"))}
    if order == 3:
        shorter = counts[3].groupBy(F.col("low").alias("key")).agg(F.first("ctx2").alias("ctx"), F.first("low2").alias("low"), F.count("*").alias("c"))
        counts[2] = scratch.save(shorter)
    words = scratch.save(counts[2].groupBy(F.col("low").alias("key")).agg(F.count("*").alias("c")))
    d = _discounts(words)
    n, whole, cut = words.agg(F.count("*"), F.sum("c"), F.sum(_cut(F.col("c"), d))).first()
    rest = (cut / whole if whole else 1.0) / ((n if vocab is None else len(vocab)) + 1)
    prob = words.select("key", ((F.col("c") - _cut(F.col("c"), d)) / F.lit(whole or 1) + F.lit(rest)).alias("p"))
    unknown = int(mix64(UNKNOWN.reshape(1)).view(np.int64)[0])
    seen = prob.select("key", (F.log(F.col("p") / F.lit(rest)) - F.when(F.col("key") == unknown, F.lit(float(np.log(others)))).otherwise(0.0)).alias("x"))
    out = None
    for level in range(2, order + 1):
        d = _discounts(counts[level])
        c = F.col("c")
        free = counts[level].groupBy(F.col("ctx").alias("of")).agg(F.sum("c").alias("total"), (F.sum(_cut(c, d)) / F.sum("c")).alias("free"))
        free = scratch.save(free)
        part = seen.join(free.select("of", F.log("free").alias("y")), F.col("key") == F.col("of"), "full")
        part = part.select(F.coalesce("key", "of").alias("key"), F.lit(None).cast("long").alias("c"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
        out = part if out is None else out.union(part)
        rows = counts[level].join(free, F.col("ctx") == F.col("of")).join(prob.withColumnRenamed("key", "key2"), F.col("low") == F.col("key2"))
        rows = rows.select("key", "c", "total", ((c - _cut(c, d)) / F.col("total")).alias("a"), (F.col("free") * F.col("p")).alias("base"))
        if level < order:
            rows = scratch.save(rows.select("key", F.log1p(F.col("a") / F.col("base")).alias("x"), (F.col("a") + F.col("base")).alias("p")))
            seen, prob = rows.select("key", "x"), rows.select("key", "p")
    out = out.union(rows.select("key", "c", (1 / (F.col("total") * F.col("base"))).alias("x"), F.lit(0.0).alias("y")))
    return scratch.save(out), d, float(np.log(rest)), vocab


class Model:
    """What is looked up where a document is read: the hot keys with c (0: none), x and y."""

    def __init__(self, order: int, d: tuple[float, float, float], unknown: float, vocab: np.ndarray | None, hot: pa.Table):
        self.order, self.d, self.unknown, self.vocab = order, d, unknown, vocab
        self.key, self.c, self.x, self.y = (hot.column(c).to_numpy() for c in ("key", "c", "x", "y"))
        by = np.argsort(self.key)
        self.key, self.c, self.x, self.y = self.key[by], self.c[by], self.x[by], self.y[by]

    def part(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What hot keys at those places add, a times as words or n-grams and b times as contexts."""
        c = self.c[at] - own
        cut = np.select([c <= 0, c == 1, c == 2], [0, self.d[0], self.d[1]], self.d[2])
        return a * np.where(self.c[at] > 0, np.log1p(np.maximum(c - cut, 0) * self.x[at]), self.x[at]) + b * self.y[at]


def _parts(model, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per document: words, log probability so far, and the keys still to be looked up with their numbers."""
    m = model.value
    grams, before, first = ngrams(batch.column("text"), m.vocab, m.order)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    key = np.concatenate([*grams, *before])
    text = np.tile(text, len(grams) + len(before))
    salted = key ^ mix64(text.astype(np.uint64) + np.uint64(1))
    _, at, inv = np.unique(salted, return_index=True, return_inverse=True)
    split = len(grams) * int(first[-1])
    a, b = (np.bincount(x, minlength=len(at)) for x in (inv[:split], inv[split:]))
    by = np.argsort(text[at], kind="stable")
    text, key, a, b = text[at][by], key[at][by].view(np.int64), a[by], b[by]
    place = np.minimum(np.searchsorted(m.key, key), max(len(m.key) - 1, 0))
    hot = m.key[place] == key if len(m.key) else np.zeros(len(key), bool)
    own = np.where(batch.column("trusted").to_numpy(zero_copy_only=False)[text], a, 0)
    total = n * m.unknown + np.bincount(text[hot], weights=m.part(place[hot], a[hot], b[hot], own[hot]), minlength=len(n))
    rest = ~hot
    off = np.concatenate([[0], np.cumsum(np.bincount(text[rest], minlength=len(n)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x[rest], t)) for x, t in ((key, pa.int64()), (a, pa.int32()), (b, pa.int32()))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "lang", "trusted")), pa.array(n), pa.array(total), *lists], ["doc_id", "row", "lang", "trusted", "n", "log", "keys", "a", "b"])


def perplexities(docs: DataFrame, labels: DataFrame, scratch: Scratch, order: int = 2) -> DataFrame:
    """(doc_id, lang, trusted, n_words, log_prob) per document."""
    spark = docs.sparkSession
    good = scratch.save(labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("long").alias("id2")))
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # a row without an id is a document of its own
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), alone.alias("row"), "lang", "text")
    rows = rows.join(small(good, good.count()), F.col("doc_id") == F.col("id2"), "left")
    rows = rows.select("doc_id", "row", "lang", "text", F.col("id2").isNotNull().alias("trusted"))
    table, d, unknown, vocab = values(rows.where("trusted"), order, scratch)
    # what words and contexts add is looked up most: they stand first, then n-grams from the least count such that at most HOT keys are held
    left, least, step = HOT, 1, F.coalesce("c", F.lit(10_000))
    for r in table.groupBy(F.least(step, F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).collect():
        left -= r.n
        if left < 0:
            least = r.c + 1
            break
    hot = table.where(step >= least) if least <= 10_000 else table.limit(0)
    model = Model(order, d, unknown, vocab, hot.select("key", F.coalesce("c", F.lit(0)).alias("c"), "x", "y").toArrow())
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield _parts(sent, piece)

    schema = "doc_id long, row long, lang string, trusted boolean, n long, log double, keys array<long>, a array<int>, b array<int>"
    parts = scratch.save(rows.select("doc_id", "row", "lang", "trusted", "text").mapInArrow(run, schema))
    rest = parts.select("doc_id", "row", "trusted", F.explode(F.arrays_zip("keys", "a", "b")).alias("e")).select("doc_id", "row", "trusted", "e.keys", "e.a", "e.b")
    joined = rest.join(table.where(step < least), F.col("keys") == F.col("key"))
    c = F.col("c") - F.when(F.col("trusted"), F.col("a")).otherwise(0)
    gain = F.when(F.col("c").isNull(), F.col("x")).otherwise(F.log1p(F.greatest(c - _cut(c, d), F.lit(0.0)) * F.col("x")))
    gains = joined.groupBy("doc_id", "row").agg(F.sum(F.col("a") * gain + F.col("b") * F.col("y")).alias("gain"))
    base = parts.groupBy("doc_id", "row").agg(F.min("lang").alias("lang"), F.max("trusted").alias("trusted"), F.sum("n").alias("n_words"), F.sum("log").alias("log"))
    gains = gains.withColumnsRenamed({"doc_id": "id2", "row": "row2"})
    both = base.join(gains, F.col("doc_id").eqNullSafe(F.col("id2")) & F.col("row").eqNullSafe(F.col("row2")), "left")
    return scratch.save(both.select("doc_id", "lang", "trusted", "n_words", (F.col("log") + F.coalesce("gain", F.lit(0.0))).alias("log_prob")))


def quantile(rows: DataFrame, value: Column, q: float) -> DataFrame:
    """(lang2, cut): the least value that a share q of a language's rows do not exceed, from counts by value."""
    from pyspark.sql import Window

    n = rows.groupBy("lang", value.alias("value")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang").orderBy("value")
    n = n.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("lang"))})
    return n.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(q))).groupBy(F.col("lang").alias("lang2")).agg(F.min("value").alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, q: float = QUANTILE, order: int = 2) -> DataFrame:
    """One row per doc_id of docs(doc_id, lang, text): n_words, perplexity (6 decimals of its logarithm), threshold and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = perplexities(docs, labels, scratch, order)
    rows = rows.withColumn("step", F.when(F.col("n_words") > 0, F.round(-1000 * F.col("log_prob") / F.col("n_words")).cast("long")))
    scored = rows.where("step is not null")
    best = quantile(scored.where("trusted"), F.col("step"), q)
    every = quantile(scored, F.col("step"), q).withColumnsRenamed({"lang2": "lang3", "cut": "cut3"})
    cuts = scratch.save(every.join(best, F.col("lang2").eqNullSafe(F.col("lang3")), "left").select("lang3", F.coalesce("cut", "cut3").alias("cut")))
    out = rows.join(small(cuts, cuts.count()), F.col("lang").eqNullSafe(F.col("lang3")), "left")
    return out.select(
        "doc_id", "lang", "n_words", F.exp(F.col("step") / 1000).alias("perplexity"), F.exp(F.col("cut") / 1000).alias("threshold"),
        F.coalesce(F.col("step") <= F.col("cut"), F.lit(False)).alias("kept"),
    )
