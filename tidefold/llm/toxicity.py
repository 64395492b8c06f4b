"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (A-Z lower-cased) is input as its own embedding, if it
is in the vocabulary, beside the mean embedding of its character trigrams (by bytes). Over
windows of WINDOW words, a new one every STRIDE words and the last one ending with the text, two GRUs
run forwards and backwards; an attention vector weighs their states, and a
logistic unit on the pooled state scores the window. All windows of the whole text are scored and the
text's score is the highest one's.

Training: a bounded sample of labelled rows (at most TOXIC of label 1 and CLEAN of
label 0, chosen by a hash of doc_id) from the rows that are not held out. The vocabulary is
the sample's words in at least MIN_TEXTS texts. Each text's highest window carries its loss
(multiple instances: one insult makes a long text toxic), with gradients worked out by hand and Adam
steps. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and wordless texts score as an empty window, with the bias alone; without
any label of both kinds every score is 0; repeated rows each get their row; conflicting labels of a doc_id: the greater.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, ALNUM, Scratch, arrow_map, buffers, mix64, private, range_hash, small, tokenise

WINDOW, STRIDE = 64, 48
#: Most rows of label 1 and of label 0 that a model is trained on.
TOXIC, CLEAN = 800, 1600
MIN_TEXTS, WORD_DIM, CHAR_DIM, CHARS, HIDDEN = 4, 8, 8, 4096, 8
#: Passes over the sample, and the least steps in all, which small samples need.
EPOCHS, STEPS, BATCH, RATE, SEED = 5, 150, 64, 0.01, 5
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Words:
    """The distinct words of some texts: hashes, their trigrams, and the texts as numbers of distinct words."""

    def __init__(self, texts: pa.Array):
        data, off = buffers(texts)
        data = _LOWER[data]
        starts, ends, self.first = tokenise(data, off, ALNUM)
        h = range_hash(data, starts, ends)
        self.hash, at, ids = np.unique(h, return_index=True, return_inverse=True)
        self.ids = ids.astype(np.int32)
        size = np.maximum(ends[at] - starts[at] - 2, 0)
        self.tri_first = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(starts[at] - self.tri_first[:-1], size) + np.arange(self.tri_first[-1])
        b = data.astype(np.uint64)
        code = b[place] | (b[place + 1] << np.uint64(8)) | (b[place + 2] << np.uint64(16))
        self.tri = (mix64(code) % np.uint64(CHARS)).astype(np.int32)

    def only(self, ids: np.ndarray) -> Words:
        """The same texts with the distinct words `ids` alone; their numbers are places in ids."""
        out = object.__new__(Words)
        size = np.diff(self.tri_first)[ids]
        out.hash, out.tri_first = self.hash[ids], np.concatenate([[0], np.cumsum(size)])
        out.tri = self.tri[np.repeat(self.tri_first[ids] - out.tri_first[:-1], size) + np.arange(out.tri_first[-1])]
        return out

    def char_mean(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.hash), table.shape[1]), np.float32)
        n = np.diff(self.tri_first)
        held = np.flatnonzero(n)
        if len(held):
            out[held] = np.add.reduceat(table[self.tri], self.tri_first[:-1][held], axis=0) / n[held][:, None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, words) of every window; a text without words has one empty window."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(k * STRIDE, np.maximum(0, n[text] - WINDOW))
        return text, self.first[:-1][text] + start, np.minimum(WINDOW, n[text])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Net:
    """Parameters: E words (row 0: unknown, fixed at 0), C characters, W, U, b of both directions, a attention, v and c output."""

    def __init__(self, vocab: np.ndarray, lift: np.ndarray):
        rng = np.random.default_rng(SEED)
        f = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
        self.vocab = vocab
        e = f(len(vocab) + 1, WORD_DIM, by=0.05)
        e[0], e[1:, 0] = 0, lift
        d = WORD_DIM + CHAR_DIM
        self.p = {
            "E": e, "C": f(CHARS, CHAR_DIM, by=0.05), "W": f(2, d, 3 * HIDDEN), "U": f(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "a": f(2 * HIDDEN), "v": f(2 * HIDDEN), "c": np.full(1, -1.0, np.float32),
        }

    def word_rows(self, words: Words) -> np.ndarray:
        at = np.searchsorted(self.vocab, words.hash)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == words.hash, at + 1, 0) if len(self.vocab) else np.zeros(len(words.hash), int)

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        rows = self.word_rows(words)
        return np.concatenate([self.p["E"][rows], words.char_mean(self.p["C"])], axis=1), rows

    def forward(self, proj: np.ndarray, ids: np.ndarray, n: np.ndarray, keep: bool = False):
        """Logits of windows ids (window, WINDOW) of n words each; proj (2, words, 3H) are projected inputs."""
        m, steps = len(ids), int(n.max(initial=0))
        mask = np.arange(steps)[:, None] < n[None, :]
        full, h = bool(mask.all()), np.zeros((2, m, HIDDEN), np.float32)
        states, saved, u = np.zeros((2, steps, m, HIDDEN), np.float32), [], self.p["U"]
        for t in range(steps):
            places = t, steps - 1 - t
            x = np.stack([proj[0][ids[:, places[0]]], proj[1][ids[:, places[1]]]])
            g = h @ u
            zr = _sigmoid(x[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            gn = g[..., 2 * HIDDEN :]
            cand = np.tanh(x[..., 2 * HIDDEN :] + r * gn)
            new = cand + z * (h - cand)
            if not full:
                on = np.stack([mask[p] for p in places])[..., None]
                new = np.where(on, new, h)
            if keep:
                saved.append((places, h, z, r, gn, cand))
            h = new
            for d in (0, 1):
                states[d, places[d]] = h[d]
        both = np.concatenate([states[0], states[1]], axis=-1)
        score = both @ self.p["a"]
        if not full:
            score = np.where(mask, score, -1e9)
        w = np.exp(score - score.max(axis=0, initial=-1e9)) * mask if steps else np.zeros((0, m), np.float32)
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pool = np.einsum("tm,tmh->mh", w, both)
        logit = pool @ self.p["v"] + self.p["c"][0]
        return (logit, (mask, saved, both, w, pool)) if keep else logit

    def backward(self, cache, x: np.ndarray, ids: np.ndarray, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all parameters but E and C, and of the inputs x[ids] (window, step, dim)."""
        mask, saved, both, w, pool = cache  # noqa: F841
        p, g = self.p, {}
        g["c"], g["v"] = np.array([d_logit.sum()], np.float32), pool.T @ d_logit
        d_pool = d_logit[:, None] * p["v"]
        dw = np.einsum("mh,tmh->tm", d_pool, both)
        ds = w * (dw - (w * dw).sum(axis=0))
        g["a"] = np.einsum("tm,tmh->h", ds, both)
        d_both = w[..., None] * d_pool + ds[..., None] * p["a"]
        g["W"], g["U"], g["b"] = np.zeros_like(p["W"]), np.zeros_like(p["U"]), np.zeros_like(p["b"])
        dx = np.zeros((len(ids), len(mask), x.shape[1]), np.float32)
        dh = np.zeros((2, len(ids), HIDDEN), np.float32)
        for places, h, z, r, gn, cand in reversed(saved):
            dh = dh + np.stack([d_both[places[d], :, d * HIDDEN : (d + 1) * HIDDEN] for d in (0, 1)])
            on = np.stack([mask[q] for q in places])[..., None]
            dn = np.where(on, dh, 0)
            d_cand = dn * (1 - z) * (1 - cand * cand)
            d_z = dn * (h - cand) * z * (1 - z)
            d_r = d_cand * gn * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_cand], axis=-1)
            d_rec = np.concatenate([d_z, d_r, d_cand * r], axis=-1)
            g["U"] += h.transpose(0, 2, 1) @ d_rec
            g["b"] += d_in.sum(axis=1, keepdims=True)
            for d in (0, 1):
                own = x[ids[:, places[d]]]
                g["W"][d] += own.T @ d_in[d]
                dx[:, places[d]] += d_in[d] @ p["W"][d].T
            dh = np.where(on, dn * z, dh) + d_rec @ p["U"].transpose(0, 2, 1)
        return g, dx

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["W"] + self.p["b"]

    def logits(self, words: Words) -> np.ndarray:
        """The highest window's logit of each text."""
        x, _ = self.inputs(words)
        text, start, n = words.windows()
        proj, out = self.project(x), np.empty(len(text), np.float32)
        ids = np.concatenate([words.ids, np.zeros(WINDOW, np.int32)]) if len(x) else None
        order = np.argsort(n, kind="stable")  # full windows together need no mask
        for at in range(0, len(order), 1024):
            own = order[at : at + 1024]
            if len(x):
                out[own] = self.forward(proj, ids[start[own][:, None] + np.arange(WINDOW)], n[own])
            else:
                out[own] = self.p["c"][0]
        return np.maximum.reduceat(out, np.searchsorted(text, np.arange(len(words.first) - 1)))


def train(texts: list[str | None], labels: np.ndarray) -> Net | None:
    """A network fitted to texts with labels 0 and 1; None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    words = Words(pa.array(texts, pa.string()))
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    seen = np.unique(words.ids.astype(np.int64) * len(texts) + text_of)
    word, text = seen // len(texts), seen % len(texts)
    df = np.bincount(word, minlength=len(words.hash))
    tox = np.bincount(word, weights=labels[text], minlength=len(words.hash))
    kept = df >= MIN_TEXTS
    n1 = labels.sum()
    lift = np.log((tox + 0.5) / (n1 + 1)) - np.log((df - tox + 0.5) / (len(labels) - n1 + 1))
    net = Net(words.hash[kept], np.clip(lift[kept] / 2, -0.5, 2).astype(np.float32))
    doc, start, n = words.windows()
    ids = np.concatenate([words.ids, np.zeros(WINDOW, np.int32)])
    lo = np.searchsorted(doc, np.arange(len(texts) + 1))
    rng, mean, sq, turn = np.random.default_rng(SEED), {}, {}, 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):
        every = rng.permutation(len(texts))
        for at in range(0, len(every), BATCH):
            batch = every[at : at + BATCH]
            own = np.concatenate([np.arange(lo[i], lo[i + 1]) for i in batch])
            used, seq = np.unique(ids[start[own][:, None] + np.arange(WINDOW)], return_inverse=True)
            here = words.only(used)
            x, rows = net.inputs(here)
            proj, seq = net.project(x), seq.reshape(len(own), WINDOW)
            scores = np.concatenate([net.forward(proj, seq[o], n[own[o]]) for o in np.array_split(np.arange(len(own)), max(1, len(own) // 1024))])
            size = lo[batch + 1] - lo[batch]
            first = np.cumsum(size) - size
            best = np.array([f + int(np.argmax(scores[f : f + s])) for f, s in zip(first, size, strict=True)])
            seq = seq[best]
            logit, cache = net.forward(proj, seq, n[own[best]], keep=True)
            d = ((1 / (1 + np.exp(-logit)) - labels[batch]) / len(batch)).astype(np.float32)
            g, dx = net.backward(cache, x, seq, d)
            flat, dx = seq[:, : dx.shape[1]].reshape(-1), dx.reshape(-1, x.shape[1])
            per = np.zeros((len(used), x.shape[1]), np.float32)
            np.add.at(per, flat, dx)
            g["E"] = np.zeros_like(net.p["E"])
            np.add.at(g["E"], rows, per[:, :WORD_DIM])
            g["E"][0] = 0
            hit = np.unique(flat)
            count = np.diff(here.tri_first)[hit]
            place = np.repeat(here.tri_first[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            g["C"] = np.zeros_like(net.p["C"])
            np.add.at(g["C"], here.tri[place], np.repeat(per[hit, WORD_DIM:] / np.maximum(count, 1)[:, None], count, axis=0))
            turn += 1
            for k, v in g.items():
                v = v + 1e-5 * net.p[k]
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * v
                sq[k] = 0.99 * sq.get(k, 0) + 0.01 * v * v
                net.p[k] = net.p[k] - (RATE * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(sq[k] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
            net.p["E"][0] = 0
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Net | None:
    """A network from the bounded sample of labelled rows that are not held out."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda v, most: rows.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(1, TOXIC).union(pick(0, CLEAN))
    scratch = Scratch(docs.sparkSession, "sample")
    sample = scratch.save(docs.select("doc_id", "text").join(small(chosen, TOXIC + CLEAN), "doc_id"))
    found = sample.coalesce(1).mapInArrow(_trained, "net binary").collect()
    scratch.drop(sample)
    return pickle.loads(found[0].net) if found else None


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The network of all rows (doc_id, text, toxic), pickled: trained in a task, as the driver's memory is small."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    net = train([r[1] for r in rows], np.array([r[2] for r in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def _scored(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, h, score) per row of docs(doc_id, text); h tells texts apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        x = np.zeros(len(texts)) if net is None else 1 / (1 + np.exp(-net.logits(Words(texts)).astype(np.float64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.round(x, 6))], ["doc_id", "h", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return Scratch(docs.sparkSession, "toxicity").save(arrow_map(rows, run, "doc_id long, h long, score double"))


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score and predicted."""
    rows = _scored(docs, net)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose own text the network trained on them and labels rejects, also where doc_id is null or repeated."""
    id2, h2 = private(docs, "id2", "h2")
    bad = _scored(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias(id2), F.col("h").alias(h2)).distinct()
    bad = Scratch(docs.sparkSession, "toxic").save(bad)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id2)) & (F.xxhash64("text") == F.col(h2))
    return docs.join(small(bad, bad.count()), same, "left_anti")
