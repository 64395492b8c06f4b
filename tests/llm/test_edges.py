"""Repeated and missing ids, clashing columns, extreme numbers; the toxicity score against a plain loop; a whole secret scan against a plain one."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.llm import common, decontaminate, minhash, quality, secrets, topk, toxicity, urls


def test_near_duplicates_join_the_classes_of_one_id(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, say("a")), (2, say("b")), (5, say("a")), (5, say("b")), (7, say("c")), (None, say("a"))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (7, 7), (None, None)}


def test_clashing_columns_pass_through(spark):
    pages = spark.createDataFrame([(1, "http://A.com/x?utm_x=1", 7, 8), (2, "http://a.com/x", 9, 10), (3, None, 1, 2)], "page_id long, url string, hit int, _hit int")
    out = {r.page_id: r for r in urls.filter_urls(pages, urls.tracked(pages)).collect()}
    assert (out[1].hit, out[2]._hit) == (7, 10) and [out[i].verdict for i in (1, 2, 3)] == ["block", "block", "allow"]
    docs = spark.createDataFrame([(1, "one two three", 5, 6), (2, "four five", 7, 8), (None, None, 1, 2)], "doc_id long, text string, _id2 int, _h2 int")
    items = spark.createDataFrame([(1, "Two three")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [(None, None, 1, 2), (2, "four five", 7, 8)]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_index_keeps_exact_letters(spark):
    """The index folds all letters, the comparison A-Z alone."""
    docs = spark.createDataFrame([(1, "État UN deux"), (2, "état un deux"), (3, "Kelvin un deux"), (4, "kelvin un deux")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "état un deux"), (2, "Kelvin Un deux")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.judged(docs, items).collect()}
    assert got == {1: (0, 0), 2: (3, 1), 3: (3, 1), 4: (0, 0)}


def test_many_alignments_of_a_repetitive_item(spark):
    docs = spark.createDataFrame([(1, "the " * 3000 + "end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the " * 15), (2, "the the end")], "item_id long, text string")
    r = decontaminate.judged(docs, items).first()
    assert (r.n_words, r.n_hit, r.n_items) == (3001, 3001, 2)


def test_top_k_of_extreme_numbers_and_repeated_queries(spark):
    rows = [(0, [1e300, 1.0]), (0, [0.5, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, two = (sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") == 0, 5).collect()) for d in (df, df.orderBy(F.desc("vec_id"))))
    # the least vector of id 0 asks
    v = {i: [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in e] for i, e in rows if i}
    scores = {i: min(max(512 * e[0] + 1024 * e[1], -(1 << 63)), (1 << 63) - 1) for i, e in v.items()}
    assert one == two == [(0, k + 1, i, s) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0])))]


def test_quality_keeps_rows_without_id_apart(spark):
    docs = spark.createDataFrame([(None, "en", "a b"), (None, "en", "c d e f"), (1, "en", "a b c a b")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sorted((r.doc_id or 0, r.n_words) for r in quality.judge(docs, labels, order=3).collect()) == [(0, 2), (0, 4), (1, 5)]


def test_toxicity_score_against_a_plain_loop():
    """The network's forward pass, unit by unit, for every window of every text."""
    rng = random.Random(4)
    say = lambda n, bad: " ".join(rng.choice(["vile", "hate"] if bad and rng.random() < 0.3 else ["kind", "day", "sun", "über"]) for _ in range(n))
    texts = [say(rng.randint(1, 30), i % 2) for i in range(60)]
    net = toxicity.train(texts, np.array([i % 2 for i in range(60)]))
    asked = ["", "vile", say(7, True), say(toxicity.WINDOW * 3 + 5, True), None]
    got = net.logits(toxicity.Words(pa.array(asked, pa.string())))
    p, hid = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))

    def window(x):
        states = [[None] * len(x), [None] * len(x)]
        for d in (0, 1):
            h = [0.0] * hid
            for t in range(len(x)) if d == 0 else reversed(range(len(x))):
                i = [sum(x[t][k] * p["W"][d][k][j] for k in range(len(x[t]))) + p["b"][d][0][j] for j in range(3 * hid)]
                g = [sum(h[k] * p["U"][d][k][j] for k in range(hid)) for j in range(3 * hid)]
                z, r = ([sig(i[o + j] + g[o + j]) for j in range(hid)] for o in (0, hid))
                c = [math.tanh(i[2 * hid + j] + r[j] * g[2 * hid + j]) for j in range(hid)]
                h = [c[j] + z[j] * (h[j] - c[j]) for j in range(hid)]
                states[d][t] = h
        both = [a + b for a, b in zip(*states, strict=True)]
        score = [sum(a * b for a, b in zip(s, p["a"], strict=True)) for s in both]
        w = [math.exp(s - max(score)) for s in score]
        pool = [sum(wt * s[j] for wt, s in zip(w, both, strict=True)) / sum(w) for j in range(2 * hid)] if both else [0.0] * (2 * hid)
        return sum(a * b for a, b in zip(pool, p["v"], strict=True)) + p["c"][0]

    for text, logit in zip(asked, got, strict=True):
        words = toxicity.Words(pa.array([text], pa.string()))
        x, _ = net.inputs(words)
        rows = [x[i].astype(float).tolist() for i in words.ids]
        n = len(rows)
        starts = sorted({min(k * toxicity.STRIDE, max(0, n - toxicity.WINDOW)) for k in range(max(1, -(-(n - toxicity.WINDOW) // toxicity.STRIDE) + 1))})
        assert logit == pytest.approx(max(window(rows[s : s + toxicity.WINDOW]) for s in starts), abs=2e-3)


def test_whole_secret_scan_against_a_plain_one(spark):
    """Counts, digest and all spans of random texts, by a scan that looks at each character."""
    rng = random.Random(6)
    alpha = "abcdefghijklmnopqrstuvwxyz"

    def token(n, chars):
        return "".join(rng.choice(chars) for _ in range(n))

    def piece():
        return rng.choice([
            lambda: rng.choice(["password", "Passwd", "SECRET", "token", "api_key", "apikey"]) + rng.choice(["", '"', "'"]) + rng.choice(["=", " : ", ":", " "]) + rng.choice(["", "'"]) + token(rng.randint(5, 14), alpha + "09+/_.=-"),
            lambda: "AKIA" + token(rng.randint(8, 18), "ABC012"), lambda: token(rng.randint(28, 40), "0123456789abcdef"), lambda: token(rng.randint(10, 40), alpha + alpha.upper() + "0123456789"),
            lambda: token(rng.randint(1, 9), alpha + "ü\U0001f600"), lambda: "read-me_first/now", lambda: "00000000000000000000", lambda: "\n",
        ])()

    texts = [rng.choice([" ", "", "; "]).join(piece() for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None]

    def plain(t):
        t = t or ""
        out = []
        for kind, rx, least, part in (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)):
            out += [(m.start(), m.end(), kind) for m in re.finditer(rx, t) if len(m[part]) >= least]
        base = sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        run = set("+/_-") | set(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and t[j] in run:
                j += 1
            if j - i >= secrets.WINDOW:
                e = j + min(2, len(t[j:]) - len(t[j:].lstrip("=")))
                s, hit = t[i:e], set()
                if not s.isalpha() and not secrets._ALLOW.fullmatch(s):
                    for k in range(len(s) - secrets.WINDOW + 1):
                        w = s[k : k + secrets.WINDOW]
                        h = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
                        kinds = [sum(c in "0123456789" for c in w), sum("a" <= c <= "z" for c in w), sum("A" <= c <= "Z" for c in w), sum(not c.isalnum() for c in w), sum(c.isalpha() and c.lower() > "f" for c in w)]
                        kind = secrets._class(*kinds)
                        if kind and h >= secrets.THRESHOLDS[kind] - 1e-9:
                            hit |= set(range(k, k + secrets.WINDOW))
                    at = sorted(hit)
                    cuts = [0, *[x + 1 for x in range(len(at) - 1) if at[x + 1] > at[x] + 1], len(at)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if a < b and not any(x < i + at[b - 1] + 1 and i + at[a] < y for x, y, _ in base):
                            out.append((i + at[a], i + at[b - 1] + 1, "entropy"))
            i = max(j, i + 1)
        return base, sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert sum(r.n_entropy for r in got.values()) > 5 and sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 30
    for i, t in enumerate(texts):
        base, every = plain(t)
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert got[i].spans == line(every), t
        assert got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[2] == k for x in base) for k in ("assign", "access", "hex"))


def test_steps_delete_what_earlier_steps_left(spark, tmp_path):
    """Tables of earlier steps go, those that docs reads and those made outside of steps stay."""
    import os

    roots = []

    @common.step
    def one(spark, docs, sf_dir):
        s = common.Scratch(spark, "step")
        roots.append(s.root.removeprefix("file://"))
        return s.save(docs)

    outside = common.Scratch(spark, "outside")
    table = outside.save(spark.range(3))
    first = one(spark, table, "")
    second = one(spark, first, "")  # reads the first step's table
    assert os.path.isdir(roots[0]) and second.count() == 3
    second.write.parquet(str(tmp_path / "out"))
    third = one(spark, spark.read.parquet(str(tmp_path / "out")), "")
    assert not os.path.isdir(roots[0]) and not os.path.isdir(roots[1]) and third.count() == 3 and table.count() == 3
