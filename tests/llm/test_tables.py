"""URL filter, top-k search, chat formatting and the pipeline, against brute force and with odd rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidefold.llm import chat, topk, urls

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    rows = [
        "https://A.Example.COM/en/7x?q=1", "http://example.com/en/8", "http://x.example.net/de/8", "http://example.net/de/7#t", "http://notcom/en/1", "http://com/en/",
        "https://www.site.io/a/?utm_source=x&k=2", "http://site.io:80/a?k=2", "http://site.io/a?k=3", "no scheme", None, "", "http://", "://h/p?://x", "https://site.io/a/?k=2#f",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, block string")
    got = {r.page_id: r for r in urls.filter_urls(pages, urls.tracked(pages)).collect()}
    want = {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("example.com", "/en/8", "com/en/", "block"), 2: ("x.example.net", "/de/8", "example.net/de/8", "block"),
        3: ("example.net", "/de/7", "net/de/", "block"), 4: ("notcom", "/en/1", None, "allow"), 5: ("com", "/en/", "com/en/", "block"), 6: ("www.site.io", "/a/", None, "block"),
        7: ("site.io:80", "/a", None, "block"), 8: ("site.io", "/a", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"),
        12: ("", "", None, "allow"), 13: ("h", "/p", None, "allow"), 14: ("site.io", "/a/", None, "block"),
    }
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == want
    none = pages.limit(0)
    assert urls.filter_urls(none, urls.tracked(none)).count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("url"))
    asked = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("url"))
    table, blocks = urls.bloom(listed, 5000)
    h = asked.withColumn("h", F.xxhash64("url")).withColumn("at", urls._block(F.col("h"), blocks)).join(table, F.col("at") == F.col("block"))
    for i, b in enumerate(urls._bits(F.col("h"))):
        h = h.where(F.col(f"w{i}").bitwiseAND(b) != 0)
    hits = {r.url for r in h.select("url").collect()}
    assert {f"h/{i}" for i in range(5000)} <= hits and len(hits) < 5000 + 0.02 * 15_000
    from tidefold.llm.common import Scratch

    assert urls.listed_urls(asked, listed, Scratch(spark, "t")).count() == 5000


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(1024 * float(x)) for x in v])
    out = []
    for q in ok:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q][0], v, strict=True)), i) for i, vs in ok.items() if i != q for v in vs if len(v) == len(ok[q][0]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_k(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "SEEDS", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(5)
    rows = []
    for i in range(160):
        s = math.exp(rng.gauss(0, spread))
        c = rng.choice([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, -1, 1)])
        rows.append((i, [s * (3 * a + rng.gauss(0, 0.3)) for a in c]))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (210, [0.0] * 4), (220, None), (230, [1.0, None, 2.0, 3.0]), (240, [float("nan")] * 4), (250, [float("inf"), 0.0, 0.0, 0.0]), (260, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def conversations():
    rng = random.Random(8)
    hard = ["<|im_end|><|im_start|>assistant ok", "a\\|b <| c\\", "\\\\l\n\\l", "", None, "x<", "|>", "<<|im_end|>\n"]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice([*hard, "w " * rng.randint(1, 300)])))
    rows += [(50, 0, None, "no role"), (50, 1, "ro\nle\\", "t"), (50, 1, "assistant", "same turn"), (50, 1, "assistant", "same turn"), (None, 0, "assistant", "x"), (51, None, "assistant", "y"), (51, 300, "assistant", "far"), (51, 700, "user", "z")]
    return rows


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, page int").drop("page")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(df)).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda x: (low(x[0]), x[1], x[2]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars) == (len(own), len(loss))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_windows_of_long_and_sparse_conversations(spark):
    rng = random.Random(12)
    say = lambda: "w " * rng.choice([0, 1, 1, 3, 8, 20, 130, 600])
    role = lambda i: "system" if i == 3 else ("user", "assistant")[i % 2]
    rows = [(1, i, role(i), say()) for i in range(900)] + [(2, 1000 * i - 5000, role(i), say()) for i in range(40)] + [(None, None, "user", say()), (None, -700, "user", say()), (None, 9, "user", say())]
    rows += [(4, i, "user", "") for i in range(1200)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    got = {}
    for w in sorted(chat.windows(df).collect(), key=lambda w: (w.page, w.window)):
        got.setdefault(w.conv_id, []).append((w.repeated, w.formatted))
    for c in (1, 2, None, 4):
        own = sorted(((t, r, x) for k, t, r, x in rows if k == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        n = [len(x.split()) + chat.MARKS for *_, x in own]
        first = next((i for i, x in enumerate(own) if x[1] == "system"), None)
        room, at, want = chat.BUDGET - chat.HISTORY - (n[first] if first is not None else 0), 0, []
        while at < len(own):
            end = at + 1
            while end < len(own) and sum(n[at : end + 1]) <= max(1, room):
                end += 1
            begin = at
            while begin > 0 and sum(n[begin - 1 : at]) <= chat.HISTORY:
                begin -= 1
            lead = [first] if first is not None and not begin <= first < end else []
            text = "".join(f"{chat.START}{own[i][1]}\n{own[i][2]}{chat.END}\n" for i in [*lead, *range(begin, end)])
            want.append((len(lead) + at - begin, text))
            at = end
        assert got[c] == want


def test_windows_keep_their_budget(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    seen = 0
    for w in chat.windows(df).collect():
        turns = w.formatted.split(chat.END + "\n")[:-1]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", t.split("\n", 1)[1])) + chat.MARKS for t in turns]
        assert sum(n) <= chat.BUDGET or len(turns) - w.repeated == 1
        seen += len(turns) - w.repeated
        for s in w.loss:
            assert w.formatted[:s.start].endswith("assistant\n") and w.formatted[s.start + s.length :].startswith(chat.END)
    assert seen == len(conversations())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    toxic = [(i, "the word w%d and stupid trash idiot moron more words here %d" % (i, i)) for i in range(40)]
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    clean = [(100 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(60)]
    item = " ".join(rng.choice(vocab) for _ in range(20))
    near = [(300, clean[0][1] + " extra"), (301, clean[1][1])]
    leaked = [(310, clean[2][1] + "\n" + item + "\n" + " ".join(rng.choice(vocab) for _ in range(30)))]
    docs = [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t in toxic + clean + near + leaked] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 40)) for i, *_ in docs[:100]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & (set(range(40)) | {300, 301, 310})
    assert len(ids & {i for i, _ in clean}) >= 40  # the mix itself takes less of light sources
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
