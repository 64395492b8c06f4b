"""The operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.llm import common, decontaminate, lines, minhash, mixing, quality, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "Wörter", "ünd", "a1b2", "Zeta", "nd.", "eau,"] + ["w%d" % i for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [say(rng.randint(20, 60)) + "\n" + say(rng.randint(5, 30)) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        for _ in range(6):
            w = t.split(" ")
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [base[0]] * 5 + ["", None, "one two", "One  two", "\t\n \x0b", "a", say(30_000), "x" * 5000]
    texts += ["\n".join(["Some footer line with 7 words here", say(12), "Some footer line with 9 words here"]) for _ in range(4)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None, "S3"]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TO_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def joined_up(n, links):
    up = list(range(n))
    for _ in range(n):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_near_duplicates(spark, docs):
    sets = [shingles(r[1]) for r in corpus()]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = joined_up(len(sets), links)
    rows = docs.withColumnsRenamed({"lang": "rep", "source": "comp"})  # clashing names
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()}
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, c in enumerate(comp) if c == i}
    assert minhash.near_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(odd).fillna(-1).collect()) == [(-1, 2, -1, True), (3, 2, 3, True), (3, 2, 3, True)]


def test_components_in_rounds_alone(spark, monkeypatch):
    monkeypatch.setattr(common, "ONE_TASK", 0)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = joined_up(300, links)
    df = spark.createDataFrame([(a * 7919 % 300 + 1000 * (a // 300), b * 7919 % 300) for a, b in links], "a long, b long")
    got = {r.node: r.comp for r in common.components(df, common.Scratch(spark, "t")).collect()}
    groups = {}
    for a in {x for p in links for x in p if p[0] != p[1]}:
        groups.setdefault(up[a], set()).add(a * 7919 % 300)
    assert got == {x: min(g) for g in groups.values() for x in g}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 62, 2000).astype(np.uint64))
    a, b = np.sort(x[:1500]), np.sort(x[500:])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a)]), 512)
    true = len(np.intersect1d(a, b)) / len(x)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - true) < 0.08
    band = lambda s: (1 - s**minhash.BAND_ROWS) ** minhash.BANDS
    assert band(0.75) < 1e-5


def brute_lines(rows):
    """What is left of each text, by edit similarity of all pairs of normal forms; and the pairs."""
    forms, occ = {}, []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            f = lines.normal(x.encode()).decode()
            if f:
                occ.append((i, k, f))
                forms.setdefault(f, (i, k))
    keys = list(forms)
    near = [p for p in itertools.combinations(range(len(keys)), 2) if lines.similar(keys[p[0]], keys[p[1]])]
    up = joined_up(len(keys), near)
    first = {}
    for i, f in enumerate(keys):
        first[up[i]] = min(first.get(up[i], (1 << 60, 0)), forms[f])
    place = {f: first[up[i]] for i, f in enumerate(keys)}
    gone = {(i, k) for i, k, f in occ if place[f] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines(spark):
    # words of letters: as digits are all 0 in normal forms, lines of numbers alone are alike in few, common features
    spell = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, t and t.translate(spell), *rest) for i, t, *rest in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_lines([(i, t) for i, t, *_ in rows])
    assert {r.doc_id: r.text for r in lines.line_report(docs).collect()} == want
    clash = docs
    for c in ("gone", "_gone", "_id2", "id2", "_h2", "_h", "h", "line", "class", "first"):
        clash = clash.withColumn(c, docs.doc_id)
    out = lines.dedup_lines(clash)
    assert out.columns == clash.columns and out.where("n_chars <> length(text) and n_chars <> 30000").where("text is null").count() == 0
    assert {r.doc_id: r.text for r in out.where("_h = doc_id and gone = doc_id").collect()} == want
    assert lines.line_report(empty(spark)).count() == 0


def test_lines_recall_of_edit_similarity(spark):
    """Against brute force on edit similarity alone: changed words and typos, short and long lines."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9)))
    texts, pairs = [], {"words": [], "typos": []}
    for n in [4, 5, 7, 10, 15, 20, 40, 60, 100] * 12:
        w = [word() for _ in range(n)]
        a = " ".join(w)
        for k in rng.sample(range(n), max(1, n // 8)):
            w[k] = word()
        b = " ".join(w)
        c = "".join(rng.choice("abcdefgh") if rng.random() < 0.05 else x for x in a)
        for kind, other in (("words", b), ("typos", c)):
            if other != a and lines.similar(a, other):
                pairs[kind].append((len(texts), len(texts) + 1))
                texts += [a + kind, other + kind]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.line_report(df).collect()}
    near = [p for p in itertools.combinations(range(len(texts)), 2) if lines.similar(texts[p[0]], texts[p[1]])]
    up = joined_up(len(texts), near)
    assert all(left[i] == texts[i] for i, first in enumerate(up) if first == i)
    # a typo costs a whole word, so that scattered typos are found less often (see the README)
    for kind, least in (("words", 0.95), ("typos", 0.6)):
        own = pairs[kind]
        assert len(own) > 40 and sum(left[b] == "" for _, b in own) >= least * len(own), kind


def test_lines_are_linked_alike_in_any_table(spark):
    """What is linked in a small table is linked too among many strange lines, and nothing else."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(80):
        a = " ".join(word(rng.randint(3, 8)) for _ in range(14))
        rows += [(2 * i, a), (2 * i + 1, "".join("z" if rng.random() < 0.04 else x for x in a))]
    strange = [(1000 + k, "\n".join(" ".join(word(9) for _ in range(8)) for _ in range(200))) for k in range(60)]
    left = lambda x: {r.doc_id: r.text for r in lines.line_report(spark.createDataFrame(x, "doc_id long, text string")).collect() if r.doc_id < 1000}
    few, many = left(rows), left(rows + strange)
    assert few == many and sum(t == "" for t in few.values()) > 40


def test_lines_of_a_dense_group(spark):
    """Hundreds of variants share all blocks: no row names all its candidates, yet one line stays; strangers stay."""
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(10_000) for _ in range(40)]
    texts = []
    for i in range(400):
        w = list(base)
        w[i % 40] = f"x{chr(97 + i // 40)}{chr(97 + i % 26)}{chr(97 + i % 7)}"
        texts.append(" ".join(w))
    texts += [" ".join("v%s%s" % (chr(97 + i % 26), chr(97 + rng.randrange(26)) * 3) for _ in range(12)) for i in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.line_report(df).collect()} == brute_lines(rows)


def test_a_pair_is_named_once(spark):
    """Lines that agree in many blocks are named by the first one alone, and dealt out in few packed rows, whatever their number."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2, 64 * lines.SIGNATURE).astype(np.uint8)
    sigs = [np.packbits(base ^ (rng.random(len(base)) < 0.05), bitorder="little").tobytes() for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(60)), "size": pa.array([80] * 60, pa.int32()), "sig": pa.array(sigs), "comp": pa.array(range(60))})
    pairs = []
    for k in range(0, lines.BLOCKS, lines.ROUND):
        wanted = np.arange(lines.BLOCKS << lines.BLOCK_BITS) // (lines.ROUND << lines.BLOCK_BITS) == k // lines.ROUND
        dealt = list(lines._blocks(iter([batch]), wanted, 4))
        assert sum(x.num_rows for x in dealt) <= 4
        for out in lines._near(iter(dealt), 100):
            pairs += [(r["a"], r["b"]) for r in out.to_pylist() if r["block"] is None]
    bits = np.unpackbits(np.frombuffer(b"".join(sigs), np.uint8).reshape(60, -1), axis=1, bitorder="little")[:, : lines.BLOCKS * lines.BLOCK_BITS]
    own = bits.reshape(60, lines.BLOCKS, lines.BLOCK_BITS)
    want = [(a, b) for a, b in itertools.combinations(range(60), 2) if (own[a] == own[b]).all(axis=1).any()]
    assert sorted(pairs) == want and len(want) > 1000


def test_rest_of_blocks_is_compared(spark):
    """Two components of one block that only the second pass can link, at any size of either; what is not similar stays apart."""
    rows = [(i, " ".join(["same words here as ever so that they are alike"] + [w])) for i, w in enumerate(("one", "two", "six"))] + [(9, "something else entirely in the very same block of course")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    classes = docs.selectExpr("doc_id as id", "doc_id", "0 as line", "h", "unhex('00000000000000FF') as sig")
    scratch = common.Scratch(spark, "rest")
    active = spark.createDataFrame([(1, i, 0, 300) for i in (0, 1, 2, 9)], "block long, id long, sketch long, size long")
    for have in (None, spark.createDataFrame([(0, 0), (1, 0)], "node long, comp long")):
        got = {r.node: r.comp for r in lines._rest(active, have, classes, docs, scratch).collect()}
        assert got == {0: 0, 1: 0, 2: 0}


def test_simhash_is_the_sign_of_sums():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 255, 256, 700, 5]
    line = np.repeat(np.arange(len(sizes)), sizes)
    h = rng.integers(0, 1 << 62, len(line)).astype(np.uint64)
    got = np.unpackbits(lines.simhash(np.concatenate([h, h[-2:]]), np.concatenate([line, line[-2:]]), len(sizes), 2), axis=1, bitorder="little")
    for i in range(len(sizes)):
        own = (h[line == i] >> np.uint64(20)) & np.uint64((1 << 44) - 1)
        bits = np.concatenate([(common.mix64(own * lines._STEP + np.uint64(k))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) for k in (0, 1)], axis=1)
        assert (got[i] == (2 * bits.sum(axis=0) > len(own))).all()


def test_short_lines_repeat(spark):
    long = "\u6f22\u5b57\u4eee\u540d\u4ea4\u3058\u308a\u6587" * 6
    texts = ["Next\nread more\n--\nok\n" + long, "next!\nRead More\n--\nno\n" + long, "read more.\n\n7\nok", "8\nxy", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.line_report(df).collect()}
    assert got == {0: (texts[0], 5, 0), 1: ("--\nno", 5, 3), 2: ("\n7", 4, 2), 3: ("xy", 2, 1), 4: (None, 0, 0)}


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abü ") for _ in range(rng.randrange(12))) for _ in range(2))
        want = plain(a, b)
        assert lines.distance(a, b) == want
        for most in range(8):
            assert (lines.distance(a, b, most) <= most) == (want <= most)
        x, y = ([w for w in t.split(" ") if w] for t in (a, b))
        if x and y:
            assert lines.bound(x, y) >= plain(" ".join(x), " ".join(y))


def test_secrets(spark):
    texts = [
        "password = 'hunter2hunter2' x", "API_KEY: abc", "token=secret=abcdefgh", "see AKIAABCDEFGHIJKL end AKIA12", "0123456789abcdef" * 2 + "g",
        "key Zx81mQp0Lr7VbN3tYw9KcEd2Hs5Uf now", "id 123e4567-e89b-12d3-a456-426614174000", "", None, "ünïcode passwd:  aaaaaaaa",
    ]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans long")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    want = {0: "assign:0:26", 1: "", 2: "assign:0:21", 3: "access:4:20", 4: "hex:0:32", 6: "", 7: "", 8: "", 9: "assign:8:25"}
    for i, w in want.items():
        assert got[i].spans == w and got[i].base_sha256 == hashlib.sha256(w.encode()).hexdigest()
    assert got[5].n_entropy == 1 and got[5].spans.startswith("entropy:")
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_entropy_counts_match_recounting():
    import math

    rng = random.Random(9)
    for _ in range(200):
        s = "".join(rng.choice("0123456789abcdefXYZ_-") for _ in range(rng.randint(20, 60)))
        hit = set()
        for i in range(len(s) - secrets.WINDOW + 1):
            w = s[i : i + secrets.WINDOW]
            h = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
            kinds = [sum(map(str.isdigit, w)), sum(map(str.islower, w)), sum(map(str.isupper, w)), sum(c in "_-" for c in w), sum(c.isalpha() and c.lower() > "f" for c in w)]
            kind = secrets._class(*kinds)
            if kind and h >= secrets.THRESHOLDS[kind] - 1e-9:
                hit |= set(range(i, i + secrets.WINDOW))
        assert {x for a, b in secrets.entropy_spans(s) for x in range(a, b)} == hit


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus()}
    assert {r.doc_id: r.size for r in rows} == size
    total = sum(size.values())
    sources = {}
    for i, _, _, s, _ in corpus():
        sources[s] = sources.get(s, 0) + size[i]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * sources[s] for s in capped)
        target = {s: 3 * sources[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sources[s]}
        if not over:
            break
        capped |= over
    of = {i: s for i, _, _, s, _ in corpus()}
    taken = {}
    for r in rows:
        assert r.source_size == sources[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2.5 * mixing.BLOCK
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    blocks = mixing.mixed_blocks(docs).collect()
    per = {}
    for b in blocks:
        per[b.doc_id] = per.get(b.doc_id, 0) + b.n_words
        w = re.findall(r"[^\x20\x09-\x0D]+", corpus_text()[b.doc_id])
        assert b.text == " ".join(w[b.word : b.word + b.n_words])
    assert per == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mix(empty(spark)).count() == 0


def corpus_text():
    return {i: t or "" for i, t, *_ in corpus()}


@pytest.mark.parametrize("blocks", [1, 2, 7, 100, 1023])
def test_permutation(spark, blocks):
    df = spark.range(blocks * 2).selectExpr("id as j", "5L as sid", f"{blocks}L as blocks").select("j", mixing.permuted().alias("p"))
    rows = [r.p for r in df.orderBy("j").collect()]
    assert sorted(rows[:blocks]) == list(range(blocks)) == sorted(rows[blocks:])
    assert blocks < 100 or rows[:blocks] != rows[blocks:]


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "and", *["k%d" % i for i in range(40)]])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 20, 10, 9, 3, 1, 0])] + [(7, None), (1, "The THE the the the the the the the the the")]
    texts = [" ".join(word() for _ in range(60)) for _ in range(10)]
    for k, (_, t) in enumerate(items[:5]):
        w = t.split()
        texts.append(texts[k] + " " + t.upper() + ". " + texts[k + 1])
        texts.append(" ".join(w[2:]) + ", " + texts[k])
    texts += [None, "", items[0][1], "the " * 30, "é " * 5]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TO_LOWER))
    want = {}
    for i, t in enumerate(texts):
        w, hit, ids = split(t), set(), set()
        for item, x in items:
            v = split(x)
            k = min(10, len(v))
            wins = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if wins and tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    ids.add(str(item))
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.judged(docs.drop("h"), bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {i for i, v in want.items() if not v[4]}
    assert decontaminate.judged(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.judged(docs.drop("h"), bench.limit(0)).collect())


def test_proximity_matches(spark):
    rng = random.Random(15)
    word = lambda: rng.choice(["the", "of", "and", *["k%d" % i for i in range(60)]])
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([14, 20, 10, 9, 3, 1])]
    items[1][1][4] = items[1][1][12] = "nowhere"
    texts = [[word() for _ in range(40)] for _ in range(6)]
    for k in range(60):
        w = [x if x != "nowhere" else "else" for x in items[k % 5][1]]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w)) if w else 0
            w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        texts.append([word() for _ in range(rng.randint(0, 8))] + w + [word() for _ in range(rng.randint(0, 8))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")

    def least(window, text):
        d = list(range(len(window) + 1))
        best = d[-1]
        for x in text:
            new = [0]
            for i, y in enumerate(window, 1):
                new.append(min(new[-1] + 1, d[i] + 1, d[i - 1] + (x != y)))
            d, best = new, min(best, new[-1])
        return best

    for slop in (1, 2, 3):
        want = {}
        for i, t in enumerate(texts):
            for item, own in items:
                k = min(decontaminate.WINDOW, len(own))
                for s in range(len(own) - k + 1):
                    n = least(own[s : s + k], t)
                    if n <= min(slop, (k - 1) // 2):
                        want[i, item, s] = n
        got = {(r.doc_id, r.item_id, r.start): r.changed for r in decontaminate.proximity(docs, bench, slop).collect()}
        assert got == want and len(set(want.values())) == slop + 1


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(200)]
    bad = ["stupid", "idiot", "trash"]
    texts, labels = [], []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 150))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net = toxicity.train(texts[:220], np.array(labels[:220]))
    p = 1 / (1 + np.exp(-net.logits(toxicity.Words(pa.array(texts[220:])))))
    y = np.array(labels[220:])
    assert ((p >= toxicity.THRESHOLD) == y).mean() > 0.9
    rows = [(i, t, "x") for i, t in enumerate([*texts, None, "", "w1 " * 20_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect())
    assert toxicity.score(empty(spark), net).count() == 0


def test_toxic_rows_go_by_their_own_text(spark, monkeypatch):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(200)]
    texts = [" ".join(rng.choice(vocab) for _ in range(30)) + (" stupid idiot" if i % 4 == 0 else "") for i in range(200)]
    net = toxicity.train(texts, np.array([int(i % 4 == 0) for i in range(200)]))
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: net)
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[8]), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bad = {t for t, p in zip(texts, net.logits(toxicity.Words(pa.array(texts))), strict=True) if 1 / (1 + np.exp(-p)) >= toxicity.THRESHOLD}
    assert {texts[0], texts[4], texts[8]} <= bad and not {texts[1], texts[5]} & bad
    got = [tuple(r) for r in toxicity.drop_toxic(docs, None).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if r[1] not in bad), key=str)


def test_gradients_of_the_network():
    net = toxicity.Net(np.arange(1, 4, dtype=np.uint64), np.zeros(3, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, ids, n = rng.standard_normal((9, 16)), rng.integers(0, 9, (5, 12)), np.array([12, 7, 1, 12, 3])
    d = rng.standard_normal(5)
    loss = lambda: float(net.forward(net.project(x), ids, n) @ d)
    _, cache = net.forward(net.project(x), ids, n, keep=True)
    g, _ = net.backward(cache, x, ids, d)
    for k in ("W", "U", "b", "a", "v"):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            old = net.p[k][at]
            net.p[k][at] = old + 1e-2
            up = loss()
            net.p[k][at] = old - 1e-2
            down = loss()
            net.p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-2, abs=5e-3, rel=0.05)


def test_quality_against_plain_counts(spark, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(quality, "VOCAB", 40)
    monkeypatch.setattr(quality, "HOT", 25)
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(rows, SCHEMA)
    good = {r[0] for r in rows if r[0] % 2}
    labels = spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    uni = Counter(w for i in good for w in words[i])
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    least = sorted(uni.values(), reverse=True)[39]
    vocab = {w for w, c in uni.items() if c > least}
    tied = [w for w, c in uni.items() if c == least]
    h = {w: int(common.range_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0].astype(np.int64)) for w in tied}
    vocab |= set(sorted(tied, key=lambda w: h[w])[: 40 - len(vocab)])
    seq = lambda i: ["<s>"] + [w if w in vocab else "<unk>" for w in words[i]]
    bi = Counter(p for i in good for p in itertools.pairwise(seq(i)))
    d = quality.discounts(Counter(bi.values()))
    before = Counter(w for _, w in bi)
    e = quality.discounts(Counter(before.values()))
    cut = lambda c, d: 0 if c <= 0 else d[min(c, 3) - 1]
    types = len(vocab) + 1
    whole = sum(before.values())
    freed = sum(cut(c, e) for c in before.values()) / whole
    q = lambda w: (before[w] - cut(before[w], e)) / whole + freed / types
    total, free = Counter(), Counter()
    for (v, _), c in bi.items():
        total[v] += c
        free[v] += cut(c, d)
    for i in words:
        own, lp = Counter(itertools.pairwise(seq(i))), 0.0
        for (v, w), n in own.items():
            c = bi[v, w] - (n if i in good else 0)
            p = max(c - cut(c, d), 0) / max(total[v], 1) + (free[v] / total[v] if total[v] else 1) * q(w)
            lp += n * (math.log(p) - (math.log(max(1, len(uni) - len(vocab))) if w == "<unk>" else 0))
        if words[i]:
            assert got[i].perplexity == pytest.approx(math.exp(-lp / len(words[i])), rel=2e-3)
            assert got[i].kept == (got[i].perplexity <= got[i].threshold)
        else:
            assert got[i].perplexity is None and not got[i].kept
    assert quality.judge(empty(spark), labels).count() == 0


@pytest.mark.parametrize("hot", [0, 60, 100_000])
def test_quality_of_trigrams_without_a_vocabulary_limit(spark, monkeypatch, hot):
    import math
    from collections import Counter

    monkeypatch.setattr(quality, "HOT", hot)
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    good = {i for i in words if i % 2}
    labels = spark.createDataFrame([(i, int(i in good)) for i in words], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), labels, order=3).collect()}
    seq = {i: list(zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False)) for i, w in words.items()}
    tri = Counter(t for i in good for t in seq[i])
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)
    ds = [quality.discounts(Counter(x.values())) for x in (tri, bi, uni)]
    cut = lambda c, d: 0 if c <= 0 else d[min(c, 3) - 1]
    whole = sum(uni.values())
    freed = sum(cut(c, ds[2]) for c in uni.values()) / whole / (len(uni) + 1)
    q = lambda w: (uni[w] - cut(uni[w], ds[2])) / whole + freed
    total, free = Counter(), Counter()
    for counts, d in ((tri, ds[0]), (bi, ds[1])):
        for t, c in counts.items():
            total[t[:-1]] += c
            free[t[:-1]] += cut(c, d)

    def p(counts, d, t, c, lower):
        n = total[t[:-1]]
        return (max(c - cut(c, d), 0) + free[t[:-1]] * lower) / n if n else lower

    for i, w in words.items():
        own, lp = Counter(seq[i]), 0.0
        for t, n in own.items():
            two = p(bi, ds[1], t[1:], bi[t[1:]], q(t[2]))
            lp += n * math.log(p(tri, ds[0], t, tri[t] - (n if i in good else 0), two))
        if w:
            assert got[i].perplexity == pytest.approx(math.exp(-lp / len(w)), rel=2e-3)


def test_toxicity_is_not_trained_in_the_driver(spark, monkeypatch):
    """The driver's memory holds neither the sample nor the training: a task makes the network."""
    texts = [f"you are {w} and more words" for w in ("vile", "kind") for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(toxicity, "train", never)
    assert isinstance(toxicity.fit(docs, labels), toxicity.Net)
    assert toxicity.fit(docs.limit(0), labels) is None
