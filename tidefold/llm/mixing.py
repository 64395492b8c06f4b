"""Mixing sources to target weights, in Spark's own functions.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+` (null: 0). Sources in
code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share the total size by weight;
a target stops at three times its source's size and the excess is shared again by weight
until none is above (water filling, solved from running sums).

Method. The words of a source, documents in order of doc_id, are packed into blocks
of BLOCK words; places come from prefix sums in two levels (ranges of the sorted rows, then range
totals), so no task sorts a whole source. A target is met by a number of slots.
Each output shard draws its SHARD slots from the multinomial of the sources' shares. A source has as many slots as its target needs;
draws that find a source full are drawn again, from the multinomial of what the sources have left, until none is open: shards
keep their size and each source takes exactly its number. A source's slots are numbered
across shards, and slot j goes to block p(j mod blocks), with p a keyed pseudorandom
permutation of the source's block numbers, another one for each time round. Slots and blocks are
then joined by source and block number; texts are joined once, after that, to the places taken from them. As slots are at most three times the blocks,
no block, and so no document, is taken more than three times. All draws are hashes of the
seed, so reruns agree.

Defined cases: null or wordless texts have size 0 and take 0; a null source is a
source; a null doc_id comes first in its source; repeated rows are separate documents;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, SHARD, SEED = 256, 4096, 17
#: Rows in a range of the first level of prefix sums; cells of the lookup from a draw to its source; rounds of the permutation.
CHUNK, CELLS, ROUNDS = 1 << 18, 1024, 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_key(c: str | Column = "source") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.xxhash64(F.coalesce(c, F.lit("")), c.isNull())


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with weight, target, blocks and slots."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("turn") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = sizes.withColumn("turn", F.row_number().over(order)).withColumn("weight", weight.cast("long"))
    t = t.withColumn("most", MOST * F.col("source_size"))
    whole = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    t = t.withColumn("level", F.first(fits, ignorenulls=True).over(every))
    t = t.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    slots = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    t = t.withColumn("slots", F.when(F.col("source_size") > 0, F.least(slots, MOST * F.col("blocks"))).otherwise(0).cast("long"))
    return t.select("source", "source_size", "target", "blocks", "slots", source_key().alias("sid"))


def placed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): a row per document with its place in its source, and the sources with their targets; h tells texts apart."""
    spark = docs.sparkSession
    plain = scratch.save(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), n_words(F.col("text")).alias("size")))
    sources = scratch.save(targets(plain.groupBy("source").agg(F.sum("size").alias("source_size"))))
    order = ["doc_id", "size", "h", "tie"]  # tie only spreads rows that are equal otherwise, and so interchangeable
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plain.count() // CHUNK + 1)
    rows = plain.withColumns({"sid": source_key(), "tie": F.monotonically_increasing_id()}).drop("source")
    rows = rows.repartitionByRange(parts, "sid", *order).withColumn("chunk", F.spark_partition_id().cast("long"))
    within = Window.partitionBy("sid", "chunk").orderBy(*order)
    rows = scratch.save(rows)
    scratch.drop(plain)
    rows = rows.withColumns({
        "turn": F.row_number().over(within),
        "at": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).drop("tie")
    totals = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("sum"))
    along = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(totals.select(F.col("sid").alias("sid2"), F.col("chunk").alias("chunk2"), F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("start")))
    rows = rows.join(small(starts, starts.count()), (F.col("sid") == F.col("sid2")) & (F.col("chunk") == F.col("chunk2")))
    return rows.select("doc_id", "h", "size", "sid", "chunk", "turn", (F.col("at") + F.col("start")).alias("at")), sources


def counts(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(shard, sid, n): the slots of each shard by source; multinomial draws, those that find a source full drawn again over what is left."""
    total, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    left, lack, turn, out = sources.select("sid", F.col("slots").alias("left")).where("slots > 0"), total, 0, None
    draws = sources.sparkSession.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"), F.col("id").alias("k"))
    while lack or out is None:
        span = left.withColumn("hi", F.sum("left").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
        span = span.withColumn("lo", F.col("hi") - F.col("left"))
        cell = lambda c, most=max(lack, 1): F.floor(c * F.lit(float(CELLS)) / most).cast("long")
        grid = scratch.save(span.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1)))))
        x = draws.select("shard", F.pmod(F.xxhash64(F.lit(SEED), F.lit(turn), "shard", "k"), F.lit(max(lack, 1))).alias("x"))
        hit = x.withColumn("cell", cell(F.col("x"))).join(small(grid, n + CELLS), "cell").where("lo <= x and x < hi")
        drawn = hit.groupBy("shard", "sid", "left").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        drawn = scratch.save(drawn.withColumn("ok", F.least("n", F.greatest(F.col("left") - before, F.lit(0)))))
        kept = drawn.where("ok > 0").select("shard", "sid", F.col("ok").alias("n"))
        out = kept if out is None else out.union(kept)
        open_ = drawn.groupBy("shard").agg(F.sum(F.col("n") - F.col("ok")).alias("lack")).where("lack > 0")
        draws = scratch.save(open_.select("shard", F.explode(F.sequence(F.lit(1).cast("long"), "lack")).alias("k")))
        lack, turn = draws.count(), turn + 1
        used = drawn.groupBy("sid").agg(F.sum("ok").alias("used"))
        left = scratch.save(left.join(used, "sid", "left").select("sid", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")).where("left > 0"))
    return scratch.save(out.groupBy("shard", "sid").agg(F.sum("n").alias("n")))


def drawn(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(shard, slot, sid, block): every slot of the mix with the block it takes."""
    from_ = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = counts(sources, scratch).withColumn("to", F.sum("n").over(from_))
    runs = runs.join(small(sources, sources.count()).select("sid", "blocks"), "sid").withColumn("lo", F.col("to") - F.col("n"))
    slots = runs.withColumn("j", F.explode(F.sequence("lo", F.col("to") - 1)))
    return slots.select("shard", F.xxhash64("sid", "j").alias("slot"), "sid", permuted().alias("block"))


def permuted() -> Column:
    """The block that slot j of a source takes: swap-or-not, a pseudorandom permutation of any range, keyed by source and time round.

    In each round x and its mirror about a random point swap if a bit, hashed from the larger of the two, says so.
    """
    return F.expr(
        f"""aggregate(sequence(1, {ROUNDS}), j % blocks, (x, r) ->
        if(xxhash64({SEED}, sid, j div blocks, r, greatest(x, pmod(pmod(xxhash64(sid, {SEED}, j div blocks, r), blocks) - x, blocks))) & 1 = 1,
           pmod(pmod(xxhash64(sid, {SEED}, j div blocks, r), blocks) - x, blocks), x))"""
    )


def pieces(rows: DataFrame) -> DataFrame:
    """A row for each block that a document has words in: block, offset in the block, first word and number of words; a null block without words."""
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)))
    p = rows.withColumn("block", F.explode_outer(blocks))
    start = F.greatest(F.col("at"), F.col("block") * BLOCK)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return p.withColumns({"offset": start - F.col("block") * BLOCK, "word": start - F.col("at"), "n": end - start})


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, source): size, its source's size and target, and the words that the mix takes of it."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows, sources = placed(docs, scratch)
    slots = drawn(sources, scratch)
    uses = scratch.save(slots.groupBy("sid", "block").agg(F.count("*").alias("uses")))
    rows = scratch.save(rows)
    parts = pieces(rows).join(small(uses, uses.count()), ["sid", "block"], "left")
    taken = parts.groupBy("sid", "chunk", "turn", "doc_id", "size").agg(F.coalesce(F.sum(F.col("n") * F.col("uses")), F.lit(0)).alias("taken"))
    n = sources.count()
    return taken.join(small(sources, n).select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each piece of a document in a taken block, with its shard, slot, place and text.

    Pieces of one slot, by offset, make up its block of words.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows, sources = placed(docs, scratch)
    rows = scratch.save(rows.where("size > 0"))
    slots = drawn(sources, scratch)
    taken = pieces(rows).join(slots, ["sid", "block"])
    piece = F.struct("shard", "slot", "block", *[F.col(c).cast("int").alias(c) for c in ("offset", "word", "n")])
    # a document's own pieces; documents that are equal in all are kept apart by chunk and turn
    lists = taken.groupBy("sid", "doc_id", "h", "chunk", "turn").agg(F.collect_list(piece).alias("pieces"))
    same = ["sid", "doc_id", "h"]
    twice = scratch.save(rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same))
    texts = docs.select(source_key().alias("sid"), "doc_id", F.xxhash64("text").alias("h"), "source", "text")
    if n := twice.count():
        # one copy of a repeated row is enough, as each list of its places takes its words from it
        key = lambda a, b: (a["sid"] == b["sid"]) & a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
        few = small(twice, n)
        copies = texts.join(few, key(texts, few), "left_semi").groupBy(*same).agg(F.first("source").alias("source"), F.first("text").alias("text"))
        texts = texts.join(few, key(texts, few), "left_anti").union(copies)
    lists = lists.withColumnsRenamed({"sid": "sid2", "doc_id": "id2", "h": "h2"})
    lists = scratch.save(lists)
    scratch.sweep()
    both = texts.join(lists, (F.col("sid") == F.col("sid2")) & F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    # the words are bound once a document (a let by an array of one), then sliced piece by piece
    part = lambda w, p: F.array_join(F.slice(w, p["word"] + 1, p["n"]), " ")
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = F.transform(words, lambda w: F.transform("pieces", lambda p: F.struct(p.alias("p"), part(w, p).alias("part"))))
    cut = both.select("source", "doc_id", F.explode(cut[0]).alias("e")).select("source", "doc_id", "e.p", "e.part")
    return cut.select(
        "p.shard", "p.slot", "source", "p.block", F.col("p.offset").cast("long").alias("offset"), "doc_id", F.col("p.word").cast("long").alias("word"),
        F.col("p.n").cast("long").alias("n_words"), F.col("part").alias("text"),
    )
