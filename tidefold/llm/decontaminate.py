"""Benchmark decontamination by a distributed positional inverted index, in Spark's own functions.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of whole texts with A-Z lower-cased. A window
is ten consecutive words of an item; an item of fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit.

A proximity match (`proximity`) is a window that some run of a text's words equals but for at most `slop` words that are
replaced, left out or inserted; windows of few words allow less, (words - 1) div 2 of them.

Method. Corpus frequencies of the items' terms are counted (Spark combines before the shuffle).
Each window chooses its rarest positions, two more than it allows changes (or all it has); windows with more terms that the corpus lacks
than it allows are out, as each of them is a change. The index holds the postings (term, document, position) of
the chosen terms only, as no other list is read. Lists are adjusted by the term's offset in
its item and intersected: each change spoils one chosen position at most, so an occurrence has two (one, for items
of a word) that agree, and they agree to within as many places as there are changes. On the few documents with such alignments the phrase is compared word
by word, which gives exact matches, or by edit distance over the words around the alignment, which gives proximity matches.
Hot terms only lengthen their own lists, which are spread by document before they are intersected.

Defined cases: null texts have no words; repeated item ids count once; rows that repeat
a doc_id are judged each by its own text; an empty benchmark hits nothing; a null item id is counted as a hit but not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, light, private
from .urls import LOWER, UPPER

WORD, WINDOW = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def folded(text: Column) -> Column:
    """The words for the index: all letters lower-cased, which is faster and only joins more terms; it moves no word, and what is found is compared exactly."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(folded(F.col("text"))).alias("pos", "term"))
    return rows.join(light(terms), "term")


def alignments(docs: DataFrame, items: DataFrame, scratch: Scratch, slop: int = 0) -> DataFrame:
    """(doc_id, h, item, delta): places where two chosen terms of items(item, words) agree, to within slop; h tells texts apart."""
    at = scratch.save(items.select("item", F.size("words").alias("len"), F.posexplode(F.transform("words", F.lower)).alias("ipos", "term")))
    terms = scratch.save(at.select("term").distinct())
    freq = scratch.save(_postings(docs, terms).groupBy("term").agg(F.count("*").alias("cf")))
    width = F.least(F.col("len"), F.lit(WINDOW))
    low, high = F.greatest(F.lit(0), F.col("ipos") - width + 1), F.least(F.col("ipos"), F.col("len") - width)
    inside = at.join(light(freq), "term", "left").withColumn("start", F.explode(F.sequence(low, high)))
    window = Window.partitionBy("item", "start")
    ranked = inside.withColumns({
        "absent": F.count(F.when(F.col("cf").isNull(), 1)).over(window),
        "turn": F.row_number().over(window.orderBy(F.coalesce("cf", F.lit(0)), "ipos")),
        "most": F.expr(changes(slop, "len")),
    })
    chosen = scratch.save(ranked.where("absent <= most and turn <= most + 2").select("item", "len", "ipos", "term").distinct())
    lists = scratch.save(chosen.select("term").distinct())
    index = scratch.save(_postings(docs, lists))
    # chosen positions of a term as one row, so that a posting is expanded after it was shuffled, by document
    own = chosen.groupBy("term").agg(F.collect_list(F.struct("item", "len", "ipos")).alias("at"))
    found = index.join(light(scratch.save(own)), "term").select("doc_id", "h", "pos", F.explode("at").alias("at"))
    found = found.select("doc_id", "h", "at.item", "at.len", (F.col("pos") - F.col("at.ipos")).alias("delta"), "at.ipos")
    if slop:
        # two that agree have, in order of delta, neighbours of different terms among and between them
        near = Window.partitionBy("doc_id", "h", "item").orderBy("delta", "ipos")
        after = found.withColumns({"ipos2": F.lead("ipos").over(near), "delta2": F.lead("delta").over(near)})
        agree = after.where((F.col("len") == 1) | ((F.col("ipos2") != F.col("ipos")) & (F.col("delta2") - F.col("delta") <= slop)))
        return scratch.save(agree.select("doc_id", "h", "item", "delta").distinct())
    agree = found.groupBy("doc_id", "h", "item", "len", "delta").agg(F.min("ipos").alias("a"), F.max("ipos").alias("b"))
    return scratch.save(agree.where("a <> b or len = 1").select("doc_id", "h", "item", "delta"))


def changes(slop: int, words: str) -> str:
    """How many words of a window of an item of so many words may be changed."""
    return f"least({int(slop)}, (least({WINDOW}, {words}) - 1) div 2)"


def _found(docs: DataFrame, items: DataFrame, scratch: Scratch, slop: int = 0) -> DataFrame:
    """(doc_id, h, words, at): the words of each text with alignments, and these as an array of (item_id, deltas, own words)."""
    items = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    items = scratch.save(items.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]))
    found = alignments(docs, items, scratch, slop)
    # an item's words stand once in a text's row, whatever the number of its alignments
    by = found.groupBy("doc_id", "h", "item").agg(F.collect_list("delta").alias("deltas")).join(light(items), "item")
    by = by.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "deltas", F.col("words").alias("own"))).alias("at"))
    by = scratch.save(by)
    ids = by.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    texts = texts.join(light(ids), same, "left_semi")
    texts = scratch.save(texts.select("doc_id", "h", words_of(F.col("text")).alias("words")).dropDuplicates(["doc_id", "h"]))
    return texts.join(by.withColumnsRenamed({"doc_id": "id2", "h": "h2"}), same).drop("id2", "h2")


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, h, hits): for each text with any, an array of (item_id, at, width) of the windows that occur at word `at`."""
    scratch = Scratch(docs.sparkSession, "index")
    width = f"least({WINDOW}, size(c.own))"
    match = f"slice(words, s + d + 1, {width}) = slice(c.own, s + 1, {width})"
    last = f"least(size(c.own), size(words) - d) - {width}"
    span = f"if({last} >= greatest(0, -d), sequence(greatest(0, -d), {last}), array())"
    one = f"transform(filter({span}, s -> {match}), s -> struct(c.item_id as item_id, s + d as at, {width} as width))"
    hits = f"flatten(transform(at, c -> flatten(transform(c.deltas, d -> {one}))))"
    return scratch.save(_found(docs, items, scratch).select("doc_id", "h", F.expr(hits).alias("hits")).where("size(hits) > 0"))


def proximity(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, h, item_id, start, changed): the windows, by their first word in the item, with a proximity match in a text, and the fewest words changed."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = _found(docs, items, scratch, slop).select("doc_id", "h", "words", F.explode("at").alias("c")).select("doc_id", "h", "words", "c.item_id", "c.own", F.explode("c.deltas").alias("delta"))
    rows = rows.withColumn("width", F.expr(f"least({WINDOW}, size(own))")).withColumn("start", F.explode(F.expr("sequence(0, size(own) - width)")))
    # an agreeing pair's delta is off by at most slop, and so is the occurrence's first word
    begin = f"greatest(0, delta + start - {2 * slop})"
    rows = rows.withColumn("around", F.expr(f"slice(words, {begin} + 1, greatest(0, delta + start + width + {2 * slop} - {begin}))"))
    row = "aggregate(sequence(1, width), array(0), (r, i) -> concat(r, array(least(element_at(r, -1) + 1, s.d[i] + 1, s.d[i - 1] + if(own[start + i - 1] = x, 0, 1)))))"
    step = f"named_struct('d', {row}, 'best', s.best)"
    least = f"aggregate(around, named_struct('d', sequence(0, width), 'best', width), (s, x) -> transform(array({step}), y -> named_struct('d', y.d, 'best', least(y.best, y.d[width])))[0], s -> s.best)"
    rows = rows.withColumn("changed", F.expr(least)).where(F.expr(f"changed <= {changes(slop, 'size(own)')}"))
    return scratch.save(rows.groupBy("doc_id", "h", "item_id", "start").agg(F.min("changed").alias("changed")))


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): n_words, n_hit, n_items, items_sha256 and contaminated."""
    hits = occurrences(docs, items)
    hits = hits.select(
        F.col("doc_id").alias("id2"), F.col("h").alias("h2"),
        F.expr("cast(size(array_distinct(flatten(transform(hits, x -> sequence(x.at, x.at + x.width - 1))))) as bigint)").alias("n_hit"),
        F.expr("array_sort(array_distinct(filter(transform(hits, x -> cast(x.item_id as string)), x -> x is not null)))").alias("ids"),
    )
    hits = Scratch(docs.sparkSession, "hits").save(hits)
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD.replace(r"\x60", r"\x40\x5B-\x60")), F.lit(0)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), n_words.cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    out = rows.join(light(hits), same, "left")
    ids = F.coalesce("ids", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in whose text a window of items occurs; columns of any names pass through."""
    id2, h2 = private(docs, "id2", "h2")
    hits = occurrences(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias(id2), F.col("h").alias(h2))
    same = F.col("doc_id").eqNullSafe(F.col(id2)) & (F.xxhash64("text") == F.col(h2))
    return docs.join(light(hits), same, "left_anti")
