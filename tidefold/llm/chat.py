"""Chat formatting in budgeted windows, in Spark's own functions.

A conversation's turns, ordered by turn (then role, then text), are numbered in two levels: within chunks of PAGE turn
values, then over the chunks. From the conversation's start on, turn-aligned spans take turns as
long as they fit into BUDGET less HISTORY less the system turn's tokens (a single longer turn is
a span of its own); tokens are words plus MARKS. A window is the conversation's first system turn, then history (as many of
the turns right before the span as fit into HISTORY), then the span. The loss mask covers the texts
of assistant turns of the span only: what is repeated is masked, so each assistant text is a target once.

Method. A page is PAGE turns by their numbers, so that no task gathers more. As a turn has MARKS tokens at least, a span or a history
has a bounded number of turns: a page also gets the turns that spans may take beyond its end, and those that histories may take before
its start. A page's spans depend on where the first one starts; each page says for every possible start where
the next page's first span starts, these short lists are followed along the conversation, and each page then makes its windows.

Template, one turn: `<|im_start|>` role newline text `<|im_end|>` newline. Inside roles and texts
a backslash is doubled and `<|` becomes `<\\|`; in roles a newline becomes `\\l`.
So no control string can come from a text, and `unescaped` gives the original back.

Defined cases: null text and null role are empty; a null turn comes first; a null conv_id
is a conversation; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small
from .mixing import n_words

BUDGET, HISTORY, MARKS, PAGE = 512, 128, 4, 256
START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    """The text before escaping: doubled backslashes are single ones, and between them the other escapes are undone."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, page, window, repeated, formatted, loss): the text of each window, how many of its
    first turns are repeated, and the loss mask as (start, length) in code points of the text."""
    scratch = Scratch(turns.sparkSession, "chat")
    ahead, back = max(1, (budget - history) // MARKS), max(0, history // MARKS)
    page = max(PAGE, ahead, back)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.floor(F.col("turn") / PAGE).alias("chunk"), "turn", role.alias("role"), text.alias("text"))
    within = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = scratch.save(rows.withColumn("place", F.row_number().over(within) - 1))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    chunks = scratch.save(chunks.select(F.col("conv_id").alias("of"), F.col("chunk").alias("chunk2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past")))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("chunk").eqNullSafe(F.col("chunk2"))
    piece = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\l")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    rows = rows.join(small(chunks, chunks.count()), same).select(
        "conv_id", (F.col("past") + F.col("place")).alias("i"), "turn", "role", "text",
        (n_words(F.col("text")) + MARKS).alias("n"), piece.alias("piece"), F.length(escaped(F.col("text"))).alias("body"),
    )
    turn = F.struct("i", "turn", "role", "text", "n", "piece", "body")
    system = rows.where("role = 'system'").groupBy("conv_id").agg(F.min(turn).alias("sys")).withColumnRenamed("conv_id", "of")
    own = f"i div {page}"
    places = f"concat(array({own}), if({own} > 0 and i % {page} < {ahead}, array({own} - 1), array()), if(i % {page} >= {page - back}, array({own} + 1), array()))"
    pages = rows.withColumn("page", F.explode(F.expr(places))).groupBy("conv_id", "page").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    pages = pages.withColumn("lo", F.expr(f"size(filter(t, x -> x.i < page * {page}))")).withColumn("hi", F.expr(f"size(filter(t, x -> x.i < (page + 1) * {page}))"))
    pages = pages.where("lo < hi").join(system, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    pages = pages.withColumn("cum", F.expr("aggregate(t, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.n)))"))
    # of each of the page's turns: where the span that starts there ends
    room = f"greatest(1L, {budget - history} - coalesce(sys.n, 0L))"
    after = f"array_min(filter(sequence(p + 1, least(p + {ahead}, size(t) - 1)), q -> cum[q + 1] - cum[p] > {room}))"
    pages = pages.withColumn("next", F.expr(f"transform(sequence(lo, hi - 1), p -> if(p + 1 < size(t), coalesce({after}, size(t)), size(t)))"))
    pages = scratch.save(pages)
    leaves = "aggregate(reverse(sequence(0, hi - lo - 1)), cast(array() as array<int>), (a, k) -> concat(array(if(next[k] >= hi, next[k] - hi, a[next[k] - lo - k - 1])), a))"
    leaves = pages.select("conv_id", "page", F.expr(f"slice({leaves}, 1, {ahead})").alias("leaves"))
    m = leaves.groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("page", "leaves"))).alias("m"))
    enter = "aggregate(m, array(0), (a, x) -> concat(a, array(if(element_at(a, -1) < size(x.leaves), x.leaves[element_at(a, -1)], 0))))"
    enter = m.withColumn("enter", F.expr(enter)).select("of", F.posexplode("enter").alias("k", "enter"), "m").where("k < size(m)")
    enter = scratch.save(enter.select("of", F.expr("m[k].page").alias("page2"), "enter"))
    pages = pages.join(small(enter, enter.count()), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("page") == F.col("page2")))
    starts = "aggregate(sequence(lo, hi), array(lo + enter), (a, x) -> if(element_at(a, -1) < hi, concat(a, array(next[element_at(a, -1) - lo])), a))"
    pages = pages.withColumn("starts", F.expr(f"filter({starts}, x -> x < hi)"))
    w = pages.select("*", F.posexplode("starts").alias("window", "start"))
    w = w.withColumn("end", F.expr("next[start - lo]"))
    w = w.withColumn("from", F.expr(f"array_min(filter(sequence(0, start), h -> cum[start] - cum[h] <= {history}))"))
    # the system turn stands first; where it is among the history or the span it is not added again
    has = "exists(slice(t, from + 1, end - from), x -> x.role = 'system' and x.turn <=> sys.turn and x.text = sys.text)"
    w = w.withColumn("lead", F.expr(f"if(sys is null or {has}, array(), array(sys))"))
    w = w.withColumn("all", F.expr("concat(lead, slice(t, from + 1, end - from))"))
    w = w.withColumn("repeated", F.expr("size(lead) + start - from"))
    w = w.withColumn("ends", F.expr("aggregate(`all`, array(0), (a, x) -> concat(a, array(element_at(a, -1) + length(x.piece))))"))
    tail = len(END) + 1
    spans = f"filter(transform(`all`, (x, i) -> if(i >= repeated and x.role = 'assistant', struct(ends[i + 1] - {tail} - x.body as start, x.body as length), null)), x -> x is not null)"
    return w.select("conv_id", "page", "window", "repeated", F.expr("array_join(transform(`all`, x -> x.piece), '')").alias("formatted"), F.expr(spans).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations from their windows alone: turns that are not repeated, and the text under the loss mask."""
    end = END.replace("|", r"\|") + "\n"
    turns = F.expr("slice(parts, repeated + 1, size(parts) - 1 - repeated)")
    w = formatted.withColumn("parts", F.split("formatted", end, -1)).withColumn("new", turns)
    head = lambda p: F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1)
    whole = lambda p: F.concat(unescaped(head(p)), F.lit("\n"), unescaped(F.substr(p, F.length(head(p)) + len(START) + 2)), F.lit("\n"))
    loss = F.array_join(F.transform("loss", lambda x: unescaped(F.substr(F.col("formatted"), x["start"] + 1, x["length"]))), "")
    w = w.select(
        "conv_id", "page", "window", F.size("new").cast("long").alias("n"), F.array_join(F.transform("new", whole), "").alias("turns"),
        loss.alias("loss"), F.length("formatted").cast("long").alias("chars"),
    )
    by = w.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("page", "window", "turns", "loss"))).alias("w"),
    )
    sha = lambda c: F.sha2(F.array_join(F.transform("w", lambda x: x[c]), ""), 256)
    return by.select("conv_id", "n_turns", sha("turns").alias("turns_sha256"), "loss_chars", sha("loss").alias("loss_sha256"), "formatted_chars")
