"""Mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by a seeded hash and queue up, ``repeats`` times over.  They are served as packets: a document, or a part of one, of at most
a thousandth of its source's target.  A packet's virtual finish time is the source's cumulative words up to its end, divided by the source's
target.  All packets of all queues are sorted together by finish time, and the order is truncated where its running total
reaches the budget, the sum of targets; the packet that the cut meets is taken as far as the budget goes.  A document's words are those of its own packets.

Every source has twice its words to give and no target is above that, so at virtual time 1 each has been served its target, within one packet.

Targets.  Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops
at ``repeats`` times the source's size, and the excess goes to the others by weight until none is above.

Scale.  Running sums are taken in two steps: each source's hash range is cut into about sqrt(rows) buckets, the sums of buckets are
accumulated, and rows are accumulated inside their bucket.  The same holds for the order of all queues: ranges of finish time are summed first, ranges
past the budget drop out, and the rest are sorted each by itself.  So no task holds a source or the whole order; one task holds a row for each source and
one for each range.  Texts are read once, for their sizes; the sizes are a narrow table.  A long text becomes packets, at most some thousands for each
source beyond the number of documents.

Defined results: null text counts as empty (size 0, nothing taken); a null source is a source of its own, the last; rows
that are equal in every column used are interchangeable, and each gets its own place in the queue; null ids are kept; ids are of any
type; an empty table gives an empty result; of other columns only those of ``keep`` pass through, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, fresh_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: Packets that a source's target holds at least.
PACKETS = 1000


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row, doc_id, source, size``, the place ``h`` of each document in its shuffled queue, and ``keep`` as ``keep_0`` and so on; ``row`` numbers the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(F.lit("queue"), F.col("doc_id"), text).alias("h"),
        *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``source, source_size, docs, target``: a row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # One row a source: the row number and the levels below need all of them in order, and only them.
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    # Sources saturate in the order of cap / weight.  With those before one saturated, the level of the rest is (total - their caps) / the rest's weight.
    rows = by_source.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * repeats)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    total = F.sum(F.col("source_size").cast("double")).over(all_rows) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    own = rows.withColumn("level", level)
    # The first source that does not saturate at its level sets the level of all that follow.
    ratio = F.col("cap") / F.col("w")
    first = -F.min(F.when(ratio > F.col("level"), F.struct(ratio.alias("ratio"), (-F.col("level")).alias("down")))).over(all_rows)["down"]
    return own.select("source", "source_size", "docs", F.when(first.isNull() | (F.col("cap") <= first * F.col("w")), F.col("cap")).otherwise(first * F.col("w")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _bucket(h: Column, buckets: Column) -> Column:
    """Bucket of a signed hash, of so many equal ranges."""
    return F.least((buckets - 1).cast("bigint"), F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * buckets)).cast("bigint")


def queued(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Each row with its source's figures and ``before``, the words of its queue that stand before it."""
    rows = (
        sizes.alias("s").join(goals.withColumnRenamed("source", "goal_source"), _same(F.col("source"), F.col("goal_source")))
        .drop("goal_source").withColumn("bucket", _bucket(F.col("h"), F.ceil(F.sqrt("docs"))))
    )
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    past = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_size").over(past), F.lit(0)).alias("bucket_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = here.join(starts, _same(F.col("source"), F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.withColumn("before", F.col("bucket_before") + F.col("inside")).drop("b_source", "b_bucket", "bucket_before", "inside", "bucket", "docs")


def packets(queue: DataFrame, repeats: int) -> DataFrame:
    """``row, source, h, doc_id, pass, part, words, finish``: every packet of every pass of the queues, uncut."""
    most = F.greatest(F.lit(1), F.ceil(F.col("target") / PACKETS)).cast("bigint")
    parts = F.ceil(F.col("size") / F.col("most")).cast("int")
    rows = queue.filter("size > 0").withColumn("most", most)
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    end = F.least(F.col("size"), (F.col("part") + 1) * F.col("most"))
    rows = rows.withColumn("words", end - F.col("part") * F.col("most"))
    finish = (F.col("pass") * F.col("source_size") + F.col("before") + end) / F.col("target")
    return rows.select("row", "source", "h", "doc_id", "pass", "part", "words", finish.alias("finish"))


def cut(waiting: DataFrame, budget: int) -> DataFrame:
    """The packets in order of finish time as far as the budget goes: ``words`` of the one that the cut meets is what is left for it."""
    ranges = max(1, int(waiting.count() ** 0.5))
    # Ranges past time 2 share one sum: the budget is spent about time 1, so they start past it.
    place = F.least(F.lit(2.0 * ranges), F.floor(F.col("finish") * ranges)).cast("bigint")
    rows = waiting.withColumn("place", place)
    past = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("place").agg(F.sum("words").alias("s")).select(F.col("place").alias("p"), F.coalesce(F.sum("s").over(past), F.lit(0)).alias("range_before"))
    open_ = rows.join(sums.filter(F.col("range_before") < budget), F.col("place") == F.col("p"))
    inside = Window.partitionBy("place").orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "pass", "part", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.least(F.col("words"), F.lit(budget) - F.col("range_before") - F.coalesce(F.sum("words").over(inside), F.lit(0)))
    return open_.withColumn("words", left).filter("words > 0").drop("place", "p", "range_before")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, h, before, taken`` and ``keep``: a row for each row of ``docs``, with the words that the mix takes."""
    sizes = written(sized(docs, keep), "sizes")
    goals = written(targets(sizes, weights, share, repeats), "targets")
    budget = round(goals.agg(F.sum("target")).first()[0] or 0.0)
    queue = written(queued(sizes, goals), "queue")
    dropped(sizes, goals)
    taken = cut(packets(queue, repeats), budget).groupBy(F.col("row").alias("taken_row")).agg(F.sum("words").alias("taken"))
    out = queue.join(taken, F.col("row") == F.col("taken_row"), "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    return out.select("doc_id", "source", "size", "source_size", "target", "h", "before", "taken", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes a document.

    A document of which the mix takes a part keeps the words served, joined by single spaces.  Texts do not go through the queues: they are
    written once with a row number, and join the words taken by it.
    """
    number, words, size = fresh_name(docs, "row_number"), fresh_name(docs, "words_taken"), fresh_name(docs, "words_all")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    taken = mix(rows, weights, share, repeats, keep=(number,))
    passes = [F.least(F.col("size"), F.greatest(F.lit(0), F.col("taken") - F.col("size") * k)) for k in range(repeats)]
    parts = taken.select(number, F.col("size").alias(size), F.explode(F.array(*passes)).alias(words)).filter(F.col(words) > 0)
    joined = rows.join(written(parts, "parts"), number)
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), F.col(words).cast("int")), " ")
    text = F.when(F.col(words) < F.col(size), start).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)
