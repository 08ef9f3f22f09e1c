"""Quality classifier by importance resampling.

Hashed n-gram models (bags of buckets) of target text, the good labelled rows, and of raw text, all documents, are
counted.  A document's log importance weight is the mean log ratio of the two models over its n-grams, times its words, of which at most ``EVIDENCE``
count: n-grams of one text are not independent, and length alone shall not decide.  Gumbel noise is added to the weight and the top k are kept:
sampling without replacement in proportion to the weights.  The draw decides among documents about as good as the k-th.

``k`` is given, or calibrated on labelled rows that the models have not seen: the number of documents whose weight, without noise, is that of all
but ``1 - recall`` of the good ones.

The n-grams are single words and pairs of words, and single shapes and pairs of shapes: the kinds of a word's first two and last two characters, and
whether it repeats the word before it.  A bucket's ratio is ``(t + s) / (e + s)`` of the count ``t`` in target text and ``e``, the count that raw text
makes expect there; the smoothing ``s`` draws rare n-grams to one.  Two n-grams of one bucket share its ratio.

Scale.  Counts are summed inside each task before anything leaves it: at most ``4 * BUCKETS`` counts a task, ``BLOCK`` in a row.  The k-th largest key is
found by counting into ranges, never by sorting all rows.  Only the model, of fixed size, reaches the driver; labelled rows meet their documents by joins, for which of the texts little more than the
target's is shuffled (``chosen``), and the cut of held-out ones is found by counting, too.  Texts are
never written: where other columns than the id are asked for, documents are scored a second time instead.

Defined results: null text counts as empty and has weight 0; a very long text is read whole, alone in its slice; equal texts get equal weights and equal noise; rows that tie with the
k-th are all kept; where an id repeats, its best row calibrates; without labelled good rows everything is kept; ids are of any type, and null ids are
never labelled; an empty table gives an empty result; of other columns those asked for pass through, except names that the result has itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, written
from .labelled import kth_largest, label_sample
from .textblock import flat, mixed, slices, span_hashes, word_spans

BUCKETS = 1 << 14
ORDERS = 4
BLOCK = 256  # buckets whose counts leave a task as one row
SMOOTHING = 2.0
EVIDENCE = 64
SAMPLE = None  # rows of labels to read: all
SLOTS = 1 << 24  # hashes of ids that a bit is kept for, 64 in a row: 262,144 rows at most
RECALL = 0.998
SEED = 7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes: 1 sign, 2 upper case, 3 lower case or beyond ASCII, 4 digit, 5 sentence mark.
_KIND = np.ones(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 2, 3, 3, 4
_KIND[list(b".,;:")] = 5


def ngrams(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of each order; words in each row; a hash of each row's text."""
    data, offsets = flat(column)
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(_LOWER[data], starts, ends)
    kind = _KIND[data].astype(np.uint64)
    shape = kind[starts] << np.uint64(9) | kind[np.minimum(starts + 1, ends - 1)] << np.uint64(6) | kind[np.maximum(ends - 2, starts)] << np.uint64(3) | kind[ends - 1]
    follows = rows[1:] == rows[:-1]
    repeats = np.zeros(len(words), np.uint64)
    repeats[1:] = follows & (words[1:] == words[:-1])
    shape = mixed(shape << np.uint64(1) | repeats)
    first = np.flatnonzero(follows)
    size, orders = np.uint64(BUCKETS), []
    with np.errstate(over="ignore"):
        for term in (words, shape):
            orders.append((rows, (term % size).astype(np.int64)))
            orders.append((rows[first], (mixed(term[first] * np.uint64(5) + term[first + 1]) % size).astype(np.int64)))
    return orders, np.bincount(rows, minlength=len(column)), span_hashes(data, offsets[:-1], offsets[1:])


def counted(texts: DataFrame) -> DataFrame:
    """``block, n``: how often each bucket of a block of ``BLOCK`` stands in the ``text`` of all rows, a row for each task that has seen the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ORDERS, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for order, (_, buckets) in enumerate(ngrams(part.column("text"))[0]):
                    total[order] += np.bincount(buckets, minlength=BUCKETS)
        blocks = total.reshape(-1, BLOCK)
        seen = np.flatnonzero(blocks.any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * BLOCK), pa.array(blocks[seen].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(seen), lists], ["block", "n"])

    return texts.select("text").mapInArrow(run, "block bigint, n array<bigint>")


def chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` (``id, text``) whose id is in ``ids`` (``target_id``, each once).

    A bit for each of ``SLOTS`` hashes of ids goes to all tasks and leaves most other texts out where they are read; the join decides on the rest.
    The join is of one kind at every size, so what is shuffled grows with the chosen texts.  It is no semi-join, which Spark would place before the bits.
    """
    slots = ids.select(F.pmod(F.xxhash64("target_id"), F.lit(SLOTS)).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits"))
    own = texts.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
    likely = own.join(bounded(words), (F.shiftright("slot", 6) == F.col("word")) & (F.bit_get("bits", (F.col("slot") % 64).cast("int")) == 1)).select("id", "text")
    return likely.join(ids.hint("shuffle_hash"), F.col("id") == F.col("target_id")).select("id", "text")


def counts(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Counts of each bucket in raw text and in the documents whose ids are in ``target``: shape (2, orders, buckets)."""
    ids = target.select(F.col("doc_id").cast("string").alias("target_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))

    def add(rows: pa.Table) -> pa.Table:
        lists, own = rows.column("n").combine_chunks().flatten().to_numpy().reshape(-1, BLOCK), rows.column("own").to_numpy()
        return pa.table({"block": rows.column("block")[:1], "raw": [lists[~own].sum(0)], "target": [lists[own].sum(0)]})

    both = counted(texts).withColumn("own", F.lit(False)).unionByName(counted(chosen(texts, ids)).withColumn("own", F.lit(True)))
    summed = both.groupBy("block").applyInArrow(add, "block bigint, raw array<bigint>, target array<bigint>")
    out = np.zeros((2, ORDERS * BUCKETS // BLOCK, BLOCK), np.int64)
    for block, raw, own in summed.collect():
        out[:, block] = raw, own
    return out.reshape(2, ORDERS, BUCKETS)


def log_ratios(count: np.ndarray) -> np.ndarray:
    """Log ratio of the target's to the raw model for each order and bucket; each n-gram order is a distribution of its own."""
    raw, own = count.astype(float)
    expected = raw * own.sum(1, keepdims=True) / np.maximum(1, raw.sum(1, keepdims=True))
    return np.log(own + SMOOTHING) - np.log(expected + SMOOTHING)


#: Columns that ``classify`` adds; those of ``docs`` that have these names give way.
ADDED = ("n_words", "log_weight", "key", "kept")


def scored(docs: DataFrame, ratios: np.ndarray, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all without it) with ``n_words``, ``log_weight`` and ``key``, the weight with its noise."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = len(keep)
            for part in slices(batch, batch.schema.names[text]):
                n = part.num_rows
                orders, words, texts = ngrams(part.column(text))
                mean = np.zeros(n)
                for ratio, (rows, buckets) in zip(model.value, orders):
                    mean += np.bincount(rows, ratio[buckets], minlength=n) / np.maximum(1, np.bincount(rows, minlength=n))
                weight = mean * np.minimum(words, EVIDENCE)
                uniform = ((mixed(texts + np.uint64(SEED)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                new = [pa.array(words.astype(np.int64)), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:text], *new], [*keep, "n_words", "log_weight", "key"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    named = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    return docs.select(*named, F.col("text").cast("string").alias("scored_text")).mapInArrow(run, f"{fields}n_words bigint, log_weight double, key double")


def fitted(docs: DataFrame, labels: DataFrame, bound: int | None = SAMPLE) -> tuple[np.ndarray, DataFrame]:
    """Log ratios, and the good labelled rows that are left for calibrating."""
    sample = written(label_sample(labels, bound).filter("good"), "labelled")
    return log_ratios(counts(docs, sample.filter("fold = 0"))), sample.filter("fold = 1")


def calibrated_k(scores: DataFrame, held_out: DataFrame, recall: float) -> int:
    """The number of documents that weigh like all but ``1 - recall`` of the held-out good ones."""
    ids = held_out.select(F.col("doc_id").cast("string").alias("held_id"))
    good = scores.select(F.col("doc_id").cast("string").alias("id"), "log_weight").join(ids.hint("shuffle_hash"), F.col("id") == F.col("held_id"))
    weights = written(good.groupBy("id").agg(F.max("log_weight").alias("weight")), "held-out")
    n = weights.count()
    return scores.filter(F.col("log_weight") >= kth_largest(weights, n - int(n * (1 - recall)), "weight")).count()


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, recall: float = RECALL, bound: int | None = SAMPLE, keep: Sequence[str] | None = None) -> DataFrame:
    """``doc_id`` and the columns ``keep`` of ``docs`` (all without it) with ``n_words, log_weight, key, kept`` for every row.

    Scores are written once, with ids only, as they are read for the cut.
    """
    ratios, held_out = fitted(docs, labels, bound)
    scores = written(scored(docs, ratios, ["doc_id"]), "weights")
    cut = kth_largest(scores.select("key"), calibrated_k(scores, held_out, recall) if k is None else k)
    wanted = list(dict.fromkeys(["doc_id", *(docs.columns if keep is None else keep)]))
    return (scores if wanted == ["doc_id"] else scored(docs, ratios, wanted)).withColumn("kept", F.col("key") >= F.lit(cut))
