"""Near copies by wide SimHash prints, pivot distance tables and exact Jaccard similarity: the form of near-duplicate removal for a pipeline.

Prints.  A text's set of word shingles (lower-cased A-Z; fewer words: all of them) is hashed to 64 bits a shingle, and a bit of its print of 256 bits is set
when over half the set's hashes, taken anew for each 64 bits, have it.  Two sets of Jaccard similarity ``s`` have prints that differ in each bit with
probability ``acos(2 s / (1 + s)) / pi``, 0.15 at 0.8.

Candidates.  Texts of equal prints are one class.  A table's key is a sample of the print's bits; so many tables are made that a pair at the threshold
meets in one of them with probability ``MEET``, and so many bits sampled that a key holds a few unrelated prints.  Inside a key, distances to pivots, two of its own prints, are
a table that discards pairs, as no two prints within ``WIDE`` bits are further apart in it than ``WIDE``; pairs that are left are compared by all 256 bits.  Prints that differ in at most ``WIDE`` are joined by pairs that were compared: each joins two groups of the key that no pair had joined before, so a dense key emits about a pair a row.  A key of more than ``LIMIT``
prints is joined as a whole, without a look at the prints: that makes components coarser, and loses nothing.

Verification.  The sets of shingles of a component meet in a task, which searches it breadth first: a text is compared, by the exact Jaccard similarity
of the sets, with those not yet reached whose prints are within ``WIDE``, so a group of copies takes about a comparison a member.  A component of more than ``SHINGLES`` shingles is dealt out in chunks, in three steps.
Each chunk is searched; a few members of each group found meet, which joins most groups of large ones; and then every row outside the component's largest group meets every row of another group, chunk by chunk. So
the links are those of one task for the whole component.  The last step costs the rows outside the largest group times all rows: little where copies have many copies, the square where a component's texts are many
and all close to the threshold without reaching it.

Defined results: null text counts as empty, and texts without words are copies of each other; a very long text is read whole; repeated rows are copies; of rows that tie for the smallest id any one stays; an empty
table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, fresh_name, written
from .simhash_pivot import _joined, components
from .textblock import flat, mixed, slices, span_hashes, word_spans

MEET = 0.9
WIDE = 54
LIMIT = 2000
SHINGLES = 500_000
FEW = 16
PRINT = ("f0", "f1", "f2", "f3")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the set of shingles of each row, by row, and the row of each hash."""
    data, offsets = flat(column)
    starts, ends, rows = word_spans(data, offsets)
    own = span_hashes(_LOWER[data], starts, ends)
    n = len(own)
    many = np.bincount(rows, minlength=len(column))
    joined = own.copy()
    with np.errstate(over="ignore"):
        for j in range(1, words):
            inside = np.flatnonzero(rows[j:] == rows[: n - j]) if n > j else np.zeros(0, np.int64)
            joined[inside] = mixed(joined[inside] * np.uint64(3) + own[inside + j])
    begin = np.zeros(n, bool)
    begin[np.flatnonzero(np.diff(rows, prepend=-1))] = True
    whole = np.zeros(n, bool)
    if n >= words:
        whole[: n - words + 1] = rows[words - 1 :] == rows[: n - words + 1]
    taken = np.flatnonzero(whole | begin & (many[rows] < words))
    hashes, rows = joined[taken], rows[taken]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def prints(column: pa.Array, words: int) -> list[np.ndarray]:
    """The four parts of each row's print; zero without words."""
    hashes, rows = shingles(column, words)
    firsts = np.flatnonzero(np.diff(rows, prepend=-1))
    sizes = np.diff(np.append(firsts, len(rows)))
    out = []
    for part in range(len(PRINT)):
        with np.errstate(over="ignore"):
            own = mixed(hashes + np.uint64(part + 1) * np.uint64(0x9E3779B97F4A7C15))
        found = np.zeros(len(column), np.uint64)
        if len(firsts):
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
            votes = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
            found[rows[firsts]] = np.packbits(2 * votes > sizes[:, None], axis=1).reshape(-1, 8).copy().view(np.uint64)[:, 0]
        out.append(found)
    return out


def tables_for(count: int, similarity: float) -> list[np.ndarray]:
    """The bits that each table samples, for so many prints."""
    bits = int(min(40, max(16, ceil(log2(max(2, count))) - 2)))
    meets = (1 - acos(min(1.0, 2 * similarity / (1 + similarity))) / pi) ** bits
    tables = 1 if meets >= MEET else ceil(log(1 - MEET) / log(1 - meets))
    chance = np.random.default_rng(17)
    return [chance.choice(64 * len(PRINT), bits, replace=False) for _ in range(tables)]


def keyed(classes: DataFrame, samples: list[np.ndarray], whole: bool = True) -> DataFrame:
    """``key, class`` of each class and table, and its print where ``whole``."""
    names = ["class", *PRINT] if whole else ["class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c).to_numpy().view(np.uint64) for c in PRINT]
            for table, sample in enumerate(samples):
                key = np.full(batch.num_rows, table, np.uint64)
                for bit in sample.tolist():
                    key = key << np.uint64(1) | parts[bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c) for c in names)], ["key", *names])

    return classes.select("class", *PRINT).mapInArrow(run, "key bigint, " + ", ".join(f"{c} bigint" for c in names))


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows of sorted batches, ``least`` or more at a time, with the rows of a key together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column("key").to_numpy()
        if sum(b.num_rows for b in held) >= least and held[0].column("key")[0].as_py() != keys[-1]:
            begins = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if begins or len(held) > 1 and held[-2].column("key")[-1].as_py() != keys[-1]:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, begins)])
                held = [batch.slice(begins)]
    if held:
        yield pa.Table.from_batches(held)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which each two prints differ."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def near_pairs(keys: np.ndarray, prints_: np.ndarray, near: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places of compared pairs within ``near`` bits whose components are those of all such pairs; ``keys`` are sorted.

    A key's pivots are its first print and the one farthest from that; a pair whose distances to a pivot differ by more than ``near`` is never compared.
    """
    first = differing(prints_, prints_[np.searchsorted(keys, keys)])
    order = np.lexsort((first, keys))
    prints_, first, ends = prints_[order], first[order], np.searchsorted(keys, keys, "right")
    second = differing(prints_, prints_[ends - 1])
    labels = np.arange(len(keys))
    active, shift, left, right = np.arange(len(keys)), 0, [], []
    while len(active):
        shift += 1
        active = active[active + shift < ends[active]]
        active = active[first[active + shift] - first[active] <= near]
        a, b = active, active + shift
        open_ = (labels[a] != labels[b]) & (np.abs(second[a] - second[b]) <= near)
        a, b = a[open_], b[open_]
        close = differing(prints_[a], prints_[b]) <= near
        if close.any():
            a, b = a[close], b[close]
            left.append(a)
            right.append(b)
            labels = _joined(labels, a, b)
    none = np.zeros(0, np.int64)
    a, b = order[np.concatenate([none, *left])], order[np.concatenate([none, *right])]
    return np.minimum(a, b), np.maximum(a, b)


def candidates(classes: DataFrame, count: int, similarity: float) -> DataFrame:
    """Edges ``u, v`` between classes, whose components hold whatever meets in a table and is within ``WIDE`` bits."""
    samples = tables_for(count, similarity)
    large = keyed(classes, samples, False).groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("first")).filter(F.col("n") > LIMIT)
    large = written(large.select(F.col("key").alias("large_key"), "first"), "large-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, 50_000):
            classes_ = table.column("class").to_numpy()
            prints_ = np.stack([table.column(c).to_numpy().view(np.uint64) for c in PRINT], 1)
            a, b = near_pairs(table.column("key").to_numpy(), prints_)
            yield pa.RecordBatch.from_arrays([pa.array(classes_[a]), pa.array(classes_[b])], ["u", "v"])

    small = keyed(classes, samples).join(large, F.col("key") == F.col("large_key"), "left_anti")
    edges = small.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint")
    stars = keyed(classes, samples, False).join(large, F.col("key") == F.col("large_key")).filter(F.col("class") != F.col("first"))
    return edges.unionByName(stars.select(F.col("class").alias("u"), F.col("first").alias("v"))).distinct()


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """``class, set``: the hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, rows = shingles(part.column("text"), words)
                offsets = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["class", "set"])

    return texts.select("class", "text").mapInArrow(run, "class bigint, set array<bigint>")


def verified(prints_: np.ndarray, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Places (a, b) of a forest of links of the similarity, breadth first; rows of equal ``labels`` are linked already.

    The set of row i is ``values[offsets[i] : offsets[i + 1]]``, sorted.  A row is held against all rows that are not reached yet in one step.
    """
    sizes = np.diff(offsets)
    open_ = np.arange(len(sizes))
    while len(open_):
        first, open_ = open_[0], open_[1:]
        reached = deque([first])
        while reached and len(open_):
            a = reached.popleft()
            own = values[offsets[a] : offsets[a + 1]]
            linked = labels[open_] == labels[a]
            near = open_[~linked & (np.bitwise_count(prints_[open_] ^ prints_[a]).sum(1) <= WIDE)]
            near = near[sizes[near] > 0]
            found = near[:0]
            if len(near) and len(own):
                ends = np.cumsum(sizes[near])
                theirs = values[np.arange(ends[-1]) + np.repeat(offsets[near] - (ends - sizes[near]), sizes[near])]
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                both = np.add.reduceat((own[at] == theirs).astype(np.int64), ends - sizes[near])
                found = near[both >= similarity * (len(own) + sizes[near] - both) - 1e-9]
                yield from ((a, b) for b in found.tolist())
            gone = np.concatenate((open_[linked], found))
            reached.extend(gone.tolist())
            open_ = open_[~np.isin(open_, gone)]


def searched(rows: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` of the links found inside each ``key`` of rows ``key, class, label, f0.., set``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, 1000):
            keys, classes, labels = (table.column(c).to_numpy() for c in ("key", "class", "label"))
            prints_ = np.stack([table.column(c).to_numpy().view(np.uint64) for c in PRINT], 1)
            column = table.column("set").combine_chunks()
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)  # hashes are sorted without sign
            u, v = [], []
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                for a, b in verified(prints_[begin:end], values, offsets[begin : end + 1], labels[begin:end], similarity):
                    u.append(classes[begin + a])
                    v.append(classes[begin + b])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.select("key", "class", "label", *PRINT, "set").repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, "u bigint, v bigint")


def _chunks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chunks``, the number that each one's ``root`` is dealt out to."""
    sizes = rows.groupBy(F.col("root").alias("size_root")).agg(F.ceil(F.sum(F.size("set") + 16) / SHINGLES).alias("chunks"))
    return rows.join(sizes, F.col("root") == F.col("size_root")).drop("size_root")


def _relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the labels of their groups by the links found so far."""
    named = components(found).withColumnsRenamed({"node": "class", "root": "group"})
    return rows.drop("label").join(named, "class", "left").withColumn("label", F.coalesce("group", "class")).drop("group")


def across(rows: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """``found`` and the links between the chunks of large components, whose ``rows`` are labelled each by itself."""
    rows = written(_relabelled(rows, found), "labelled")
    place = F.row_number().over(Window.partitionBy("root", "label").orderBy(F.xxhash64("class"), "class"))
    few = _chunks(rows.withColumn("place", place).filter(F.col("place") <= FEW).drop("place"))
    met = written(searched(few.withColumn("key", F.xxhash64("root", F.pmod(F.xxhash64("class"), F.col("chunks")))), similarity), "links")
    found = found.unionByName(met)
    before, rows = rows, written(_relabelled(rows, found), "labelled")
    dropped(before)
    # Rows outside the largest group of their component meet those of all other groups, chunk by chunk.
    sizes = rows.groupBy("root", F.col("label").alias("group")).agg(F.sum(F.size("set") + 16).alias("size"))
    largest = sizes.groupBy(F.col("root").alias("its_root")).agg(F.max_by("group", F.struct("size", "group")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most"))
    largest = largest.filter(F.col("all") > F.col("most")).select("its_root", "largest", F.ceil((F.col("all") - F.col("most")) / SHINGLES).cast("int").alias("own"), F.ceil(F.col("most") / SHINGLES).cast("int").alias("others"))
    open_ = rows.join(written(largest, "largest"), F.col("root") == F.col("its_root"))
    outside, spread = F.col("label") != F.col("largest"), F.xxhash64("class")
    chunk = F.when(outside, F.pmod(spread, F.col("own"))).otherwise(F.col("own") + F.pmod(spread, F.col("others"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(outside, F.col("own") + F.col("others")).otherwise(F.col("own")) - 1))
    pairs = open_.withColumn("chunk", chunk).withColumn("other", other)
    return found.unionByName(searched(pairs.withColumn("key", F.xxhash64("root", F.least("chunk", "other"), F.greatest("chunk", "other"))), similarity))


def links(classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges ``u, v`` of the similarity between classes; their components are the groups."""
    roots = components(candidates(classes, classes.count(), similarity))
    members = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnsRenamed({"node": "class"}), "members")
    # A class is as its first document; only texts of classes in some component are cut into shingles.
    wanted = classes.join(members, "class").select("class", "root", *PRINT, F.col("row").alias("class_row"))
    own = texts.join(wanted, F.col("row") == F.col("class_row")).select("class", F.col("text").cast("string").alias("text"))
    rows = written(sets_of(own, words).join(wanted.drop("class_row"), "class").withColumn("label", F.col("class")), "sets")
    dealt = _chunks(rows)
    found = written(searched(dealt.withColumn("key", F.xxhash64("root", F.pmod(F.xxhash64("class"), F.col("chunks")))), similarity), "links")
    large = written(dealt.filter("chunks > 1").drop("chunks"), "large")
    dropped(rows, members)
    return found if large.isEmpty() else across(large, found, similarity)


def grouped(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``row, doc_id, group``: rows of ``texts`` (``row, doc_id, text``) with equal groups are copies of each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [pa.array(x.view(np.int64)) for x in prints(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *found], ["row", "doc_id", *PRINT])

    kind = texts.schema["doc_id"].dataType.simpleString()
    printed = texts.select("row", "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"row bigint, doc_id {kind}, " + ", ".join(f"{c} bigint" for c in PRINT))
    printed = written(printed, "prints")
    # Classes are numbered by their smallest row, which stands for them.
    classes = written(printed.groupBy(*PRINT).agg(F.min("row").alias("class")).withColumn("row", F.col("class")), "classes")
    found = written(links(classes, texts, words, similarity), "links")
    roots = components(found).withColumnsRenamed({"node": "class", "root": "group"})
    dropped(found)
    named = classes.select("class", *PRINT).join(roots, "class", "left").select(*PRINT, F.coalesce("group", "class").alias("group"))
    return printed.join(named, list(PRINT)).select("row", "doc_id", "group")


def copies(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``row`` of every row that is not the first of its group: that of the smallest id, null ids last."""
    rows = written(grouped(texts, words, similarity), "groups")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.select("row").join(first.select(F.col("first.row").alias("kept_row")), F.col("row") == F.col("kept_row"), "left_anti")


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id, null ids last; of rows that share it, any one.

    Groups are the components of links between texts whose sets of shingles of ``words`` words have a Jaccard
    ``similarity`` or more; texts without words are copies of each other.
    """
    number = fresh_name(docs, "row_number")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    gone = copies(rows.select(F.col(number).alias("row"), "doc_id", "text"), words, similarity)
    # The copies are the fewer rows; where they are few, Spark sends them to the texts.
    return rows.join(gone.select(F.col("row").alias(number)), number, "left_anti").select(*docs.columns)
