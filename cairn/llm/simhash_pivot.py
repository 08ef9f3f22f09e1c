"""SimHash near-duplicates through pivot distance tables.

Fingerprints.  Text is lower-cased (A-Z), split into words, and each shingle of four words (fewer words: all of them) is
hashed by XXH64 with seed 42.  A bit is set when over half the hashes, repeats included, have it.  No words: zero.

Candidates.  The distances of a fingerprint to many reference fingerprints are its coordinates; two fingerprints within four bits differ by four
at most in every coordinate, so a pair whose coordinates differ by more is discarded, and the Hamming distance of the rest is checked.  Coordinates of random
fingerprints lie so close together (half of all pairs pass one, one pair in some thousands passes sixteen) that they cannot be keys: looking
through all pairs takes quadratic time.  So rows first meet by keys that no link crosses: the 64 bits fall into five blocks, and two fingerprints within four bits
are equal in one of them.  A key that holds more than ``LIMIT`` fingerprints is split by five blocks of its remaining bits, and so on:
five rows a fingerprint at each level, the same rule at every size.  Within a key, rows are sorted by their first coordinate.

Large groups.  Equal fingerprints are one row from the start.  A group emits a spanning forest of its links, never its pairs.  Components come from
alternating large-star and small-star steps over those edges, each written to the shared folder.

Defined results: null text counts as empty; empty texts share fingerprint zero and link like any other; repeated rows come
back once each; a very long text is read whole, alone in its slice; ids are of any type; null ids take part, and a component's id is its smallest non-null ``doc_id`` (null if it has none); an
empty table gives an empty result; other columns of the input are not read, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .textblock import mixed, slices

NEAR = 4
WORDS = 4
SEED = 42
LIMIT = 1000
#: Levels of splitting: 64 bits less a fifth at each level are 16 after six, so a key that deep holds fingerprints that are equal in 48 bits, 65,536 at most.
DEEPEST = 6


def fingerprint(raw: bytes) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(text)]
    take = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[:take], ends[min(WORDS, len(words)) - 1 :])])
    votes = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(take, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > take).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and ``__fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                raw = part.column("__text").cast(pa.large_binary()).to_pylist()
                fps = np.array([fingerprint(t or b"") for t in raw], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], [*keep, "__fp"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, f"{fields}, __fp bigint")


BLOCKS = NEAR + 1


def free_bits(path: int) -> list[list[int]]:
    """The blocks of bits that a key may be split by next; ``path`` holds the blocks chosen so far as octal digits, from 1."""
    bits = list(range(64))
    for digit in oct(path)[2:].lstrip("0"):
        chosen = _dealt(bits)[int(digit) - 1]
        bits = [b for b in bits if b not in chosen]
    return _dealt(bits)


def _dealt(bits: list[int]) -> list[list[int]]:
    return [bits[len(bits) * i // BLOCKS : len(bits) * (i + 1) // BLOCKS] for i in range(BLOCKS)]


def split_keys(path: int, keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Path and keys of the rows in each block of what a key leaves free; none where fewer bits than blocks are left."""
    blocks = free_bits(path)
    for i, block in enumerate(blocks if min(map(len, blocks)) else []):
        below = path * 8 + i + 1
        part = fps & np.uint64(sum(1 << b for b in block))
        with np.errstate(over="ignore"):
            yield below, mixed(keys + mixed(part + mixed(np.full(len(fps), below, np.uint64))))


def coordinates(fps: np.ndarray, references: int = 16) -> np.ndarray:
    """Distances to the full-width references, one row for each reference; the references follow from their number."""
    chosen = mixed(np.arange(1, references + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([np.bitwise_count(fps ^ r).astype(np.int16) for r in chosen])


def tables(rows: DataFrame) -> DataFrame:
    """The next level of rows ``path, key, fp``: one for each block that the path leaves free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_numpy()
            keys, fps = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
            for path in np.unique(paths).tolist():
                own = paths == path
                for below, key in split_keys(path, keys[own], fps[own]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), below)), pa.array(key.view(np.int64)), pa.array(fps[own].view(np.int64))], ["path", "key", "fp"])

    return rows.select("path", "key", "fp").mapInArrow(run, "path bigint, key bigint, fp bigint")


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after linking a[i] with b[i]; a label is the smallest index of its component."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def near_forest(keys: np.ndarray, fps: np.ndarray, near: int = NEAR, references: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, root) of a spanning forest of the links inside each key's group; every row but the roots stands once on the left."""
    table = coordinates(fps, references)
    order = np.lexsort((table[0], keys))
    keys, fps, table = keys[order], fps[order], table[:, order]
    n = len(keys)
    ends = np.searchsorted(keys, keys, "right")
    labels = np.arange(n)
    active, shift, left, right, held = np.arange(n), 0, [], [], 0
    while len(active):
        shift += 1
        active = active[active + shift < ends[active]]
        active = active[table[0, active + shift] - table[0, active] <= near]
        a, b = active, active + shift
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
        for row in table[1:]:
            close = np.abs(row[a] - row[b]) <= near
            a, b = a[close], b[close]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= near
        left.append(a[close])
        right.append(b[close])
        held += int(close.sum())
        if held > 200_000:
            labels, left, right, held = _joined(labels, np.concatenate(left), np.concatenate(right)), [], [], 0
    if left:
        labels = _joined(labels, np.concatenate(left), np.concatenate(right))
    child = np.flatnonzero(labels != np.arange(n))
    return order[child], order[labels[child]]


def _forests(rows: DataFrame) -> DataFrame:
    """``near_forest`` of every key; rows of a key meet in one task, at most ``LIMIT`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            if len(keys) < 50_000:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            yield edges(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
        yield edges(keys, fps)

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = near_forest(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (a, b)], ["u", "v"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint")


def links(classes: DataFrame) -> DataFrame:
    """Edges ``u, v`` between fingerprints whose components are those of all links."""
    zero = F.lit(0).cast("bigint")
    rows, edges = tables(classes.select(zero.alias("path"), zero.alias("key"), "fp")), None
    while True:
        rows = written(rows, "tables")
        # Keys of the deepest level stay whole.
        large = written(rows.groupBy("path", "key").count().filter(F.col("count") > LIMIT).filter(F.col("path") < 8**DEEPEST).select(F.col("key").alias("large_key")), "large-keys")
        some = written(_forests(rows.join(large, F.col("key") == F.col("large_key"), "left_anti")), "forests")
        edges = some if edges is None else edges.unionByName(some)
        if large.isEmpty():
            return edges
        below = written(tables(rows.join(large, F.col("key") == F.col("large_key"), "left_semi")), "below")
        dropped(rows, large)
        rows = below


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that an edge ``u, v`` links to a smaller one; the root is the component's smallest."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = print_of(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = written(moved.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        for old in (now, least, large, least2):
            dropped(old)
        now, before, state = after, state, print_of(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(prints: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint of ``prints`` (``doc_id, __fp``)."""
    classes = written(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes))
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = written(both.join(classes, both.node == classes.fp).groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    moved = written(both.join(lowest, "root").select(F.col("node").alias("fp"), "root", "component_id"), "moved")
    named = classes.join(moved, "fp", "left")
    return written(named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = written(fingerprints(docs), "fingerprints")
    joined = prints.join(grouped(prints), F.col("__fp") == F.col("fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
