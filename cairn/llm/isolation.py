"""Quality rules: an isolation forest on rule statistics.

Counts of each document (words, code points, symbols, repeated lines and windows, and others) give ratios.  Each tree is grown on ``PER_TREE`` rows, as the method says, drawn from all good
labelled rows, but splits the whole space that ratios can take, so that trees isolate kinds of anomalies that no label shows; a document that few splits isolate is an anomaly.  The score is ``2 ** -(mean path / c)``, and its
threshold is calibrated on labelled rows that no tree has seen: the largest share of good rows above it is ``1 - recall`` (on all good ones where those are too few).

Scale.  Statistics are made in one pass over whole texts, as flat arrays; they are a narrow table.  The forest has a fixed size and is
broadcast.  Of the labelled rows only those that the trees draw reach the driver (``TREES * PER_TREE`` at most); bounds of the space and the threshold come from all of them, where they are.  Memory per task: some arrays of eight
bytes a byte of text for a slice of 1 MB, or for one text that is longer.  Repeated lines and windows are told by 64-bit hashes.

Defined results: null text counts as empty; fewer than 50 words, or over half of them in repeated windows, fail the base rules; without labelled
rows only the base rules hold; a very long text is read whole, alone in its slice; ids are of any type; equal texts are judged alike; repeated rows come back once each; null ids pass through; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import kth_largest, label_sample
from ..session import written
from .textblock import _SPACE, flat, mixed, slices, span_hashes, word_spans

SAMPLE = None  # rows of labels to read: all
TREES = 200
PER_TREE = 256
DEPTH = 24
RECALL = 0.998
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_BYTES = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_marks": _table(b"!?")}
_BYTES["word_chars"] = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every row."""
    data, offsets = flat(column)
    n = len(column)
    starts, ends, rows = word_spans(data, offsets)
    out = {"n_words": np.bincount(rows, minlength=n)}
    for name, table in _BYTES.items():
        total = np.concatenate(([0], np.cumsum(table[data])))
        out[name] = total[offsets[1:]] - total[offsets[:-1]]
    words = span_hashes(data, starts, ends)
    # Windows of three words inside a row, as hashes that also tell rows apart.
    inside = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        window = mixed(mixed(words[inside] * np.uint64(3) + words[inside + 1]) * np.uint64(3) + words[inside + 2])
        window = mixed(window + rows[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(window)
    equal = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    found = inside[twice]
    marked = np.zeros(len(words) + 2, bool)
    marked[found] = marked[found + 1] = marked[found + 2] = True
    out["n_repeat_words"] = np.bincount(rows[marked[: len(words)]], minlength=n)
    # Lines end at \n or with the row; those without a word do not count.
    breaks = np.flatnonzero(data == 10)
    firsts = np.unique(np.concatenate((offsets[:-1][offsets[1:] > offsets[:-1]], breaks + 1)))
    firsts = firsts[firsts < len(data)]
    owner = np.searchsorted(offsets, firsts, "right") - 1
    following = np.concatenate((breaks, [len(data)]))
    lasts = np.minimum(following[np.searchsorted(following, firsts)], offsets[owner + 1])
    letters = np.concatenate(([0], np.cumsum(~_SPACE[data])))
    full = letters[lasts] > letters[firsts]
    firsts, lasts, owner = firsts[full], lasts[full], owner[full]
    with np.errstate(over="ignore"):
        lines = mixed(span_hashes(data, firsts, lasts) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[one], minlength=n)
    return {name: out[name].astype(np.int64) for name in STATISTICS}


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[s]) for s in STATISTICS)], ["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} bigint" for s in STATISTICS))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """All statistics as ratios, one row a document: symbols and marks for each word, repeated words, upper-case letters, repeated
    lines for each line, the mean word length, and the length.

    The root spreads small ratios; word length is a logarithm between two and sixteen code points, and stays at the edge beyond them.
    """
    words, chars, lines = (np.maximum(s[name], 1).astype(float) for name in ("n_words", "word_chars", "n_lines"))
    ratios = np.sqrt(np.stack((s["n_symbols"] / words, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_marks"] / words, s["n_dup_lines"] / lines), 1))
    return np.column_stack((ratios, np.clip(np.log2(chars / words) - 1, 0, 3) / 3, np.log1p(words) / 25))


def _c(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, depth: int = DEPTH, seed: int = 11, chosen: list[np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The forest as arrays of shape (trees, nodes): feature (-1 at a leaf), split, left child (the right one is next to it), path length.

    ``low`` and ``high`` bound the space.  A node splits its part of the space anywhere, not only between its rows, so that empty
    parts, where no sampled row was, are cut off early.  ``chosen`` are the places in ``rows`` of each tree's rows, otherwise they are drawn here.
    """
    random = np.random.default_rng(seed)
    per_tree = min(per_tree, len(rows))
    usable = np.flatnonzero(high > low)
    grown = []
    for tree in range(trees):
        feature, split, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, 0, rows[random.choice(len(rows), per_tree, replace=False) if chosen is None else chosen[tree]], low, high)]
        while todo:
            node, level, own, a, b = todo.pop()
            if level == depth or len(own) <= 1 or not len(usable):
                path[node] = level + float(_c(len(own)))
                continue
            f = random.choice(usable)
            at = random.uniform(a[f], b[f])
            small = own[:, f] <= at
            feature[node], split[node], left[node] = f, at, len(feature)
            under, over = b.copy(), a.copy()
            under[f] = over[f] = at
            todo += [(len(feature), level + 1, own[small], a, under), (len(feature) + 1, level + 1, own[~small], over, b)]
            for name, value in ((feature, -1), (split, 0.0), (left, 0), (path, 0.0)):
                name += [value, value]
        grown.append((feature, split, left, path))
    nodes = max(len(t[0]) for t in grown)
    arrays = zip(("feature", "split", "left", "path"), (np.int64, float, np.int64, float), (-1, 0.0, 0, 0.0), zip(*grown))
    forest = {name: np.array([t + [fill] * (nodes - len(t)) for t in per], kind) for name, kind, fill, per in arrays}
    forest["norm"] = _c(per_tree)
    return forest


def anomaly(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Score of each row, near 1 for anomalies; every step of a tree is taken for all rows together."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for feature, split, left, path in zip(forest["feature"], forest["split"], forest["left"], forest["path"]):
        node = np.zeros(len(rows), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, left[node] + (rows[every, f] > split[node]), node)
        total += path[node]
    return 2.0 ** -(total / len(forest["feature"]) / max(float(forest["norm"]), 1e-9))


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {s: batch.column(s).to_numpy() for s in STATISTICS}


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number`` from 0, by a hash of ``sample_id``; counts of 4096 ranges place each range, and rows are sorted only inside theirs."""
    ranged = rows.withColumn("h", F.xxhash64("sample_id")).withColumn("part", F.pmod("h", F.lit(4096)).cast("int"))
    counts = np.zeros(4096, np.int64)
    for part, count in ranged.groupBy("part").count().collect():
        counts[part] = count
    first = F.array(*(F.lit(int(n)) for n in np.cumsum(counts) - counts))
    place = F.row_number().over(Window.partitionBy("part").orderBy("h", "sample_id"))
    return ranged.withColumn("number", F.get(first, F.col("part")).cast("bigint") + place - 1).drop("h", "part")


def _arrays(rows: DataFrame) -> dict[str, np.ndarray]:
    table = rows.select(*STATISTICS).toArrow()
    return {s: table.column(s).to_numpy() for s in STATISTICS}


def tree_rows(rows: DataFrame, count: int, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 12) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Features of the rows that trees are grown on, out of all ``count``, and which are each tree's: all rows (None) where they are no more than the trees take."""
    if count <= trees * per_tree:
        return features(_arrays(rows.orderBy("sample_id"))), None
    random = np.random.default_rng(seed)
    drawn = [random.choice(count, per_tree, replace=False) for _ in range(trees)]
    wanted = np.unique(np.concatenate(drawn))
    numbers = rows.sparkSession.createDataFrame(pa.table({"wanted": wanted}))
    own = numbered(rows).join(F.broadcast(numbers), F.col("number") == F.col("wanted")).orderBy("number")
    return features(_arrays(own)), [np.searchsorted(wanted, d) for d in drawn]


def _highest(rows: DataFrame) -> np.ndarray:
    """The largest value of each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = features(_columns(batch)).max(0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found)], ["feature", "value"])

    most = rows.select(*STATISTICS).mapInArrow(run, "feature int, value double").groupBy("feature").agg(F.max("value"))
    return np.array([value for _, value in sorted(most.collect())])


def judge(docs: DataFrame, labels: DataFrame, bound: int | None = SAMPLE, recall: float = RECALL) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` for every row."""
    stats = written(rule_statistics(docs), "statistics")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    sample = label_sample(labels, bound).select(F.col("doc_id").cast("string").alias("sample_id"), "good", "fold")
    # A row an id; of rows that share an id, the one of the smallest hash of its statistics.
    seen = stats.filter(~F.col("base_failed")).join(sample, F.col("doc_id").cast("string") == F.col("sample_id"))
    one = seen.groupBy("sample_id").agg(F.min_by(F.struct("good", "fold", *STATISTICS), F.struct(F.xxhash64(*STATISTICS), *STATISTICS)).alias("row"))
    rows = written(one.select("sample_id", "row.*"), "labelled")
    fitting, calibrating = rows.filter("good and fold = 0"), rows.filter("good and fold = 1")
    grown_on, held = fitting.count(), calibrating.count()
    if not grown_on or not held:
        return stats.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    # The space is all that ratios can be, and not only what labelled rows are: a kind of anomaly may have no label.
    high = np.maximum(_highest(rows.filter("fold = 0")), 1.0)
    values, chosen = tree_rows(fitting, grown_on)
    forest = grow(values, np.zeros(len(high)), high, chosen=chosen)
    if held * (1 - recall) < 1:  # too few rows for the share: all good rows stay
        calibrating, held = rows.filter("good"), grown_on + held
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = anomaly(shared.value, features(_columns(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    def scored(rows: DataFrame) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{fields}, score double")

    scores = written(scored(calibrating.select(*STATISTICS)).select("score"), "scores")
    threshold = kth_largest(scores, held - min(held - 1, int(np.ceil(held * recall))), "score")
    return scored(stats).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= threshold))
