"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction.  For each cluster the rows to search are sorted once, by an upper bound of their inner product with any member: the
row's norm times the cosine of its angle to the centroid less the cluster's spread (the largest angle of a member).  Every member walks that list from the top
and stops when its own norm times the next bound is below what it still needs, so a stop is certified and the result exact, whatever the clusters are.

Two walks.  The first finds an anchor's positives, and needs its k-th best score so far; the second finds the negatives of each positive, and needs the smallest score
that a window still takes, or the last one held once a window is full.  Rows with equal bounds and scores are all seen, so ties fall by id.

Scale.  Rows are dealt to blocks by hash, anchors to parts of whole clusters (a cluster of more than ``PART`` anchors goes to several parts).  A task gets one part and one block, holds
the list of each cluster of that part over that block, and emits at most k rows an anchor or window; the best of all blocks are ranked by windows that keep k rows a
task.  Labels deal nothing, so a hot label skews nothing.  To the driver come a sample of ``SAMPLE`` anchors, for the centroids, and a count for each of at most ``CLUSTERS`` clusters.
Vectors without structure, such as random ones of many dimensions, leave bounds that certify little: then the work is all anchors times all rows, in blocks.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite, take no part; where an id repeats, the row of the smallest label, then vector,
stands for it; vectors of different lengths meet as if the shorter went on with zeros; components are held within 2 ** 22 after scaling, so that every product fits; ties fall to the smaller id; equal vectors
are rows like any others; an empty table gives an empty result; other columns are not read, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
BLOCK, PART = 32_768, 8_192
SAMPLE, CLUSTERS = 2_000, 32
CHUNK = 512
_BOUND = 1 << 22
_LOW, _NO_ID = -(1 << 62), (1 << 63) - 1


def prepared(embeddings: DataFrame, scale: int = 256, shift: int = 7, labels: int = 10) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part, ``q`` the integer components; the label of every ``shift``-th id is the next one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    part = embeddings.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("bigint")
    q = F.transform("embedding", lambda x: F.greatest(F.lit(-_BOUND), F.least(F.lit(_BOUND), F.floor(x.cast("double") * scale))).cast("int"))
    rows = part.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors of a list column as rows of ``width``, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The ``k`` highest scores of each slot, ties to the smaller id, in order."""

    def __init__(self, slots: int, k: int):
        self.scores, self.ids = np.full((slots, k), _LOW), np.full((slots, k), _NO_ID)

    def take(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores[i, j]`` of row ``ids[j]`` for slot ``slots[i]``; the lowest number where a slot does not take the row."""
        some = np.flatnonzero(((scores >= self.scores[slots, -1:]) & (scores > _LOW)).any(1))
        if not len(some):
            return
        slots, scores = slots[some], scores[some]
        every = np.concatenate((self.scores[slots], scores), 1)
        names = np.concatenate((self.ids[slots], np.where(scores > _LOW, ids, _NO_ID)), 1)
        order = np.lexsort((names, -every), axis=1)[:, : self.scores.shape[1]]
        self.scores[slots], self.ids[slots] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, id and score of everything held."""
        slot, place = np.nonzero(self.scores > _LOW)
        return slot, self.ids[slot, place], self.scores[slot, place]


def shared_list(members: np.ndarray, centroid: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of the bound, and their bounds: a member's product with a row is at most its norm times the row's bound."""

    def angles(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        cosine = vectors @ centroid / np.maximum(norms, 1e-300)
        return norms, np.where(norms > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)

    spread = float(angles(members)[1].max(initial=0.0)) + 1e-6
    norms, angle = angles(rows)
    bound = norms * np.cos(np.maximum(0.0, angle - spread))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(members: np.ndarray, centroid: np.ndarray, rows: np.ndarray, need: Callable[[np.ndarray], np.ndarray], visit: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> int:
    """Hold every member against its cluster's list until ``need`` of it is above all that follows; gives the pairs compared.

    ``visit(members, rows, scores)`` takes places of both and their products.
    """
    order, bound = shared_list(members, centroid, rows)
    own = np.sqrt((members.astype(np.float64) ** 2).sum(1))
    active, compared = np.arange(len(members)), 0
    for at in range(0, len(order), CHUNK):
        reach = own[active] * bound[at]
        active = active[need(active) <= reach + np.abs(reach) * 1e-9 + 0.5]
        if not len(active):
            break
        places = order[at : at + CHUNK]
        visit(active, places, products(members[active], rows[places]))
        compared += len(active) * len(places)
    return compared


def centroids_of(vectors: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly spaced rows; the vectors come in an order of their own."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1, keepdims=True))
    unit = (vectors / np.maximum(norms, 1e-300))[norms[:, 0] > 0]
    if not len(unit):
        return np.eye(1, max(1, vectors.shape[1]))[:, : vectors.shape[1]]
    now = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ now.T).argmax(1)
        sums = np.stack([unit[nearest == c].sum(0) for c in range(len(now))])
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        now = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), now)
    return now


def _of_clusters(left: pa.Table, right: pa.Table, centroids: np.ndarray, width: int):
    """Rows and their ids and labels, then place, ids, labels and vectors of the anchors of each cluster."""
    rows = matrix(right.column("q"), width)
    ids, labels = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
    clusters, vectors = left.column("cluster").to_numpy(), matrix(left.column("q"), width)
    return rows, ids, labels, [(own, centroids[c], vectors[own]) for c in np.unique(clusters) for own in [np.flatnonzero(clusters == c)]]


def positives_of(anchors: pa.Table, block: pa.Table, centroids: np.ndarray, width: int, k: int = POSITIVES) -> pa.Table:
    """``anchor_id, positive_id, positive_score``: the best ``k`` other rows of the same label in one block."""
    rows, ids, labels, clusters = _of_clusters(anchors, block, centroids, width)
    own_ids, own_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    out = []
    for own, centroid, vectors in clusters:
        best = Best(len(own), k)

        def visit(members: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
            fits = (own_labels[own[members], None] == labels[places]) & (own_ids[own[members], None] != ids[places])
            best.take(members, np.where(fits, scores, _LOW), ids[places])

        walk(vectors, centroid, rows, lambda members: best.scores[members, -1].astype(np.float64), visit)
        slot, found, scores = best.rows()
        out.append((own_ids[own[slot]], found, scores))
    return pa.table([np.concatenate(x) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3, ["anchor_id", "positive_id", "positive_score"])


def negatives_of(anchors: pa.Table, block: pa.Table, centroids: np.ndarray, width: int, k: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> pa.Table:
    """``anchor_id, positive_id, positive_score, negative_id, negative_score``: the best ``k`` rows of other labels in each positive's window, in one block."""
    rows, ids, labels, clusters = _of_clusters(anchors, block, centroids, width)
    own_ids, own_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    positives = anchors.column("positives").to_pylist()
    out = []
    for own, centroid, vectors in clusters:
        window = [[(p["positive_id"], p["positive_score"]) for p in positives[i] if p["positive_score"] >= 0] for i in own]  # no window lies below zero
        wide = max(map(len, window), default=0)
        score = np.array([[s for _, s in w] + [-1] * (wide - len(w)) for w in window], np.int64).reshape(len(own), wide)
        best = Best(len(own) * wide, k)

        def need(members: np.ndarray) -> np.ndarray:
            last = best.scores.reshape(len(own), wide, k)[members, :, -1]
            open_ = np.where(last > _LOW, last, -(-least * score[members] // 100)).astype(np.float64)
            return np.where(score[members] >= 0, open_, np.inf).min(1, initial=np.inf)

        def visit(members: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
            other = own_labels[own[members], None] != labels[places]
            for j in range(wide):
                own_score = score[members, j : j + 1]
                fits = other & (own_score >= 0) & (least * own_score <= 100 * scores) & (100 * scores <= most * own_score)
                best.take(members * wide + j, np.where(fits, scores, _LOW), ids[places])

        walk(vectors, centroid, rows, need, visit)
        slot, found, scores = best.rows()
        i, j = slot // max(1, wide), slot % max(1, wide)
        names = np.array([[p for p, _ in w] + [0] * (wide - len(w)) for w in window], np.int64).reshape(len(own), wide)
        out.append((own_ids[own[i]], names[i, j], score[i, j], found, scores))
    return pa.table([np.concatenate(x) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 5, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _clustered(anchors: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, int]:
    """Anchors with ``cluster`` and ``part``, the centroids, and the number of parts."""
    sample = anchors.select("q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    total = anchors.count()
    centroids = centroids_of(matrix(sample.column("q"), width), min(CLUSTERS, int(np.ceil(np.sqrt(total)))))

    def run(batches):
        for batch in batches:
            yield batch.append_column("cluster", pa.array((matrix(batch.column("q"), width) @ centroids.T).argmax(1).astype(np.int32)))

    placed = written(anchors.mapInArrow(run, "vec_id bigint, label bigint, q array<int>, cluster int"), "anchors")
    first, pieces, last, held = {}, {}, 0, 0
    for cluster, count in sorted(placed.groupBy("cluster").count().collect()):
        if held and held + count > PART:
            last, held = last + 1, 0
        first[cluster], pieces[cluster] = last, -(-count // PART)
        last, held = last + pieces[cluster] - 1, held + count if pieces[cluster] == 1 else PART
    pairs = lambda of: F.create_map(*(F.lit(x) for item in of.items() for x in item))[F.col("cluster")]
    part = (pairs(first) + F.pmod(F.xxhash64("vec_id"), pairs(pieces))).cast("int") if first else F.lit(0)
    return placed.withColumn("part", part), centroids, last + 1


def mine(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of anchors whose id is divisible by 50."""
    spark = embeddings.sparkSession
    rows = written(prepared(embeddings), "vectors")
    total, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(1, width or 1)
    blocks = max(1, -(-total // BLOCK), min(3 * spark.sparkContext.defaultParallelism, -(-total // 1024)))
    anchors, centroids, parts = _clustered(rows.filter("vec_id % 50 = 0"), width)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("part", "block")

    def searched(asked: DataFrame, function, schema: str) -> DataFrame:
        everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("part", "block")
        return everywhere.cogroup(dealt).applyInArrow(lambda left, right: function(left, right, centroids, width), schema)

    def ranked(found: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = ranked(searched(anchors, positives_of, "anchor_id bigint, positive_id bigint, positive_score bigint"), ["anchor_id"], "positive_score", "positive_id", POSITIVES)
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = written(anchors.join(lists, "vec_id"), "positives")
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    best = ranked(searched(asked, negatives_of, schema), ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
