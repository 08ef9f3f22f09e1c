"""Vector codes of product quantization, with exact integer search in the Walsh-Hadamard domain.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of entries.  The nearest entry of a part is found on the transforms of both: for the
integer Walsh-Hadamard transform of zero-padded vectors of length ``n``, the squared differences of the coefficients sum to ``n`` times the squared Euclidean distance.  Coefficients come in
sequency order (by their number of sign changes), in which smooth vectors have their weight first; an entry whose partial sum is above the whole sum of the entry that looked best is out.  All
of it is addition, subtraction, products and comparison of 64-bit integers: no floating point, so ties are true ties.

Scale.  Each round reads the table of integer vectors once, where it lies.  A task emits one sum for each component of each entry, whatever its rows are; those
are summed by (part, entry, position) in Spark.  To the driver come the codebooks alone, of at most ``ENTRIES`` entries a part: fixed by the vectors' length, not by their number.

Defined results: rows whose vector is null or holds a null or non-finite component are left out, other rows come back once each, with repeats; vectors shorter than the longest, or than the next
multiple of the parts, go on with zeros; components are held within ``2 ** 30 // n`` after scaling, so that every sum fits; the first entries are those of the smallest ids, null ids last, then by vector;
equal distances go to the lower entry; entries without parts stay; null labels are equal to each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .shared_lists import matrix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Coefficients that are summed for all entries, and then at a time for those left; rows that are searched at a time.
FIRST, STEP, ROWS = 4, 4, 1024


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of integer rows, zero-padded to a power of two, in sequency order."""
    n = 1 << max(0, vectors.shape[1] - 1).bit_length()
    out = np.zeros((len(vectors), n), np.int64)
    out[:, : vectors.shape[1]] = vectors
    half = 1
    while half < n:
        pairs = out.reshape(len(out), n // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(out), n)
        half *= 2
    bits = n.bit_length() - 1
    gray = [k ^ k >> 1 for k in range(n)]
    return out[:, [int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray]]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each transformed row the nearest transformed entry, the lower of equals, the scaled squared distance, and how many squares were summed."""
    n, size = rows.shape[1], len(entries)
    code, distance, work = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
    for at in range(0, len(rows), ROWS):
        x = rows[at : at + ROWS]
        partial = np.zeros((len(x), size), np.int64)
        for t in range(min(FIRST, n)):
            difference = x[:, t, None] - entries[None, :, t]
            partial += difference * difference
        guess = partial.argmin(1)
        most = ((x - entries[guess]) ** 2).sum(1)
        i, j = np.nonzero(partial <= most[:, None])
        sums = partial[i, j]
        work += partial.size * min(FIRST, n) + len(x) * n
        for t in range(FIRST, n, STEP):
            sums = sums + ((x[i, t : t + STEP] - entries[j, t : t + STEP]) ** 2).sum(1)
            work += len(i) * min(STEP, n - t)
            left = sums <= most[i]
            i, j, sums = i[left], j[left], sums[left]
        order = np.lexsort((j, sums, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        code[at : at + ROWS], distance[at : at + ROWS] = j[first], sums[first]
    return code, distance, work


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and squared distances (row, part) of integer vectors; ``books`` is (part, entry, position)."""
    parts, _, width = books.shape
    codes, errors = [], []
    for part in range(parts):
        rows, entries = transform(vectors[:, part * width : (part + 1) * width]), transform(books[part])
        code, scaled, _ = nearest(rows, entries)
        codes.append(code)
        errors.append(scaled // rows.shape[1])
    return np.stack(codes, 1), np.stack(errors, 1)


def prepared(embeddings: DataFrame, scale: int = SCALE, bound: int = 1 << 26) -> DataFrame:
    """``vec_id, label, q``, the integer components of whole finite vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform("embedding", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x.cast("double") * scale))).cast("int"))
    return embeddings.select("vec_id", "label", "embedding").filter(F.coalesce(finite, F.lit(False))).select("vec_id", "label", q.alias("q"))


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts that are nearest to it."""
    model = rows.sparkSession.sparkContext.broadcast(books)
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, size, width + 1), np.int64)  # the last place counts
        for batch in batches:
            vectors = matrix(batch.column("q"), parts * width)
            codes, _ = assigned(vectors, model.value)
            for part in range(parts):
                np.add.at(sums[part, :, :width], codes[:, part], vectors[:, part * width : (part + 1) * width])
                sums[part, :, width] += np.bincount(codes[:, part], minlength=size)
        part, entry = np.nonzero(sums[:, :, width])
        place = np.tile(np.arange(width + 1), len(part))
        columns = [pa.array(np.repeat(part, width + 1)), pa.array(np.repeat(entry, width + 1)), pa.array(place), pa.array(sums[part, entry].ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total"])

    summed = rows.select("q").mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((parts, size, width + 1), np.int64)
    total[tuple(summed.column(c).to_numpy() for c in ("part", "entry", "place"))] = summed.column("total").to_numpy()
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(1, count), books)


def digest(books: np.ndarray) -> str:
    """Of all components, decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) from the smallest ids, after so many rounds; None without rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q", "label").limit(entries).select("q").toArrow()
    if not len(first):
        return None
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    width = max(1, -(-longest // parts))
    books = np.ascontiguousarray(matrix(first.column("q"), parts * width).reshape(len(first), parts, width).swapaxes(0, 1))
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row: two hex digits a part, and the sum of squared distances."""
    model = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assigned(matrix(batch.column("q"), parts * width), model.value)
            text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.select("vec_id", "label", "q").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row whose vector is whole."""
    longest = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    padded = 1 << max(0, -(-max(1, longest) // PARTS) - 1).bit_length()
    rows = written(prepared(embeddings, bound=min(1 << 26, (1 << 30) // padded)), "vectors")
    books = fitted(rows)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = written(coded(rows, books), "codes")
    labels = codes.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(labels, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
