"""Shared lists and Walsh-Hadamard codes against plain loops."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import oracle, shared_lists, walsh_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def floored(vector, scale):
    return [int(np.floor(np.float64(x) * scale)) for x in vector]


def plain_negatives(rows):
    own = [(r[0], ((r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]), floored(r[1], 256)) for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for a, label, q in own:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, of) for i, of, p in own if i != a)
        for s, i, of in [x for x in scored if x[2] == label][:5]:
            fits = [(t, j) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, i, n, j, -s, -t) for n, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, shared_lists.mine(df).collect()))


@pytest.fixture(scope="module")
def clustered():
    """Vectors around a few directions, with ties, equal vectors, zeros, and one direction that a third of all rows share."""
    chance = np.random.default_rng(5)
    centres = chance.normal(size=(6, 16))
    rows = []
    for i in range(900):
        v = centres[0] if i % 3 == 0 else centres[i % 6] + chance.normal(size=16) * 0.2
        rows.append((i, [float(x) for x in np.round(v * (1 + i % 4), 2)] if i % 97 else [0.0] * 16, int(chance.integers(10)) if i % 5 else 3))
    return rows


def test_negatives_equal_plain_lists(spark, clustered, monkeypatch):
    df = spark.createDataFrame(clustered, SCHEMA)
    want = plain_negatives([(i, np.array(v, np.float32), label) for i, v, label in clustered])
    assert want and mined(df) == want
    for name, value in (("BLOCK", 100), ("PART", 4), ("CHUNK", 7), ("CLUSTERS", 3), ("SAMPLE", 5)):
        monkeypatch.setattr(shared_lists, name, value)
    assert mined(df) == want


def test_lists_end_early_where_vectors_have_directions():
    chance = np.random.default_rng(1)
    centres = chance.normal(size=(40, 32))
    rows = np.round((centres[np.arange(20_000) % 40] + chance.normal(size=(20_000, 32)) * 0.05) * 256).astype(np.int64)
    members = rows[:4000:40]
    best = shared_lists.Best(len(members), 5)
    centroid = shared_lists.centroids_of(members, 1)[0]
    compared = shared_lists.walk(members, centroid, rows, lambda m: best.scores[m, -1].astype(float), lambda m, p, s: best.take(m, s, p))
    assert compared < 0.2 * len(members) * len(rows)
    every = members @ rows.T
    for i, row in enumerate(every):
        order = np.lexsort((np.arange(len(row)), -row))[:5]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == row[order].tolist()


def test_bounds_hold_for_every_member():
    chance = np.random.default_rng(2)
    for scale in (1, 1000, 1 << 21):
        members, rows = (np.rint(chance.normal(size=(n, 9)) * scale).astype(np.int64) for n in (30, 400))
        members[0] = 0
        rows[:3] = 0
        centroid = shared_lists.centroids_of(members, 1)[0]
        order, bound = shared_lists.shared_list(members, centroid, rows)
        assert (np.diff(bound) <= 0).all()
        norms = np.sqrt((members.astype(float) ** 2).sum(1))
        assert (shared_lists.products(members, rows[order]) <= norms[:, None] * bound * (1 + 1e-9) + 0.5).all()


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (1, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (1, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (2, [0.1, 0.2], 1), (3, None, 1), (4, [None, 0.1], 1), (5, [nan, 0.1], 1), (6, [inf], 1), (7, [0.1, 0.1, 0.1, 0.2, 0.2], 0)]
    rows += [(8, [0.05, 0.1, 0.2, 0.3, 0.4], None), (9, [1e30, -1e30], 2), (10, [], 1), (None, [0.1, 0.2, 0.3, 0.4, 0.5], 2), (50, [0.1, 0.2, 0.3, 0.4, 0.4], 1), (51, [0.09, 0.15, 0.2, 0.3, 0.4], 2), (52, [0.09, 0.15, 0.2, 0.3, 0.4], 2)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("q", "block", "part", "cluster", "rank", "code", "id", "row")})


def test_odd_vectors(spark, odd_vectors):
    got = shared_lists.mine(odd_vectors).collect()
    assert {r.anchor_id for r in got} <= {0, 50} and {r.negative_id for r in got} >= {51, 52}
    assert all(r.negative_id not in (3, 4, 5, 6, 8, None) for r in got)
    coded = collections.Counter(r.vec_id for r in walsh_codes.compressed(odd_vectors).collect())
    assert coded == collections.Counter([0, 1, 1, 2, 7, 8, 9, 10, None, 50, 51, 52])


def test_empty_vectors(spark, odd_vectors):
    for rows in (odd_vectors.limit(0), odd_vectors.filter("vec_id = 3")):
        assert shared_lists.mine(rows).collect() == [] and walsh_codes.compressed(rows).collect() == []


# ---- codes


def plain_codes(rows):
    kept = sorted((i, floored(v, 1024), label) for i, v, label in rows)
    width = len(kept[0][1]) // 4
    cut = lambda q: [q[width * p : width * (p + 1)] for p in range(4)]
    books = [[cut(q)[p] for _, q, _ in kept[:256]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(4):
        after = []
        for p in range(4):
            members = collections.defaultdict(list)
            for _, q, _ in kept:
                members[near(cut(q)[p], books[p])[1]].append(cut(q)[p])
            after.append([[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(books[p])])
        books = after
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [near(x, b) for x, b in zip(cut(q), books)]) for i, q, label in kept]
    errors = collections.Counter()
    for _, label, n in found:
        errors[label] += sum(d for d, _ in n)
    return sorted((i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), errors[label], digest) for i, label, n in found)


def test_codes_equal_plain_rounds(spark):
    chance = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(chance.normal(size=12), 1)], None if i % 3 == 0 else i % 4) for i in range(700)]
    rows = [(i, rows[0][1] if i % 3 == 1 else v, label) for i, v, label in rows]  # a third of all rows are equal
    got = sorted(map(tuple, walsh_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain_codes([(i, np.array(v, np.float32), label) for i, v, label in rows])


@pytest.mark.parametrize("width", [1, 2, 3, 16, 21, 64])
def test_transform_keeps_distances_in_order_of_sequency(width):
    chance = np.random.default_rng(width)
    a, b = (chance.integers(-900, 900, (20, width)) for _ in range(2))
    n = walsh_codes.transform(a).shape[1]
    assert (((walsh_codes.transform(a) - walsh_codes.transform(b)) ** 2).sum(1) == n * ((a - b) ** 2).sum(1)).all()
    waves = walsh_codes.transform(np.eye(n, dtype=np.int64)).T
    assert (np.abs(np.diff(np.sign(waves), axis=1)) > 0).sum(1).tolist() == list(range(n))


def test_entries_go_early_and_ties_fall_low():
    chance = np.random.default_rng(4)
    smooth = np.cumsum(chance.integers(-40, 41, (3000, 16)), 1)
    entries = smooth[:256].copy()
    entries[100] = entries[7]
    x, e = walsh_codes.transform(smooth), walsh_codes.transform(entries)
    code, scaled, work = walsh_codes.nearest(x, e)
    every = ((smooth[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (scaled == 16 * every.min(1)).all()
    assert work < 0.4 * len(smooth) * 256 * 16


def test_equal_the_sql(spark, sf_dir, duck):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for found, sql in ((shared_lists.mine(df), oracle.OP11), (walsh_codes.compressed(df), oracle.op12())):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(map(tuple, found.select(*names).collect())) == sorted(result.fetchall())
