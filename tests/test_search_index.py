"""The index of letters and the inverted lists of vectors, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import search

ITEM = "position bigint, projection string, identifiers array<string>, category string, dataset string"


@pytest.fixture(scope="module")
def items():
    chance = random.Random(5)
    words = ["graph", "Graphs", "owl", "a", "ab", "x", "日本語", "ontology", "É", "go", "rdf-star", "C++", "the", "naïve", "aaaa"]
    rows = [(i, " ".join(chance.choice(words) for _ in range(chance.randrange(8))) + (" the" if i % 3 else ""), [f"id{i % 40}", "common"] if i % 4 else [], chance.choice(["A", "a", "B", None]), chance.choice(["d1", "d2"])) for i in range(300)]
    return [*rows, (300, None, None, None, None), (301, "", [], "A", "d1")]


QUERIES = ["graph", "Graph OWL", "a", "ab x", "日本", "日本語 the", "É", "c++", "the", "ID7", "common", "zzz", "the zzz", "", "  ", None, "aaa aaaa", "a a ab", "rdf-star go", "the the", "graphs"]


def plain_rows(items, queries, identifiers):
    out = set()
    for query_id, q, category, dataset in queries:
        low = " ".join((q or "").lower().split())
        hits = [
            p for p, text, ids, kind, of in items
            if low and (identifiers and low in (ids or []) or text is not None and all(t in text.lower() for t in low.split()))
            and (category is None or kind is not None and kind.lower() == category.lower()) and (dataset is None or of == dataset or not identifiers)
        ]
        out |= {(query_id, p, len(hits), n) for n, p in enumerate(hits[:20], 1)}
    return out


def test_text_search_equals_every_item_read(spark, items):
    queries = [(f"q{i}{c}{d}", q, c, d) for i, q in enumerate(QUERIES) for c, d in ((None, None), ("a", None), (None, "d2"))]
    df, asked = spark.createDataFrame(items, ITEM), spark.createDataFrame(queries, "query_id string, q string, category string, dataset string")
    got = search.text_search(df, asked)
    assert {tuple(r) for r in got.select("query_id", "position", "total", "rank").collect()} == plain_rows(items, queries, True)
    flat = {(a, b, d) for a, b, _, d in plain_rows(items, queries, False)}
    assert {tuple(r) for r in search.text_search_plain(df, asked).select("query_id", "position", "rank").collect()} == flat
    assert search.text_search(df.limit(0), asked).count() == 0 and search.text_search(df, asked.limit(0)).count() == 0


def test_no_step_of_text_search_is_a_nested_loop(spark, items):
    df, asked = spark.createDataFrame(items, ITEM), spark.createDataFrame([("q", "graph owl", None, None)], "query_id string, q string, category string, dataset string")
    low = df.withColumn("_low", F.lower("projection"))
    for frame in (search.text_search(df, asked), search.text_candidates(low, asked.withColumn("_terms", F.split("q", " ")))):
        plan = frame._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams(spark):
    cut = lambda text, n: spark.range(1).select(search.grams(F.lit(text), n).alias("g")).first().g
    assert cut("abcab", 2) == ["ab", "bc", "ca"] and cut("日本語", 3) == ["日本語"] and cut("ab", 3) == [] and cut("", 1) == [] and cut("a😀b", 2) == ["a😀", "😀b"]


VECTOR = "id string, values array<float>, namespace string, dataset string"


def near_rows(chance, centres, n, spread):
    rows = [(f"v{i:05d}", [float(x) for x in (centres[0] if i % 3 == 0 else centres[i % len(centres)]) + chance.normal(size=centres.shape[1]) * spread], "g", f"d{i % 3}") for i in range(n)]
    rows[7:40:3] = [(i, rows[1][1], g, d) for i, _, g, d in rows[7:40:3]]  # ties
    return [*rows, ("zero", [0.0] * centres.shape[1], "g", "d0"), ("none", None, "g", "d0"), ("part", [None] * centres.shape[1], "g", "d0"), ("other", rows[1][1], "h", "d0")]


def plain_top(rows, queries, k):
    """The nearest by brute force, by the same sums."""
    own = [(i, np.array(v, np.float32).astype(float), d) for i, v, g, d in rows if g == "g" and v is not None and None not in v]
    out = []
    for q, v, d in queries:
        v = np.array(v, np.float32).astype(float)
        scale = lambda w: np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())
        scored = [(-float((w * v).sum() / scale(w)) if scale(w) else 0.0, i) for i, w, of in own if d is None or d == of]
        out += [(q, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [32_768, 20])
def test_nearest_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    chance = np.random.default_rng(3)
    rows = near_rows(chance, chance.normal(size=(12, 8)), 500, 0.1)
    queries = [(f"q{i}", rows[i][1], d) for i in range(0, 300, 50) for d in (None, "d1")] + [("qz", [0.0] * 8, None)]
    queries = [(f"{q}{d}", v, d) for q, v, d in queries]
    got = search.vector_top_k(spark.createDataFrame(queries, "query_id string, values array<float>, dataset string"), spark.createDataFrame(rows, VECTOR), 9, "g", ["dataset"])
    assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == plain_top(rows, queries, 9)


def test_lists_leave_most_pairs_out(spark):
    chance = np.random.default_rng(8)
    rows = near_rows(chance, chance.normal(size=(40, 16)), 4000, 0.03)
    queries = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(0, 4000, 100)], "query_id string, values array<float>")
    got = search.vector_top_k(queries, spark.createDataFrame(rows, VECTOR), 5, "g", compared=True).groupBy("query_id").agg(F.max("compared").alias("n")).collect()
    assert sum(r.n for r in got) < 0.35 * 40 * 4000


def test_no_vectors(spark):
    queries, rows = spark.createDataFrame([("q", [1.0])], "query_id string, values array<float>"), spark.createDataFrame([], VECTOR)
    assert search.vector_top_k(queries, rows, 3).collect() == [] and search.vector_top_k(queries.limit(0), spark.createDataFrame([("a", [1.0], "g", "d")], VECTOR), 3).collect() == []


def test_candidates_hold_both_rarest_grams(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"{'red' if i % 2 else 'sky'} {'fox' if i % 3 else 'owl'}") for i in range(60)], "position bigint, _low string")
    asked = spark.createDataFrame([("a", ["red", "owl"]), ("b", ["red"]), ("c", ["red", "cat"])], "query_id string, _terms array<string>")
    wanted = spark.createDataFrame([("owl", "red"), ("red", None)], "first string, next string")
    for most in (search.GRAMS, 1):  # the pairs of a task, and joins for more
        monkeypatch.setattr(search, "GRAMS", most)
        assert sorted(r.position for r in search.pair_index(items, wanted).filter("first = 'owl'").collect()) == list(range(3, 60, 6))  # all 20 of owl before
        found = {(r.query_id, r.position) for r in search.text_candidates(items, asked).collect()}
        assert found == {("a", i) for i in range(3, 60, 6)} | {("b", i) for i in range(1, 60, 2)}


def test_equal_queries_are_asked_once(spark):
    asked = spark.createDataFrame([(f"q{i}", f"w{i % 3}", [f"w{i % 3}"], None) for i in range(30)] + [("q0", "w1", ["w1"], None)], "query_id string, _q string, _terms array<string>, _category string")
    once, every = search._asked_once(asked)
    assert once.count() == 3 and every.count() == 31 and every.join(once, every["first"] == once["query_id"]).count() == 31


def test_browse_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    items = spark.range(500).select(F.col("id").cast("string").alias("qid"), F.concat(F.lit("t"), "id").alias("title"), F.lit("word").alias("search_text"))
    page = search.browse(items.mapInArrow(count, items.schema), "word", size=5).collect()
    assert [r.qid for r in page] == ["0", "1", "2", "3", "4"] and made.value == 500  # 1,000 or more before
