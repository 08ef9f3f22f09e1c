"""The hidden Markov model against enumeration, a plain recursion and plain counts."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hidden_markov as hm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def model_of(states, size, seed=0):
    chance = np.random.default_rng(seed)
    rows = lambda n, m: chance.dirichlet(np.ones(m), n)
    return {"start": rows(1, states)[0], "mean": rows(1, states)[0], "follow": rows(states, states), "emission": rows(states, size)}


def plain_log(model, classes):
    """The forward recursion of one sequence, step by step."""
    a, log = model["start"] * model["emission"][:, classes[0]], 0.0
    for c in classes[1:]:
        a = a @ model["follow"] * model["emission"][:, c]
        log += math.log(a.sum())
        a = a / a.sum()
    return log + math.log(a.sum())


def test_likelihoods_equal_a_plain_recursion_at_any_length(monkeypatch):
    chance = np.random.default_rng(3)
    model = model_of(4, 30)
    lengths = np.array([1, 2, 7, 8, 9, 1023, 1024, 1025, 1280, 1281, 5000, 3])
    classes = chance.integers(0, 30, lengths.sum())
    begins = np.cumsum(lengths) - lengths
    want = [plain_log(model, classes[a : a + n]) for a, n in zip(begins, lengths)]
    for tokens in (hm.TOKENS, 300):
        monkeypatch.setattr(hm, "TOKENS", tokens)
        assert hm.likelihoods(model, classes, lengths) == pytest.approx(want, rel=1e-10)
    monkeypatch.setattr(hm, "FIRST_CHUNK", 3)
    monkeypatch.setattr(hm, "CHUNK", 5)
    assert hm.likelihoods(model, classes, lengths) == pytest.approx(want, rel=1e-10)


def test_expected_counts_equal_enumeration():
    model, size = model_of(2, 3, 1), 3
    texts = [([0, 2, 1, 1], True), ([1, 0], False), ([2], True)]
    want, log = np.zeros((size + 2 + 1, 2)), 0.0
    for classes, opens in texts:
        paths = {}
        for path in itertools.product(range(2), repeat=len(classes)):
            p = model["start" if opens else "mean"][path[0]]
            for t, (s, c) in enumerate(zip(path, classes)):
                p *= model["emission"][s, c] * (model["follow"][path[t - 1], s] if t else 1)
            paths[path] = p
        whole = sum(paths.values())
        log += math.log(whole)
        for path, p in paths.items():
            for t, (s, c) in enumerate(zip(path, classes)):
                want[c, s] += p / whole
                if t:
                    want[size + path[t - 1], s] += p / whole
            want[size + 2, path[0]] += opens * p / whole
    lengths = np.array([len(c) for c, _ in texts])
    counts, found = hm.expected(model, np.concatenate([c for c, _ in texts]), np.cumsum(lengths) - lengths, lengths, np.array([o for _, o in texts]))
    assert counts == pytest.approx(want) and found == pytest.approx(log)


def test_probabilities_of_all_texts_sum_to_one():
    """Over all texts of up to some words, what is missing is the probability of longer ones."""
    model = model_of(3, 4, 2)
    total, still = 0.0, model["start"]
    for n in range(1, 7):
        for words in itertools.product((1, 2, 3), repeat=n - 1):
            total += math.exp(plain_log(model, [*words, 0]))
    for n in range(6):
        still = (still if n == 0 else still @ model["follow"]) * (1 - model["emission"][:, 0])
    assert total + still.sum() == pytest.approx(1)


def plain_base(rows):
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = collections.Counter(w for i, x in tokens if not held(i) for w in x)
    total, distinct = sum(counts.values()), len(counts)
    return [(i, held(i), len(x), sum(counts[w] > 0 for w in x), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in x)) for i, x in tokens]


def compared(got, rows):
    want = collections.defaultdict(list)
    for r in plain_base(rows):
        want[(r[0], r[1], r[2], r[3], r[4])].append(r[5])
    assert len(got) == len(rows)
    for r in got:
        near = want[tuple(r[:5])]
        near.remove(min(near, key=lambda b: abs(b - r.base_score)))
        assert math.isfinite(r.score) and r.score < 0 or r.train_tokens == 0


def test_base_equals_plain_counts_and_the_model_beats_it_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = hm.score(docs).collect()
    compared(got, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    want = {r[0]: r[5] for r in plain_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    assert all(r.base_score == pytest.approx(want[r.doc_id], rel=1e-9) for r in got)
    for held in (True, False):
        assert sum(r.score for r in got if r.held_out == held) > sum(r.base_score for r in got if r.held_out == held)
    assert {tuple(r) for r in hm.score(docs).collect()} == {tuple(r) for r in got}


def test_one_state_without_passes_is_the_base(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"))
    monkeypatch.setattr(hm, "started", lambda shares: {"start": np.ones(1), "mean": np.ones(1), "follow": np.ones((1, 1)), "emission": shares[None]})
    monkeypatch.setattr(hm, "WARM_ROUNDS", 0)
    monkeypatch.setattr(hm, "baum_welch", lambda rows, model, shares: model)
    for r in hm.score(docs).collect():
        assert r.score == pytest.approx(r.base_score, rel=1e-9)


def test_passes_raise_the_posterior(spark, sf_dir):
    """Of the model, its prior being the base's shares, given the training texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = hm.written(hm.sliced(docs), "slices")
    words = hm.written(hm.counted(rows), "words")
    scores = []
    for passes in (1, 2, 4):
        model, shares, *_ = hm.trained(rows, words, passes)
        own = np.concatenate([hm._class_tokens(r.asDict()) for r in rows.collect()])
        lengths = np.concatenate([np.frombuffer(r.lengths, np.int32) for r in rows.collect()]).astype(np.int64)
        train = np.concatenate([np.frombuffer(r.train, bool) for r in rows.collect()])
        scores.append(hm.likelihoods(model, own[np.repeat(train, lengths)], lengths[train]).sum() + hm.PRIOR * (shares[shares > 0] * np.log(model["emission"][:, shares > 0])).sum())
        assert model["emission"].sum(1) == pytest.approx(1) and model["follow"].sum(1) == pytest.approx(1)
    assert scores == sorted(scores)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"Word{i % 700}" for i in range(200_000))  # about 1.5 MB
    rows = [(1, "a B c"), (1, "a B c"), (2, None), (3, ""), (None, "x y"), (None, None), (5, long), (6, " \t\n "), (7, "É́ 中文 a"), (8, "unseen words only")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("slice", "keys", "place", "count", "train", "id", "first", "class")})


def test_odd_rows(spark, odd, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    compared(hm.score(odd).collect(), rows)
    monkeypatch.setattr(hm, "SLICE", 10)
    compared(hm.score(odd).collect(), rows)
    assert hm.score(odd.limit(0)).collect() == []
    text = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert dict(hm.score(text).dtypes)["doc_id"] == "string" and hm.score(text).count() == len(rows)


def test_nothing_to_learn_from(spark):
    got = hm.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(True, 3, 0, 0, 0.0), (True, 1, 0, 0, 0.0)}
    assert all(r.score == pytest.approx(0.0, abs=1e-9) for r in got)
