"""The mix against a plain weighted fair queue."""

import collections
import heapq
import math
import random

import pytest

from cairn.llm import fair_mix

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_queue(rows, repeats=2):
    """Words taken of each row: every source's packets queue up, and the one of the least finish time is served until the budget is spent."""
    queues = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r["size"]:
            queues[r.source].append((r.h, r.doc_id is not None, r.doc_id or 0, r["size"], i))
    budget = round(math.fsum({r.source: r.target for r in rows}.values()))
    heap, taken = [], [0] * len(rows)

    def packets(source):
        some = sorted(queues[source])
        target, size = rows[some[0][4]].target, rows[some[0][4]].source_size
        most, done = max(1, math.ceil(target / fair_mix.PACKETS)), 0
        for k in range(repeats):
            for h, known, doc_id, n, i in some:
                for part, at in enumerate(range(0, n, most)):
                    words = min(most, n - at)
                    done += words
                    yield done / target, (source is None, source), h, known, doc_id, k, part, words, i
        assert done == repeats * size

    running = {s: packets(s) for s in queues}
    for s in running:
        heapq.heappush(heap, (*next(running[s]), s))
    served = 0
    while heap and budget:
        *_, words, i, s = heapq.heappop(heap)
        served += 1
        taken[i] += min(words, budget)
        budget -= min(words, budget)
        if (following := next(running[s], None)) is not None:
            heapq.heappush(heap, (*following, s))
    return taken, served


@pytest.fixture(scope="module")
def skewed(spark):
    chance = random.Random(4)
    rows = [(i, " ".join(["w"] * (chance.randint(0, 40) if i % 50 else 9000)), "en", "hot" if i % 3 else chance.choice(["a", "b", None]), 1) for i in range(400)]
    rows += [(7, "one two", "en", "a", 1)] * 3 + [(None, "one two", "en", "a", 1)] * 2 + [(None, None, None, None, None), (9, " ", None, "empty", 0), (1, "x", "en", "tiny", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("which", ["documents", "skewed"])
def test_words_are_those_of_a_plain_queue(spark, sf_dir, which, request):
    docs = request.getfixturevalue("skewed") if which == "skewed" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = fair_mix.mix(docs).collect()
    taken, _ = plain_queue(rows)
    key = lambda r: (r.source, r.doc_id, r["size"], r.h)
    assert collections.Counter((*key(r), r.taken) for r in rows) == collections.Counter((*key(r), t) for r, t in zip(rows, taken))


def test_the_cut_decides(spark, sf_dir, skewed):
    """Packets past the budget wait uncut, and each source still comes near its target."""
    for docs in (skewed, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        sizes = spark.createDataFrame(fair_mix.sized(docs).collect(), "row bigint, doc_id bigint, source string, size bigint, h bigint")
        goals = spark.createDataFrame(fair_mix.targets(sizes, (5, 2, 1), 1.5, 2).collect(), "source string, source_size bigint, docs bigint, target double")
        waiting = fair_mix.packets(fair_mix.queued(sizes, goals), 2)
        served = fair_mix.cut(waiting, round(goals.agg({"target": "sum"}).first()[0]))
        assert 0 < served.count() < waiting.count()
        got = {r.source: r["sum(words)"] for r in served.groupBy("source").sum("words").collect()}
        for r in goals.collect():
            assert abs(got.get(r.source, 0) - r.target) <= math.ceil(r.target / fair_mix.PACKETS) + goals.count()
