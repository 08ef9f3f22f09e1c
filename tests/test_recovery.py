"""Replayed and empty batches of the postings refresh, deep chains, long numbers, stable pages, fragments, digests."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn import session
from cairn.functions import columns as c
from cairn.functions.html import fragment_text
from cairn.functions.unicode import natural_key
from cairn.operators import claims, ordered, postings, records, related, search
from cairn.streaming import refresh

FEED = "source string, query string, id bigint, url string, title string, company_name string, category string, tags array<string>, job_type string, publication_date string, candidate_required_location string, salary string, description string"


def normalized(rows):
    return postings.normalize_feed(rows, "b", {"key": "b", "name": "Feed b", "dataset": "feed-b"}, F.lit("2024-03-01").cast("timestamp"))


@pytest.fixture()
def feed(spark):
    terms = spark.createDataFrame([("graph", False, "k:graph", "Graph", "S", "strong")], "text string, case_sensitive boolean, concept_uri string, concept_label string, concept_scheme string, strength string")
    make = lambda ids: spark.createDataFrame([("b", None, i, f"https://x.example/{i}", f"Job {i}", "Firm", "c", ["t"], "full", "2024-01-01", "Here", "", "<p>graph</p>") for i in ids], FEED)
    return make, terms


def test_a_replayed_batch_keeps_the_snapshot(spark, tmp_path, feed):
    make, terms = feed
    path, at = f"file://{tmp_path}/snap", F.lit("2024-04-01").cast("timestamp")
    ids = lambda: sorted(r.id for r in refresh.current_snapshot(spark, path).select("id").collect())
    refresh.refresh_batch(make([1, 2]), 0, path, normalized, terms, at)
    first = refresh.current_version(spark, path)
    assert ids() == ["b-1", "b-2"]
    refresh.refresh_batch(make([1, 2]), 0, path, normalized, terms, at)
    assert refresh.current_version(spark, path) == first and ids() == ["b-1", "b-2"]
    refresh.refresh_batch(make([2, 3]), 1, path, normalized, terms, at)
    assert ids() == ["b-2", "b-3"]
    # Written but not yet pointed to, as where a driver is lost between the two: the batch comes again and is whole.
    refresh.current_snapshot(spark, path).write.parquet(f"{path}/v2-lost")
    refresh.refresh_batch(make([4]), 2, path, normalized, terms, at)
    assert ids() == ["b-4"]


def test_a_snapshot_may_be_published_from_itself(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    refresh.publish(spark.range(5).toDF("id"), path, "v7")
    refresh.publish(refresh.current_snapshot(spark, path).filter("id > 1"), path, "v7")
    assert sorted(r.id for r in refresh.current_snapshot(spark, path).collect()) == [2, 3, 4]


def test_a_batch_writes_its_own_sources_only_and_old_versions_go(spark, tmp_path, feed):
    make, terms = feed
    path, at = f"file://{tmp_path}/snap", F.lit("2024-04-01").cast("timestamp")

    def by_source(rows):
        key = rows.select("source").first()[0]
        return postings.normalize_feed(rows, "b", {"key": key, "name": key, "dataset": f"feed-{key}"}, F.lit("2024-03-01").cast("timestamp"))

    def folders():
        return {p.name: sum(f.stat().st_size for f in p.iterdir()) for p in (tmp_path / "snap").iterdir() if p.name.startswith("data-")}

    refresh.refresh_batch(make(range(200)).withColumn("source", F.lit("big")), 0, path, by_source, terms, at)
    first = folders()
    for n in range(1, 4):
        refresh.refresh_batch(make([n]).withColumn("source", F.lit("small")), n, path, by_source, terms, at)
    assert set(first) < set(folders()) and all(size < max(first.values()) for name, size in folders().items() if name not in first)
    ids = lambda: collections.Counter(r.id.split("-")[0] for r in refresh.current_snapshot(spark, path).select("id").collect())
    assert ids() == {"big": 200, "small": 1} and len(folders()) == 4
    before = refresh.current_version(spark, path)
    assert refresh.vacuum(spark, path) and len(folders()) == 3 and set(first) < set(folders())
    assert refresh.vacuum(spark, path) == [] and refresh.current_version(spark, path) == before and ids() == {"big": 200, "small": 1}
    refresh.refresh_batch(make([9]).withColumn("source", F.lit("small")), 4, path, by_source, terms, at)
    assert ids() == {"big": 200, "small": 1}


def test_an_empty_batch_changes_nothing(spark, tmp_path, feed):
    make, terms = feed
    path, at = f"file://{tmp_path}/snap", F.lit("2024-04-01").cast("timestamp")
    refresh.refresh_batch(make([1]).limit(0), 0, path, normalized, terms, at)
    assert refresh.current_snapshot(spark, path) is None
    refresh.refresh_batch(make([1]), 1, path, normalized, terms, at)
    version = refresh.current_version(spark, path)
    refresh.refresh_batch(make([1]).limit(0), 2, path, normalized, terms, at)
    assert refresh.current_version(spark, path) == version


def test_chains_deeper_than_a_hundred_are_decided(spark):
    """A marked chain of 102 records alternates from its root down, and a cycle beside it stays one."""
    n = 102
    rows = [(f"Q{i}", ["M"], [f"Q{i - 1}"] if i else []) for i in range(n)] + [("Qa", ["M"], ["Qb"]), ("Qb", ["M"], ["Qa"])]
    none = spark.createDataFrame([], "qid string")
    got = {r.qid: (r.eligible, r.reason) for r in records.eligible_records(spark.createDataFrame(rows, "qid string, types array<string>, parents array<string>"), ["M"], none, none).collect()}
    assert all(got[f"Q{i}"] == ((True, "orphan") if i % 2 == 0 else (False, "rule")) for i in range(n))
    assert got["Qa"] == got["Qb"] == (None, "cycle")


def plain_verdicts(rows):
    """Marked records by rounds over a dictionary: (eligible, reason)."""
    known = {q: None if t else (True, "unmarked") for q, t, _ in rows}
    while True:
        now = {}
        for q, _, parents in rows:
            if known[q] is None:
                told = [known[p] for p in parents if p in known]
                if any(v and v[0] for v in told):
                    now[q] = (False, "rule")
                elif all(told):
                    now[q] = (True, "orphan")
        if not now:
            return {q: v or (None, "cycle") for q, v in known.items()}
        known |= now


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_over_chains_branches_and_cycles(spark, monkeypatch, seed):
    monkeypatch.setattr(records, "CHAINS", 0)
    chance = random.Random(seed)
    rows = [(f"Q{i}", ["M"] if chance.random() < 0.95 else [], sorted({f"Q{chance.randrange(max(1, i - 6), i + 2)}" for _ in range(chance.choice([0, 1, 1, 1, 1, 2, 3]))}) if i else []) for i in range(400)]
    none = spark.createDataFrame([], "qid string")
    got = {r.qid: (r.eligible, r.reason) for r in records.eligible_records(spark.createDataFrame(rows, "qid string, types array<string>, parents array<string>"), ["M"], none, none).collect()}
    assert got == plain_verdicts(rows)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(records, "written", lambda df, name: made.append(name) or session.written(df, name))
    monkeypatch.setattr(ordered, "written", lambda df, name: made.append(name) or session.written(df, name))
    n = 10_000
    rows = spark.range(n).select(F.concat(F.lit("Q"), "id").alias("qid"), F.array(F.lit("M")).alias("types"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("Q"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    none = spark.createDataFrame([], "qid string")
    got = records.eligible_records(rows, ["M"], none, none)
    assert {(r.even, r.eligible, r["count"]) for r in got.groupBy((F.substring("qid", 2, 9).cast("int") % 2 == 0).alias("even"), "eligible").count().collect()} == {(True, True, n // 2), (False, False, n // 2)}
    assert made.count("pointers") <= 2 * 20 and made.count("decided") <= 6


def test_hierarchies_deeper_than_a_hundred_are_followed(spark):
    edges = spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(104)] + [("c0", "c104")], "child string, parent string")
    assert claims.closure(edges, spark.createDataFrame([("c0",)], "node string")).count() == 105


def test_long_numbers_sort_by_value(spark):
    names = ["v2", "v10", "v" + "9" * 20, "v1" + "0" * 20, "v" + "1" * 25, "v" + "1" * 26]
    df = spark.createDataFrame([(x,) for x in reversed(names)], "t string")
    assert [r.t for r in df.orderBy(natural_key("t")).collect()] == names


def test_equal_titles_give_stable_pages(spark):
    items = spark.createDataFrame([(f"Q{i:03}", "same", None) for i in range(120)], "qid string, title string, releaseDate date").repartition(7)
    keys = search.sort_keys(items, F.col("releaseDate"), numeric=True)
    pages = [[r.qid for r in search.paginate(*keys, p).collect()] for p in (1, 2, 3)]
    assert sum(pages, []) == [f"Q{i:03}" for i in range(120)]


@pytest.mark.parametrize(
    "html, text",
    [
        (None, None), ("", ""), ("a<br>b<b>c</b>d", "a bcd"), ("<p>x &amp; y</p><p>z", "x & y z"), ("a<!-- <p> -->b", "ab"), ("<script>var t='<b>';</script>end", "var t='<b>';end"),
        ("<DIV class='a>b'>q</DIV>r", "q r"), ("1 < 2 &lt; 3", "1 < 2 < 3"), ("x<span>y", "xy"), ("<!doctype html><li>one<li>two", "one two"),
    ],
)
def test_fragments(html, text):
    assert fragment_text(html) == text


def test_features_carry_their_kinds(spark):
    row = spark.createDataFrame([("d", "s", "http://h", "http://www.wikidata.org/entity/Q1", "Graph words", "", ["L"])], "dataset string, subject string, homepage string, wikidataId string, title string, description string, licenses array<string>")
    assert {(r.kind, r.key) for r in related.extract_features(row).collect()} == {("entity", "http://www.wikidata.org/entity/Q1"), ("license", "L"), ("token", "words")}


def test_digests_of_lines(spark):
    lines = [f"line {i % 700}" for i in range(1000)]
    parts = {}
    for x in lines:
        parts.setdefault(hashlib.sha256(x.encode()).hexdigest()[:4], []).append(x)
    want = hashlib.sha256("\n".join(hashlib.sha256("\n".join(sorted(parts[p])).encode()).hexdigest() for p in sorted(parts)).encode()).hexdigest()
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for n in (1, 6):
        r = c.lines_digest(df.repartition(n)).first()
        assert (r.lines, r.digest) == (1000, want)
    assert c.lines_digest(df.limit(0)).first().lines == 0


def test_shared_folder_must_be_shared(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_items_are_dealt_out_by_number(spark, sf_dir, monkeypatch):
    from cairn.operators import triples
    from cairn.plans import bindings

    monkeypatch.setattr(bindings, "ROWS", 20)
    items = bindings.catalog_items(spark, sf_dir).drop("creators")
    parts = items.select(F.spark_partition_id().alias("k")).groupBy("k").count().collect()
    assert len(parts) > 5 and max(r["count"] for r in parts) < 60  # one task had all rows before
    plan = triples.records_to_triples(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # rows of a record stay where they are made
