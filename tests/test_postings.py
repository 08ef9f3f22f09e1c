"""Postings: feeds, ages, page rules, copies, evidence, refreshes."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import ordered, postings
from cairn.sources import catalog
from cairn.streaming import refresh

AT = "2024-03-01"
SOURCE = {"key": "x", "name": "Feed", "dataset": "feed-x", "query": "q"}
ROW = "id string, sourceDataset string, sourceRecordId string, canonicalFingerprint string, canonicalUrl string, sourceUrl string, hiringOrganization string, title string, location string, discoveredBy array<string>"


def one(spark, layout, fields, values, **more):
    rows = spark.createDataFrame([values], fields)
    return postings.normalize_feed(rows, layout, SOURCE | more, F.lit(AT).cast("timestamp")).first()


def test_layout_a(spark):
    fields = "title string, excerpt string, description string, companyName string, employmentType string, minSalary double, maxSalary double, salaryPeriod string, currency string, seniority array<string>, locationRestrictions array<string>, categories array<string>, pubDate long, expiryDate long, applicationLink string, guid string, query string"
    r = one(spark, "a", fields, ("A &amp; B", "short", "", "Firm", "Full", 1000.0, 2500.5, "year", "EUR", ["Senior", "Lead"], ["US", "Chad", "US"], ["x"], 1700000000, None, "https://a.example/j?utm_source=z", "https://a.example/j#top", "kw"))
    assert (r.rejected, r.title, r.description, r.remote, r.location, r.seniority, r.discoveredBy) == (None, "A & B", "short", True, "Chad, US", "Lead, Senior", ["kw"])
    assert (r.salary, r.baseSalary.minValue, r.baseSalary.unitText, str(r.datePosted), r.validThrough) == ("EUR 1,000–2,500.5 / year", 1000.0, "year", "2023-11-14", None)
    assert r.canonicalUrl == "https://a.example/j" and r.id.startswith("x-") and len(r.id) == 18
    other = one(spark, "a", fields, ("A", "s", "d", "Firm", "", None, None, None, None, None, None, None, None, None, "https://a.example/j", "https://a.example/k", "kw"))
    assert other.rejected == "url"


def test_layouts_c_to_f(spark):
    c = "slug string, company_name string, title string, description string, remote boolean, url string, tags array<string>, job_types array<string>, location string, created_at string, salary string"
    r = one(spark, "c", c, ("s1", "Firm", "T", "<p>D</p><p>E</p>", False, "https://any.example/1", ["b", "A"], ["part", "full"], "Rome", "1700000000", ""))
    assert (r.description, r.remote, r.tags, r.employmentType, str(r.datePosted), r.salary) == ("D E", False, ["A", "b"], "full, part", "2023-11-14", None)
    d = "id long, url string, jobTitle string, jobDescription string, jobExcerpt string, companyName string, jobGeo string, pubDate string, jobType array<string>, jobIndustry array<string>"
    r = one(spark, "d", d, (7, "https://d.example/7", "T", None, "Ex", "Firm", "USA ,Canada,", "2024-02-03 10:00", ["Full-Time"], None))
    assert (r.location, str(r.datePosted), r.employmentType, r.tags, r.description, r.remote) == ("USA, Canada", "2024-02-03", "Full-Time", None, "Ex", True)
    e = "id string, title string, company string, snippet string, link string, location string, updated string, type string, salary string"
    assert one(spark, "e", e, ("1", "T", "F", "S", "https://e.example/desc/1", "Remote", "2024-01-01T", "", "")).remote is True
    assert one(spark, "e", e, ("1", "T", "F", "S", "https://e.example/desc/1", "Paris", "bad", "", "")).remote is None
    f = "id string, title string, company struct<display_name:string>, description string, redirect_url string, location struct<display_name:string>, created string, salary_min double, salary_max double, contract_type string, contract_time string, category struct<label:string,tag:string>"
    r = one(spark, "f", f, ("1", "T", ("Firm",), "D", "https://f.example/1", ("Town",), "2024-05-05T01:02:03Z", 50000.0, 0.0, "permanent", "full_time", ("IT Jobs", "it")))
    assert (r.salary, r.baseSalary.currency, r.baseSalary.maxValue, r.employmentType, r.tags, r.location) == ("USD 50,000", "USD", None, "Permanent, Full Time", ["IT Jobs"], "Town")


def test_required_fields_and_hosts(spark):
    b = "id long, url string, title string, company_name string, category string, tags array<string>, job_type string, publication_date string, candidate_required_location string, salary string, description string"
    assert one(spark, "b", b, (None, "http://b.example/1", "", "F", "", None, "", None, "", "", "D"), host="b.example").rejected == "title,id,url"
    assert one(spark, "b", b, (1, "https://other.example/1", "T", "F", "", None, "", None, "", "", "D"), host="b.example").rejected == "url"


def test_ages(spark):
    links = ["https://h/desc/1?jobAge=60", "https://h/desc/2?jobAge=61", "https://h/desc/3", "https://h/away/4?jobAge=1", None]
    df = spark.createDataFrame([(x,) for x in links], "link string")
    assert [r.link for r in postings.filter_posting_age(df, 60, "/desc/").collect()] == [links[0], links[2]]


def test_page_rules(spark):
    rows = [("s", 1, 1, 10, 20, None, True, "q"), ("s", 2, 3, 10, 20, None, True, "q"), ("s", 3, 3, 10, 21, None, False, "q"), ("s", 4, 4, 10, 21, 4, True, "q"), ("t", 1, 1, None, 5, None, False, "q")]
    df = spark.createDataFrame(rows, "source string, request_no int, current_page int, returned int, total int, last_page int, has_next boolean, query string")
    got = {(r.source, r.request_no): r.error for r in postings.validate_feed_pages(df, "next", limit=50).collect()}
    assert got == {("s", 1): None, ("s", 2): "not the page asked for", ("s", 3): "the total changed", ("s", 4): "inconsistent page numbers", ("t", 1): "no array of postings"}
    complete = postings.validate_feed_pages(df.filter("request_no = 1 and source = 's'").withColumn("total", F.lit(10)), "total", limit=10)
    assert complete.first().complete


def test_feed_limit_counts_requests_in_order(spark):
    pages = spark.createDataFrame([("s", i, "q", '{"jobs": [{"id": %d}, {"id": %d}, {"id": %d}]}' % (i * 10, i * 10 + 1, i * 10 + 2)) for i in (2, 0, 1)], "source string, request_no int, query string, json string")
    assert sorted(r.id for r in catalog.postings_of(pages, "id int", "jobs", 4).collect()) == [0, 1, 2, 10]


def plain_dedup(rows):
    fold = lambda v: " ".join((v or "").split()).casefold()
    owner, kept = {}, []
    for r in sorted(rows, key=lambda r: tuple(r[i] or "" for i in (1, 2, 3, 4, 0))):
        rid, fp = fold(r[2]), fold(r[3])
        urls = [u for u in dict.fromkeys((fold(r[4]), fold(r[5]))) if u]
        keys = [("s", r[1], rid)] * bool(rid) + [("f", fp)] * bool(fp) + [("u", u) for u in urls]
        keys = keys or [("v", r[1], fold(r[6]), fold(r[7]), fold(r[8]))]
        target = next((owner[k] for k in keys if k in owner), None)
        if target is None:
            target = [r[0], set()]
            kept.append(target)
        target[1].update(r[9] or ())
        owner.update(dict.fromkeys(keys, target))
    return sorted((i, tuple(sorted(s))) for i, s in kept)


@pytest.mark.parametrize("seed", range(4))
def test_copies_equal_the_sequential_rule_in_any_order(spark, seed):
    chance = random.Random(seed)
    pick = lambda n, none: None if chance.random() < none else f"V{chance.randrange(n)}"
    rows = [(f"i{k:02}", f"d{chance.randrange(2)}", pick(12, 0.4), pick(14, 0.6), pick(10, 0.5), pick(10, 0.7), pick(3, 0.1), pick(3, 0.1), pick(2, 0.3), [f"q{chance.randrange(4)}"]) for k in range(40)]
    want = plain_dedup(rows)
    for parts in (1, 5):
        chance.shuffle(rows)
        got = postings.dedup_postings(spark.createDataFrame(rows, ROW).repartition(parts)).collect()
        assert sorted((r.id, tuple(r.discoveredBy)) for r in got) == want


def test_a_large_component_goes_over_many_tasks(spark):
    """3,000 records in one chain of keys, and a key of a third of them: equal to the sequential rule; no task reads the component."""
    n = 3000
    rows = [(f"i{k:05}", "d0", f"r{k // 2}", f"f{(k + 1) // 2}", "https://hot.example/" if k % 3 == 0 else None, None, None, None, None, [f"q{k % 5}"]) for k in range(n)]
    got = postings.dedup_postings(spark.createDataFrame(rows, ROW).repartition(6))
    assert sorted((r.id, tuple(r.discoveredBy)) for r in got.collect()) == plain_dedup(rows)


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_predecessors_and_ends(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [(chance_key, k) for k in range(400) for chance_key in ({"hot"} if k % 3 == 0 else set()) | {f"k{k % 7}", f"z{k // 40}"}]
        got = {(r.key, r.n): r.before for r in ordered.previous_of_key(spark.createDataFrame(rows, "key string, n bigint"), "key", "n").collect()}
        last, want = {}, {}
        for key, k in sorted(rows, key=lambda r: r[1]):
            want[key, k] = last.get(key)
            last[key] = k
        assert got == want
        pointers = [(k, k - 1) for k in range(1, 700)] + [(k, 5000) for k in range(5001, 5050)] + [(9000, 350)]
        ends = {r.node: r.root for r in ordered.chain_ends(spark.createDataFrame(pointers, "node bigint, parent bigint")).collect()}
        assert ends == {k: 0 for k in range(1, 700)} | {k: 5000 for k in range(5001, 5050)} | {9000: 0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


TERMS = [("owl", False, "k:owl", "Owl", "S", "strong"), ("OWL", True, "k:owl2", "Owl2", "S", "contextual"), ("graph", False, "k:graph", "Graph", "S", "contextual"), ("sparql", False, "k:sparql", "Sparql", "S", "contextual")]


def test_evidence_and_classes(spark):
    texts = {
        "a": "We need OWL.", "b": "No experience with owl. Good", "c": "This is not it. owl helps", "d": "not " + "x" * 60 + " owl", "e": "graph and Graph", "f": "graph, sparql", "g": "  ", "h": "without graph; sparql and graph", "i": "We don't use owl",
    }
    records = spark.createDataFrame([(k, v, None) for k, v in texts.items()], "id string, title string, description string")
    evidence = postings.find_evidence(records, spark.createDataFrame(TERMS, "text string, case_sensitive boolean, concept_uri string, concept_label string, concept_scheme string, strength string"))
    classes = {r.id: r.classification for r in postings.classify_evidence(records, evidence).collect()}
    assert classes == {"a": "qualified", "b": "not_match", "c": "qualified", "d": "qualified", "e": "not_match", "f": "review", "g": "not_match", "h": "review", "i": "not_match"}
    found = collections.Counter((r.id, r.concept_uri, r.matched_phrase, r.negated) for r in evidence.collect())
    assert found[("a", "k:owl2", "OWL", False)] == 1 and found[("e", "k:graph", "Graph", False)] == 1 and found[("h", "k:graph", "graph", True)] == 1
    concepts = {r.id: r.concepts for r in postings.matched_concepts(evidence, "k:").collect()}
    assert concepts["a"] == ["owl", "owl2"] and "b" not in concepts


def test_fragment_text():
    from cairn.functions.html import fragment_text

    assert fragment_text("<p>A<b>b</b>c</p><p>d &amp; e</p><script>x</script>") == "Abc d & e x"
    assert fragment_text(None) is None and fragment_text("") == ""


def test_summary_counts_every_class(spark):
    df = spark.createDataFrame([("b", "review", True), ("a", "review", False)], "id string, classification string, active boolean")
    r = postings.run_summary(df, "2024-03-01T00:00:00Z", 5, False).first()
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts = "\n".join(sha(x) for x in sorted("ab", key=sha))
    assert r.runId == "20240301T000000Z-" + sha(parts)[:12]
    assert (r.qualified, r.review, r.not_match, r.activeCount, r.deduplicatedCount) == (0, 2, 0, 1, 2)


RAW = "source string, request_no int, query string, pos int, id long, url string, title string, company_name string, category string, tags array<string>, job_type string, publication_date string, candidate_required_location string, salary string, description string"


def raw(ids, source="b"):
    return [(source, 0, "q", i, i, f"https://{source}.example/{i}", f"T{i}", "Firm", "", None, "", None, "", "", "owl") for i in ids]


def test_refresh_keeps_first_sightings_and_other_sources(spark, tmp_path):
    """Several batches, a source without rows, a restart from the checkpoint."""
    terms = spark.createDataFrame(TERMS, "text string, case_sensitive boolean, concept_uri string, concept_label string, concept_scheme string, strength string")

    def normalize(rows):
        key = rows.select("source").first()[0]
        return postings.normalize_feed(rows, "b", {"key": key, "name": key, "dataset": f"feed-{key}"}, F.lit(AT).cast("timestamp"))

    folder, path, checkpoint = (str(tmp_path / n) for n in ("raw", "snapshot", "checkpoint"))

    def land(rows, at):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(RAW).parquet(folder)
        refresh.refresh_postings(stream, path, checkpoint, normalize, terms, F.lit(at).cast("timestamp")).awaitTermination()
        return {r.id: str(r.firstSeenAt)[:10] for r in refresh.current_snapshot(spark, path).collect()}

    assert land(raw([1, 2]) + raw([9], "c"), "2024-03-02") == {"b-1": "2024-03-01", "b-2": "2024-03-01", "c-9": "2024-03-01"}
    second = land(raw([2, 3]), "2024-03-05")
    assert sorted(second) == ["b-2", "b-3", "c-9"]
    rows = {r.id: r for r in refresh.current_snapshot(spark, path).collect()}
    assert str(rows["b-2"].lastSeenAt)[:10] == "2024-03-05" and rows["b-2"].classification == "qualified"
    assert refresh.current_snapshot(spark, str(tmp_path / "none")) is None


def test_search_log_stream_equals_the_table(spark, tmp_path):
    """Batches whose searches come late and at equal times: the rows of the table, in which order they come; and state that goes."""
    rows = [("s1", i, i, "t", q) for i, q in enumerate(["Owl", "owl ", "graph", "", "graph", "a@b.co"])] + [("s2", 0, 0, "t", "owl"), ("s2", 1, 1, "u", "owl"), ("s2", 2, 2, "u", None)]
    rows += [("s3", 5, n, "t", q) for n, q in enumerate(["graph", "owl", "owl", "graph", "graph"])]  # one time
    schema = "session string, n int, event_id bigint, tab string, q string"
    df = lambda own: spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_seconds(F.col("n") + 1000)).drop("n")
    table = sorted((r.session, r.ts, r.tab, r["query"]) for r in refresh.query_log(df(rows), "event_id").collect())
    assert [r[3] for r in table] == ["owl", "graph", "graph", "[redacted]", "owl", "owl", "graph", "graph", "owl"]
    places = {n: str(tmp_path / n) for n in ("in", "out", "check")}

    def run(own):
        df(own).coalesce(1).write.mode("append").parquet(places["in"])
        stream = spark.readStream.schema(df(rows).schema).parquet(places["in"])
        logged = refresh.query_log_stream(stream, "event_id", "10 seconds")
        query = logged.writeStream.format("parquet").option("path", places["out"]).option("checkpointLocation", places["check"]).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    run(rows[1::2])
    run(rows[::2])
    assert run([("s9", 500, 0, "t", None)]) >= 1
    out = spark.read.schema("session string, ts timestamp, tab string, query string").parquet(places["out"])
    assert sorted((r.session, r.ts, r.tab, r["query"]) for r in out.collect()) == table
    assert run([("s9", 200_000, 1, "t", None), ("s1", 3, 9, "t", "too late")]) == 1  # other sessions are forgotten
    assert sorted((r.session, r.ts, r.tab, r["query"]) for r in out.collect()) == table


@pytest.mark.parametrize("parts", [1, 5])
def test_numbers_of_a_key(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [("hot" if i % 3 else f"k{i % 11}", (i * 7919) % 1000) for i in range(1000)]
        want, count = set(), collections.Counter()
        for key, n in sorted(rows):
            count[key] += 1
            want.add((key, n, count[key]))
        assert {tuple(r) for r in ordered.numbered(spark.createDataFrame(rows, "key string, n bigint"), "key", "n").collect()} == want
        assert ordered.numbered(spark.createDataFrame([], "key string, n bigint"), "key", "n").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("enough", [10_000, 30])
def test_pages_equal_a_whole_sort(spark, monkeypatch, enough):
    monkeypatch.setattr(ordered, "ENOUGH", enough)
    monkeypatch.setattr(ordered, "RANGES", 6)
    chance = random.Random(2)
    rows = [(chance.choice([None, "b", "a", "ä", "c"]) if i % 2 else "b", None if i % 5 == 0 else chance.randrange(40), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a string, b bigint, id bigint").repartition(3)
    for by in ([("a", False), ("b", True), ("id", False)], [("b", False), ("a", True), ("id", True)]):
        want = [r.id for r in df.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in by)).collect()]
        for first, last in ((0, 20), (340, 360), (690, 720), (699, 700), (700, 720), (5, 5)):
            assert [r.id for r in ordered.rows_between(df, by, first, last).collect()] == want[first:last]


def test_late_days_of_layout_c(spark):
    c = "slug string, company_name string, title string, description string, remote boolean, url string, tags array<string>, job_types array<string>, location string, created_at string, salary string"
    day = lambda created: str(one(spark, "c", c, ("s1", "Firm", "T", "D", False, "https://any.example/1", None, None, "", created, "")).datePosted)
    assert [day(x) for x in ("999999999", "10000000000", "100000000000")] == ["2001-09-09", "2286-11-20", "5138-11-16"]


def test_references_without_semicolon(spark):
    pages = spark.createDataFrame([("a &amp<b>b</b> &lt;c&gt; &#233; &copy &nosuch;",)], "body string")
    assert postings.extract_text(pages).first().text == "a &b <c> é © &nosuch;"
    assert postings.extract_text(pages, bare=False).first().text == "a &ampb <c> é &copy &nosuch;"


def test_evidence_without_cues(spark):
    texts = spark.createDataFrame([(1, "no Licensed thing")], "id long, description string")
    terms = spark.createDataFrame([("Licensed", True, "k:licence", "Licence", "S", "strong")], "text string, case_sensitive boolean, concept_uri string, concept_label string, concept_scheme string, strength string")
    found = {cues: postings.find_evidence(texts, terms, cues=cues) for cues in (True, False)}
    assert {cues: postings.classify_evidence(texts, e).first().classification for cues, e in found.items()} == {True: "not_match", False: "qualified"}
    assert {cues: postings.matched_concepts(e, "k:").count() for cues, e in found.items()} == {True: 0, False: 1}


def test_matches_leave_a_task_in_parts():
    import pyarrow as pa

    terms = [("owl", False, "k:owl", "Owl", "S", "strong")]
    names = ["id", "concept_uri", "concept_label", "concept_scheme", "strength", "matched_phrase", "source_field", "field_no", "negated"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([0, 1], pa.int32()), pa.array(["owl " * 25_000, "Owl"])], ["id", "field_no", "text"])
    parts = list(postings._evidence(batch, postings.TermScanner([t[:2] for t in terms]), terms, names, True))
    assert max(p.num_rows for p in parts) <= postings.MATCHES and sum(p.num_rows for p in parts) == 25_001
    assert parts[-1].to_pylist()[-1] == {"id": "b", "concept_uri": "k:owl", "concept_label": "Owl", "concept_scheme": "S", "strength": "strong", "matched_phrase": "Owl", "source_field": postings.FIELDS[1], "field_no": 1, "negated": False}
