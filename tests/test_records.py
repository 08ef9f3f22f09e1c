"""Claims, eligibility, versions, slugs, related records, audits, search, gates: the situations that must hold."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import columns as c
from cairn.operators import audit, claims, gates, pages, profile, records, related, search, snapshot
from cairn.sources import catalog

CLAIM = "subject string, property string, rank string, datatype string, value string, guid string"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def scalar(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_ranks_come_before_types(spark):
    item = "wikibase-item"
    rows = [
        ("A", "P1", "preferred", item, "x", "1"), ("A", "P1", "normal", item, "y", "2"), ("B", "P1", "preferred", "string", "x", "3"), ("B", "P1", "normal", item, "y", "4"),
        ("C", "P1", "deprecated", item, "x", "5"), ("D", "P1", "normal", item, "x", "6"), ("D", "P1", "normal", item, "x", "7"), ("E", "P1", "normal", item, None, "8"),
    ]
    assert values(claims.truthy_edges(spark.createDataFrame(rows, CLAIM)), "subject_qid", "object_qid") == [("A", "x"), ("D", "x")]


def test_malformed_claims_are_left_out(spark):
    docs = ['{"id": "Q1", "claims": {"P1": [{"id": "g", "rank": "normal", "mainsnak": {"datatype": "wikibase-item", "datavalue": {"value": {"id": "Q2"}}}}, {"rank": "normal"}], "P2": []}}', "not json", "{}"]
    got = catalog.claims_of(spark.createDataFrame([(d,) for d in docs], "json string"))
    assert values(got, "subject", "property", "value", "guid") == [("Q1", "P1", "Q2", "g")]


def test_labels_by_language(spark):
    terms = spark.createDataFrame([("Q1", "label", "en", "E"), ("Q1", "label", "mul", "M"), ("Q2", "label", "mul", "M"), ("Q2", "label", "aa", "A"), ("Q3", "label", "zz", "Z"), ("Q4", "label", "en", " ")], "entity string, kind string, lang string, text string")
    ids = spark.createDataFrame([(f"Q{i}",) for i in range(1, 5)], "qid string")
    assert values(claims.resolve_labels(ids, terms), "qid", "label") == [("Q1", "E"), ("Q2", "M"), ("Q3", "Z"), ("Q4", "Q4")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "child string, parent string")
    assert values(claims.closure(edges, spark.createDataFrame([("a",)], "node string")), "node") == [("a",), ("b",), ("c",), ("d",)]


def test_eligibility(spark):
    facts = {
        "free": ([], ["m1"]), "m1": (["M"], ["free"]), "m2": (["M"], ["m1"]), "m3": (["M"], ["m2"]), "out": ([], []), "kept": (["M"], ["free"]), "alone": (["M"], ["elsewhere"]), "under": (["M"], ["out"]),
        "x1": (["M"], ["x2"]), "x2": (["M"], ["x1"]), "y1": (["M"], ["y2", "free"]), "y2": (["M"], ["y1"]),
    }
    df = spark.createDataFrame([(q, t, p) for q, (t, p) in facts.items()], "qid string, types array<string>, parents array<string>")
    few = lambda *q: spark.createDataFrame([(x,) for x in q], "qid string")
    got = {r.qid: (r.eligible, r.reason) for r in records.eligible_records(df, ["M"], few("out"), few("kept")).collect()}
    assert got == {
        "free": (True, "unmarked"), "m1": (False, "rule"), "m2": (True, "orphan"), "m3": (False, "rule"), "out": (False, "declared"), "kept": (True, "exception"), "alone": (True, "orphan"),
        "under": (True, "orphan"), "x1": (None, "cycle"), "x2": (None, "cycle"), "y1": (False, "rule"), "y2": (True, "orphan"),
    }


def test_latest_version(spark):
    rows = [("a", "1", None), ("a", "2", None), ("b", "9", None), ("b", "1", "+2020-01-01T00:00:00Z"), ("c", "1", "2020-01-01"), ("c", "2", "2020-01-01"), ("d", "1", "2020-13-01"), ("e", " ", "2020-01-01")]
    got = records.latest_version(spark.createDataFrame(rows, "item string, version string, pub_date string"))
    assert values(got.withColumn("d", F.coalesce(F.col("release_date").cast("string"), F.lit(""))), "item", "version", "d") == [("a", "2", ""), ("b", "1", "2020-01-01"), ("c", "2", "2020-01-01"), ("d", "1", "")]


def plain_slugs(rows, taken):
    import re

    out = dict(taken)
    used = set(taken.values())
    for qid, label in sorted((r for r in rows if r[0] not in taken), key=lambda r: (r[1].casefold(), "i" + r[0])):
        slug = re.sub("[^a-z0-9]+", "-", label.lower()).strip("-") or "item"
        slug = f"{slug}-{qid.lower()}" if slug in used else slug
        used.add(slug)
        out[qid] = slug
    return out


def test_slugs(spark):
    labels = {"Q1": "Alpha", "Q2": "alpha!", "Q3": "Beta", "Q4": "alpha q2", "Q5": "Beta", "Q6": "???", "Q7": "Alpha Q1", "Q8": "Gamma"}
    taken = {"Q8": "kept", "Q9": "beta"}
    df = spark.createDataFrame([("d", q, t, "i" + q) for q, t in labels.items()], "dataset string, qid string, label string, item_iri string")
    registry = spark.createDataFrame([("d", q, s) for q, s in taken.items()], "dataset string, qid string, slug string")
    got = {r.qid: r.slug for r in records.assign_slugs(df, registry).collect()}
    assert got == plain_slugs(list(labels.items()), taken)


def test_urls(spark):
    repo = lambda u: scalar(spark, c.canonical_repository(F.lit(u)))
    assert repo("http://GitHub.com//a//b.git/?x#y") == "https://github.com/a/b" and repo("https://github.com/a") is None and repo("ftp://x/y/z") is None
    assert repo("https://host.org:8080/r/") == "https://host.org:8080/r" and repo("https://host.org/") is None
    space = lambda u: scalar(spark, c.namespace_family(F.lit(u)))
    assert space("HTTP://Ns.org/a//b#") == "http://ns.org/a/b" and space("http://ns.org/#") is None and space("urn:x:y#") == "urn:x:y" and space("no scheme") is None
    url = lambda u: scalar(spark, c.canonical_url(F.lit(u)))
    assert url("https://H.org?utm_a=1&b=&REF=2&c=a b#f") == "https://h.org/?b=&c=a+b" and url("https://u:p@h.org/") is None and url("http://h.org/") is None


def test_scalars(spark):
    assert scalar(spark, c.trimmed(F.lit("\t a "))) == "a"
    assert scalar(spark, c.slugify(F.lit("Été — Straße!"))) == "ete-strae" and scalar(spark, c.slugify(F.lit("中"), "unknown")) == "unknown"
    assert scalar(spark, c.is_negated(F.lit("we do not use "))) and not scalar(spark, c.is_negated(F.lit("not here; but ")))
    assert scalar(spark, c.parse_datetime(F.lit("+2024-00-00T00:00:00Z"))) is None
    assert scalar(spark, c.logged_query(F.lit("  ++ "))) is None


FEATURE = "dataset string, subject string, kind string, key string"


def features_of(spark, rows):
    return spark.createDataFrame([("d", s, "entity", s) for s in {r[0] for r in rows}] + [("d", *r) for r in rows], FEATURE)


@pytest.mark.parametrize("members, pairs", [(6, 30), (7, 0)])
def test_degree_limits(spark, members, pairs):
    rows = [(f"s{i}", "parent", "p") for i in range(members)] + [("p", "creator", "only")]
    f = features_of(spark, rows)
    scored = related.score_pairs(f, related.similarity_context(f))
    assert scored.filter(F.array_contains("reasons", F.lit("shared_parent"))).count() == pairs
    assert scored.filter(F.array_contains("reasons", F.lit("direct_relationship"))).count() == 2 * members


def test_uncataloged_parents_do_not_count(spark):
    f = features_of(spark, [("a", "parent", "gone"), ("b", "parent", "gone")])
    assert related.related_candidates(f, related.similarity_context(f)).count() == 0


def test_weak_evidence_and_thresholds(spark):
    rows = [(s, "creator", "c") for s in ("a", "b")] + [(s, "category", "k") for s in ("a", "b")]
    f = features_of(spark, rows)
    r = related.score_pairs(f, related.similarity_context(f)).first()
    assert (r.score, r.qualifies) == (59, False)
    tokens = [("a", "token", t) for t in ("one1", "two2", "thr3", "fou4")] + [("b", "token", t) for t in ("one1", "two2", "xxx5", "yyy6", "zzz7", "www8")]
    f = features_of(spark, rows + tokens)
    r = related.score_pairs(f, related.similarity_context(f)).first()
    assert (r.score, r.qualifies, r.components[-1].evidence[-1]) == (62, True, "jaccard=0.250000")
    f = features_of(spark, rows + [("a", "token", "one1"), ("b", "token", "one1")])
    assert related.score_pairs(f, related.similarity_context(f)).first().score == 59


def test_top_five_by_id_and_never_across_datasets(spark):
    rows = [(f"s{i}", "repository", "r") for i in range(9)]
    f = features_of(spark, rows).union(spark.createDataFrame([("e", "other", "repository", "r")], FEATURE))
    top = related.related_top_k(related.score_pairs(f, related.similarity_context(f)))
    assert [r.candidate for r in top.filter("subject = 's0'").orderBy("rank").collect()] == ["s1", "s2", "s3", "s4", "s5"]
    assert top.filter("subject = 'other' or candidate = 'other'").count() == 0


CLAIMS = "qid string, guid string, property string, value string, rank string"


def test_claim_edits(spark):
    before = spark.createDataFrame([("Q1", "g1", "P1", "a", "normal"), ("Q1", "g2", "P1", "b", "normal"), ("Q1", "g3", "P1", "b", "normal")], CLAIMS)
    intent = spark.createDataFrame([("Q1", "remove", "P1", "a"), ("Q1", "remove", "P1", "b"), ("Q1", "remove", "P1", "z"), ("Q1", "add", "P2", "c"), ("Q1", "add", "P1", "a"), ("Q1", "swap", "P9", "c")], "qid string, action string, property string, value string")
    resolved = audit.resolve_edit_operations(before, intent)
    assert sorted((r.action, r.value, r.claim_guid, r.error is None) for r in resolved.collect()) == [
        ("add", "a", None, False), ("add", "c", None, True), ("remove", "a", "g1", True), ("remove", "b", None, False), ("remove", "z", None, False), ("swap", "c", None, False)]
    proposed = audit.apply_edit_operations(before, resolved.filter("error is null"))
    assert sorted((r.property, r.value, r.guid or "") for r in proposed.collect()) == [("P1", "b", "g2"), ("P1", "b", "g3"), ("P2", "c", "")]
    rest = [("Q1", "g2", "P1", "b", "normal"), ("Q1", "g3", "P1", "b", "normal")]
    check = lambda more: audit.claims_match_proposal(spark.createDataFrame(rest + more, CLAIMS), proposed).first().matches
    assert check([("Q1", "new", "P2", "c", "normal")])
    assert not check([]) and not check([("Q1", None, "P2", "c", "normal")]) and not check([("Q1", "n", "P2", "c", "normal"), ("Q1", "m", "P2", "c", "normal")])
    assert not check([("Q1", "new", "P2", "c", "preferred")])


ITEM = "dataset string, qid string, canonicalUrl string, homepage string, license string"


@pytest.mark.parametrize("lost, found", [(2, []), (3, ["warning"]), (10, ["warning"]), (11, ["error"])])
def test_losses(spark, lost, found):
    item = lambda i: ("d", f"Q{i}", f"u{i}", "h", "l")
    baseline = spark.createDataFrame([item(i) for i in range(100)], ITEM)
    current = spark.createDataFrame([item(i) for i in range(lost, 150)], ITEM)
    out = gates.check_regressions(current, baseline, ["license"])
    assert [r.severity for r in out.filter("code = 'record-loss'").collect()] == found


def test_empty_baseline_and_moved_urls(spark):
    now = spark.createDataFrame([("d", "Q1", "u1", None, "l"), ("d", "Q2", "new", None, "")], ITEM)
    assert [r.code for r in gates.check_regressions(now, now.limit(0), ["license"]).filter("severity = 'error'").collect()] == ["baseline-empty"]
    then = spark.createDataFrame([("d", "Q1", "u1", "h", "l"), ("d", "Q2", "old", "h", "l")], ITEM)
    assert values(gates.check_regressions(now, then, ["license", "homepage"]), "code", "subject") == [("homepage-coverage", "homepage"), ("metadata-coverage", "homepage"), ("metadata-coverage", "license"), ("uri-stability", "Q2")]


def test_coverage_floor(spark):
    rows = lambda v: spark.createDataFrame([("resource", v), ("software", 1.0)], "dataset string, coverage double")
    policy = {"maximumEmptyShare": 0.2, "maximumUnreviewedCoverageDecline": 0.05}
    gate = lambda v, p=policy, b=1.0: sorted(r.code for r in gates.coverage_gate(rows(v), rows(b), p, "g").collect())
    assert gate(0.8, b=0.85) == [] and gate(0.79, b=0.8) == ["coverage-floor"] and gate(0.8, b=0.86) == ["coverage-decline"]
    reviewed = {"baselineGenerationId": "g", "catalog": "resource", "rationale": "seen", "minimumCoverageShare": 0.7}
    assert gate(0.75, policy | {"acceptedShortfalls": [reviewed], "acceptedDeclines": [reviewed]}) == []
    assert gate(0.75, policy | {"acceptedShortfalls": [reviewed | {"baselineGenerationId": "h"}], "acceptedDeclines": [reviewed | {"rationale": " "}]}) == ["coverage-decline", "coverage-floor"]


def test_sorting(spark):
    df = spark.createDataFrame([("item 10",), ("item 2",), ("Élan",), ("elan b",), (None,), (" ",)], "title string")
    order = lambda o: [r.title for r in search.sort_items(df, F.col("title"), o).collect()]
    assert order("asc")[:4] == ["Élan", "elan b", "item 2", "item 10"] and set(order("asc")[4:]) == {None, " "}
    assert order("desc")[:4] == ["item 10", "item 2", "elan b", "Élan"] and set(order("desc")[4:]) == {None, " "}
    assert search.page_of(101, 9, 50) == (3, 3) and search.page_of(0, 1) == (1, 1)
    assert search.limit_results(spark.range(99), 0).count() == 1 and search.limit_results(spark.range(99), 51).count() == 50 and search.limit_results(spark.range(99), None).count() == 20


def test_acronyms(spark):
    term = lambda t, a: scalar(spark, search.best_search_term(F.lit(t), F.array(*map(F.lit, a))))
    assert term("Simple System", ["SKOS", "RDF", "OWL"]) == "RDF" and term("Long title", ["other"]) == "other" and term("ABC", []) == "ABC"


def test_vectors_and_generations(spark):
    v = spark.createDataFrame([("g1:software:Q1", "g1", "software"), ("g1:software:Q1", "g1", "software"), ("g2:ontologies:Q2", "g1", "software"), ("loose", "g1", "software")], "id string, namespace string, dataset string")
    expected = spark.createDataFrame([("g1:software:Q1",), ("g1:software:Q3",)], "id string")
    got = values(search.check_vectors(v.filter("id <> 'loose'"), expected, "g1"), "code", "subject")
    assert got == [("duplicate-vector", "g1:software:Q1"), ("missing-vector", "g1:software:Q3"), ("unexpected-vector", "g2:ontologies:Q2"), ("wrong-dataset", "g2:ontologies:Q2"), ("wrong-generation", "g2:ontologies:Q2")]
    retained = spark.createDataFrame([("g2", True)], "generation_id string, ready boolean")
    assert values(search.obsolete_generations(v, retained, 1), "id", "batch") == [("g1:software:Q1", 0), ("g1:software:Q1", 1)]
    with pytest.raises(ValueError):
        search.obsolete_generations(v, retained.withColumn("ready", F.lit(False)))


def test_triples_survive_lines(spark):
    rows = [("a", "p", 'x "q" \\ \n\t', "literal", None, "en"), ("a", "p", "5", "literal", "xsd:int", None), ("_:n", "p", "b", "iri", None, None), ("a", "p", "_:n", "bnode", None, None)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    assert sorted(map(str, catalog.from_ntriples(catalog.to_ntriples(df)).collect())) == sorted(map(str, df.collect()))


def test_table_digest_does_not_depend_on_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 3)
    digest = lambda d, v=None: snapshot.table_digest(d, v).first().digest
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(3)) != digest(df.filter("id > 0"))
    assert digest(df, ["x"]) == digest(df.withColumn("x", F.lit(0)), ["x"])


def test_unknown_labels_and_failing_batches(spark):
    items = spark.createDataFrame([("Q1", "a"), ("Q2", "b"), ("Q2", "b"), ("Q3", "bad")], "qid string, text string").coalesce(1)
    vocab = spark.createDataFrame([("A",)], "label string")

    def label(batch):
        if any(t == "bad" for _, t in batch):
            raise RuntimeError
        return {q: t.upper() for q, t in batch} | {"Q9": "A"}

    got = audit.classify_missing(items, vocab, label, 1).collect()
    assert sorted((r.qid, r.accepted) for r in got) == [("Q1", True), ("Q2", False), ("Q3", False)]
    assert {r.qid: r.error for r in got if r.error} == {"Q3": "RuntimeError: "}


def test_best_related_needs_no_pair_that_cannot_qualify(spark):
    import random

    chance, rows = random.Random(5), []
    kinds = {"category": 3, "software_type": 3, "rdf_type": 2, "language": 3, "license": 2, "token": 12}
    for i in range(60):
        rows += [("d", f"s{i}", "entity", f"e{i}"), ("d", f"s{i}", "creator", f"c{chance.randrange(3)}"), ("d", f"s{i}", "creator", f"c{chance.randrange(3)}")]
        rows += [("d", f"s{i}", kind, f"{kind}{chance.randrange(n)}") for kind, n in kinds.items() for _ in range(3 if kind == "token" else 1) if chance.random() < 0.7]
        rows += [("d", f"s{i}", "repository", f"r{chance.randrange(20)}")] * (i % 3 == 0)
    features = spark.createDataFrame(rows, "dataset string, subject string, kind string, key string").distinct()
    context = related.similarity_context(features)
    for config in (related.Config(), related.Config(threshold=55), related.Config(threshold=58)):
        best = related.best_related(features, context, config)
        whole = related.related_top_k(related.score_pairs(features, context, config))
        columns = ("subject", "candidate", "score", "rank", "reasons", "components")
        assert values(best, *columns) == values(whole, *columns)
        assert best.count()


AUDITED = "qid string, label string, signals array<string>, matched_classes array<string>, websites array<string>"


def test_states_of_an_audit(spark):
    ids = ("Q1", "Q2", "Q3", "Q4")
    rows = [(q, "l", ["confirmed-exclusion"] if q == "Q3" else ["direct-part-of", "term-like-label"], ["C1", "C2"], ["https://x/"]) for q in ids]
    signalled = spark.createDataFrame(rows, AUDITED)
    intent = spark.createDataFrame([("Q1", "edit", "why", ["https://e/"]), ("Q2", "edit", "why", ["https://e/"])], "qid string, decision string, rationale string, evidence_urls array<string>")
    before = spark.createDataFrame([(q, "g" + q, "P1", "a", "normal") for q in ids], CLAIMS)
    operations = spark.createDataFrame([("Q1", "remove", "P1", "a"), ("Q2", "add", "P2", "b")], "qid string, action string, property string, value string")
    revisions = spark.createDataFrame([(q, 7) for q in ids], "qid string, revision long")
    planned = audit.build_audit(signalled, before, intent, operations, revisions)
    said = {r.qid: r for r in planned.collect()}
    assert [said[q].decision for q in ids] == ["edit", "edit", "exclude-locally", "retain"] and [said[q].status for q in ids] == ["planned", "planned", "no-edit", "no-edit"]
    assert said["Q4"].rationale.startswith("Retain after review against source class match(es) C1, C2: the direct part-of") and "; term-like text" in said["Q4"].rationale
    assert said["Q1"].evidence_urls == ["https://e/", "https://www.wikidata.org/wiki/Q1", "https://x/"] and said["Q1"].old_revision == 7
    found = lambda rows: values(audit.audit_checks(rows, signalled, intent), "code", "subject")
    assert found(planned) == []
    edit = lambda claims, revision: audit.record_edits(planned, spark.createDataFrame([("Q2", claims, revision)], f"qid string, claims {audit.CLAIM_LIST}, revision long"))
    good = [("P1", "a", "gQ2", "normal"), ("P2", "b", "new", "normal")]
    assert found(edit(good, 8)) == []
    assert found(edit(good, 7)) == [("revision-not-advanced", "Q2")]
    assert found(edit(good[:1], 8)) == [("after-claims-differ", "Q2")]
    assert found(edit(None, 8)) == [("revision-evidence-missing", "Q2")]
    change = lambda name, value, who="Q2": planned.withColumn(name, F.when(F.col("qid") == who, value).otherwise(F.col(name)))
    assert found(change("new_revision", F.lit(9).cast("bigint"))) == [("planned-state", "Q2")]
    assert found(change("decision", F.lit("retain"), "Q3")) == [("decision-differs", "Q3")]
    assert found(change("evidence_urls", F.array(F.lit("https://x/")))) == [("evidence-missing", "Q2")]
    assert found(change("status", F.lit("planned"), "Q4")) == [("edit-unauthorized", "Q4"), ("planned-state", "Q4")]
    assert found(change("proposed_claims", F.col("before_claims"), "Q1")) == [("proposal-differs", "Q1")]


def test_mentions_of_a_page(spark):
    base, url = "https://c.example", "https://c.example/software/"
    tool = lambda n, title="T": (title + n, url + n + "/")
    items = spark.createDataFrame(
        [("software", "Q1", url + "a/", [tool("b"), tool("gone"), (" ", url + "c/")]), ("software", "Q2", url + "b/", [tool("gone")]), ("software", "Q3", url + "c/", [])],
        "dataset string, qid string, canonicalUrl string, relatedTools array<struct<title:string,canonicalUrl:string>>",
    )
    right = '[{"@type":"SoftwareApplication","name":"Tb","@id":"https://c.example/software/b/"}]'
    sitemap = items.select(F.col("canonicalUrl").alias("url"))

    def found(a, b=None):
        body = lambda n, m: f'<script type="application/ld+json">{{"@id":"{url}{n}/"{"" if m is None else ", " + chr(34) + "mentions" + chr(34) + ":" + m}}}</script>'
        pages = spark.createDataFrame([("software", n, body(n, m)) for n, m in (("a", a), ("b", b), ("c", None))], "dataset string, slug string, html string")
        out = gates.check_page_contracts(pages, items, sitemap, items.limit(0).select("dataset", "qid"), base)
        return values(out.filter("code <> 'related-without-page'"), "code", "subject")

    assert found(right) == []
    differs = [("page-mentions-differ", url + "a/")]
    assert found(None) == differs and found("[]") == differs and found(right.replace("Tb", "Tc")) == differs and found(right.replace('"name"', '"more":"x","name"')) == differs
    assert found(right, "[]") == [("page-mentions-differ", url + "b/")]


def test_a_digest_tree_is_read_along_one_branch(spark):
    """One changed, one missing, one new file and one listed twice of 3,000: only their leaves differ, and only their files are compared."""
    made = [(f"t{i % 2}/{i}", f"{i:064x}") for i in range(3000)]
    files = spark.createDataFrame(made, "path string, sha256 string")
    tree = snapshot.digest_tree(files)
    assert {(r.tree, r.files) for r in tree.filter("level = 0").collect()} == {("t0", 1500), ("t1", 1500)}
    assert snapshot.differing_leaves(tree, snapshot.digest_tree(files.repartition(3))).count() == 0
    now = spark.createDataFrame([(p, "other" if p == "t0/40" else d) for p, d in made if p != "t1/7"] + [("t1/new", "d")], "path string, sha256 string")
    listed = files.unionByName(files.filter("path = 't0/100'"))
    leaf = lambda path: __import__("hashlib").sha256(path.encode()).hexdigest()[:3]
    differ = snapshot.differing_leaves(snapshot.digest_tree(listed), snapshot.digest_tree(now))
    assert values(differ, "tree", "node") == sorted((p.split("/")[0], leaf(p)) for p in ("t0/40", "t1/7", "t1/new", "t0/100"))
    got = values(snapshot.verify_manifest(snapshot.digest_tree(listed), listed, now), "code", "subject")
    assert got == [("digest-differs", "t0/40"), ("file-missing", "t1/7"), ("file-not-listed", "t1/new"), ("listed-twice", "t0/100")]
    assert snapshot.digest_tree(files.limit(0)).count() == 0 and snapshot.differing_leaves(tree, snapshot.digest_tree(files.filter("path like 't0/%'"))).filter("tree = 't0'").count() == 0


def test_a_record_without_claims_matches_its_proposal(spark):
    claims = "qid string, guid string, property string, value string, rank string"
    before = spark.createDataFrame([("Q1", "g1", "P1", "V", "normal"), ("Q2", "g2", "P1", "V", "normal")], claims)
    removed = spark.createDataFrame([("Q1", "remove", "P1", "V", "g1", None)], "qid string, action string, property string, value string, claim_guid string, error string")
    left = audit.apply_edit_operations(before, removed)
    assert {r.qid: r.matches for r in audit.claims_match_proposal(left, left, before).collect()} == {"Q1": True, "Q2": True}


@pytest.mark.parametrize("threshold", [55, 58, 60])
def test_copies_of_records_are_scored_once(spark, threshold):
    import random

    chance, rows = random.Random(threshold), []
    kinds = {"category": 2, "license": 2, "language": 2, "token": 6}
    kept = [[("creator", f"c{chance.randrange(3)}") for _ in range(2)] + [(kind, f"{kind}{chance.randrange(n)}") for kind, n in kinds.items() for _ in range(3 if kind == "token" else 1)] for _ in range(5)]
    for i in range(70):
        rows += [("d", f"s{i}", *f) for f in kept[chance.randrange(5)]] + [("d", f"s{i}", "entity", f"e{i}")] + [("d", f"s{i}", "repository", f"r{chance.randrange(25)}")] * (i % 2)
    features = spark.createDataFrame(rows, "dataset string, subject string, kind string, key string").distinct()
    context, config = related.similarity_context(features), related.Config(threshold=threshold)
    whole = related.score_pairs(features, context, config)
    columns = ("subject", "candidate", "score", "rank", "reasons", "components")
    assert values(related.best_related(features, context, config), *columns) == values(related.related_top_k(whole, config.max_related), *columns)
    counts = related.pair_counts(features, context, config).first()
    assert (counts.n, counts.below) == (whole.count(), whole.filter("not qualifies").count())
    assert related._creator_pairs(features, config).count() <= 70 * (config.max_related + 1)  # 70 * 69 pairs before


def test_all_pairs_come_from_rows_that_are_alike(spark, monkeypatch):
    import random

    chance, rows = random.Random(5), []
    kinds = {"category": 2, "license": 2, "token": 6}
    kept = [[("creator", f"c{chance.randrange(3)}") for _ in range(2)] + [(kind, f"{kind}{chance.randrange(n)}") for kind, n in kinds.items() for _ in range(3 if kind == "token" else 1)] for _ in range(5)]
    for i in range(60):
        rows += [("d", f"s{i}", *f) for f in kept[chance.randrange(5)]] + [("d", f"s{i}", "entity", f"e{i}")] + [("d", f"s{i}", "repository", f"r{i % 20}")] * (i % 7 == 0)
        rows += [("d", f"s{i}", kind, f"e{chance.randrange(60)}") for kind in ("parent", "uses") if i % 5 == 0]
    features = spark.createDataFrame(rows, FEATURE).distinct()
    context, config = related.similarity_context(features), related.Config()
    evidence = related.candidate_evidence(features, context, config).localCheckpoint()
    columns = ("subject", "candidate", "score", "qualifies", "reasons", "components")
    wanted = values(related.score_pairs(features, context, config, evidence), *columns)
    pairs = values(evidence.distinct(), "subject", "candidate")
    met = related._met(related._alike(features, related._keyed(features, context, config), related._weak_kinds(config)))
    assert 2 * met.count() < len(set(pairs))  # pairs of rows that are alike, not of records
    for chunk, block in ((500, 2000), (3, 4)):  # also where a class is several rows and a key several blocks
        monkeypatch.setattr(related, "CHUNK", chunk)
        monkeypatch.setattr(related, "BLOCK", block)
        assert values(related.score_pairs(features, context, config), *columns) == wanted
        assert values(related.related_candidates(features, context, config), "subject", "candidate") == sorted(set(pairs))


def test_pairs_are_scored_before_they_are_made(spark, sf_dir):
    """Sets of any size score as by plain sets; of what a pair may name, only names that share a key are kept, and no text is made for a pair."""
    import random
    from itertools import permutations

    from cairn.plans import registry

    chance = random.Random(3)
    kinds = {"creator": (3, 2), "category": (3, 3), "license": (4, 2), "token": (7, 5)}
    sets = {f"s{i}": {kind: {f"{kind}{x}" for x in chance.sample(range(n), chance.randint(0, most))} for kind, (n, most) in kinds.items()} for i in range(14)}
    rows = [("d", s, kind, key) for s, own in sets.items() for kind, keys in own.items() for key in keys] + [("d", s, "entity", s) for s in sets]
    sets_of = lambda a, b, kind: (sets[a][kind], sets[b][kind])
    wanted = []
    for a, b in permutations(sets, 2):
        share = {kind: len(set.intersection(*sets_of(a, b, kind))) for kind in kinds}
        if share["creator"]:
            close = share["token"] >= 2 and share["token"] / len(set.union(*sets_of(a, b, "token"))) >= 0.25
            wanted.append((a, b, 55 + 4 * bool(share["category"]) + 2 * bool(share["license"]) + 3 * close, "shared_creator"))
    features = spark.createDataFrame(rows, FEATURE)
    context = related.similarity_context(features)
    assert sorted(map(tuple, related.score_pairs(features, context).select("subject", "candidate", "score", "reason_text").collect())) == sorted(wanted)
    named = next((a, b) for a, b, *_ in wanted)
    links = [("d", named[0], "uses", named[1]), ("d", "x", "uses", named[1]), ("d", "x", "creator", "alone")]
    features = features.union(spark.createDataFrame(links, FEATURE))
    alike = related._alike(features, related._keyed(features, context, related.Config()), [])
    assert [tuple(n) for r in alike.collect() for n in r.names] == [named]
    plan = registry.QUERIES["score_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan.split("Generate explode(r_members")[0]  # a sort and a join of texts for each pair before


def test_names_are_looked_up_only_for_rows_that_have_some(spark, sf_dir):
    from cairn.plans import registry

    plan = registry.QUERIES["related_candidates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains") == plan.count("CASE WHEN named") * 2 == 2  # for every pair before


def test_audit_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    signalled = spark.createDataFrame([(f"Q{i}", "x", ["confirmed-exclusion"], ["Q1"], ["https://x/"]) for i in range(8)], "qid string, label string, signals array<string>, matched_classes array<string>, websites array<string>")
    intent = spark.createDataFrame([("Q1", "edit", "because", ["https://e/"])], "qid string, decision string, rationale string, evidence_urls array<string>")
    before = spark.createDataFrame([("Q1", "g", "P1", "V1", "normal")], CLAIMS)
    operations = spark.createDataFrame([("Q1", "remove", "P1", "V1")], "qid string, action string, property string, value string")
    rows = audit.build_audit(signalled, before, intent, operations).filter("qid <> 'Q7'")
    rows = rows.mapInArrow(counted, rows.schema)
    assert values(audit.audit_checks(rows, signalled, intent), "code", "subject") == [("candidate-missing", "Q7")]
    assert made.value == 7


def test_linked_data_keeps_every_text(spark):
    """Line separators, quotes, brackets and braces at the ends of texts; pages of other places are no mentions."""
    import json

    base, odd = "https://c.example", '}]"a b\u0085c\n"[{'
    tool = lambda title, url: (title, url)
    row = {c: odd for c in ("title", "description", "homepage", "wikidataId", "latestVersion", "sourceRepo")} | {
        "dataset": "software", "qid": "Q1", "canonicalUrl": base + "/software/a/", "releaseDate": "  ", "softwareType": None, "aliases": [odd, " ", None], "licenses": [None, odd, "x"],
        "programmingLanguages": ["{", "]"], "creators": [(odd, "Person", odd, None, " "), (" ", "Person", None, None, None), ("B", "Group", "x", "y", None)],
        "relatedTools": [tool(odd, base + "/resource/b/"), tool("c", base + "/software/c"), tool("d", base + "/software/d/e/"), tool(" ", base + "/software/f/"), tool("g", base + "/software/g/\n"), tool("h", "https://c-example/software/h/")],
    }
    kind = catalog.ITEM + ", dataset string, qid string"
    items = spark.createDataFrame([row, row | {"qid": "Q2", "title": " \n"}], kind)
    good, bad = pages.project_json_ld(items, base, odd)
    assert [(r.qid, list(json.loads(r.json_ld).items())) for r in good.collect()] == [("Q1", list({
        "@context": "https://schema.org", "@type": "SoftwareApplication", "@id": base + "/software/a/", "name": odd, "description": odd, "url": odd, "sameAs": odd, "alternateName": odd, "license": odd,
        "isPartOf": {"@type": "DataCatalog", "name": odd, "url": base}, "softwareVersion": odd, "codeRepository": odd, "programmingLanguage": ["{", "]"],
        "creator": [{"@type": "Person", "name": odd, "sameAs": odd}, {"@type": "Group", "name": "B", "sameAs": ["x", "y"]}], "mentions": [{"@type": "DefinedTermSet", "@id": base + "/resource/b/", "name": odd}],
    }.items()))]
    assert [(r.subject, r.message) for r in bad.collect()] == [("Q2", "title")]


def test_pages_are_read_once(spark):
    made, base = spark.sparkContext.accumulator(0), "https://c.example"

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    url = lambda i: f"{base}/software/{i}/"
    items = spark.createDataFrame(
        [("software", f"Q{i}", url(i), [(f"T{i + 1}", url(i + 1))] * (i < 6)) for i in range(8)], "dataset string, qid string, canonicalUrl string, relatedTools array<struct<title:string,canonicalUrl:string>>"
    )
    body = lambda i: f'<script type="application/ld+json">{{"@id":"{url(i)}","mentions":[{{"@type":"SoftwareApplication","@id":"{url(i + 1)}","name":"T{i + 1}"}}]}}</script>'
    pages = spark.createDataFrame([("software", str(i), body(i)) for i in (0, 1, 2, 4, 9)], "dataset string, slug string, html string")
    sitemap = spark.createDataFrame([(url(i),) for i in (0, 1, 2, 7)], "url string")
    out = gates.check_page_contracts(pages.mapInArrow(counted, pages.schema), items, sitemap, items.filter("qid = 'Q3'").select("dataset", "qid"), base)
    assert values(out, "code", "subject") == sorted([
        ("page-without-record", url(9)), ("page-not-in-sitemap", url(4)), ("page-not-in-sitemap", url(9)), ("sitemap-without-page", url(7)), ("related-without-page", url(2)), ("related-without-page", url(4)),
        ("page-mentions-differ", url(2)), ("page-mentions-differ", url(4)), ("page-mentions-differ", url(9)), ("page-lost", "Q3"),
    ])
    assert made.value == 5


def _rows_shuffled(spark) -> int:
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_edges_are_shuffled_once(spark):
    """Each edge stands there twice: equal ones meet where their subject does, and a cohort of any size is not sent to all."""
    made = [(f"s{i % 700}", "p" if i % 3 else "q", f"o{i % 6}") for i in range(4200)]
    edges = spark.createDataFrame(made + made, "subject_qid string, property_id string, object_qid string")
    cohort = spark.createDataFrame([(f"s{i}", ["a"]) for i in range(0, 700, 2)], "qid string, catalogs array<string>")
    reviewed = spark.createDataFrame([("p",), ("q",), ("r",)], "property_id string")
    own = {(p, s, o) for s, p, o in made if int(s[1:]) % 2 == 0}
    degrees = lambda p: sorted(((-sum(e[0] == p and e[2] == o for e in own), o) for o in {e[2] for e in own if e[0] == p}))[:2]
    before, limit = _rows_shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats, best = profile.reviewed_profile(edges, cohort, reviewed, 2)
        found = values(best, "property_id", "object_qid", "degree", "rank")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == sorted((p, o, -d, i + 1) for p in "pq" for i, (d, o) in enumerate(degrees(p)))
    assert _rows_shuffled(spark) - before < 2 * len(made) + 700  # each edge, the cohort and counts
    assert {r.property_id: r.edges for r in stats.collect()} == {p: sum(e[0] == p for e in own) for p in "pqr"}
    both = cohort.unionByName(spark.createDataFrame([("o0", ["a", "b"])], cohort.schema))
    assert sorted((r.property_id, r.subject_qid, r.object_qid) for r in profile.in_cohort(edges, both).collect()) == sorted(e for e in own if e[2] == "o0")
    plan = profile.leaving(edges, cohort)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_records_become_triples_with_their_nodes(spark, sf_dir):
    """Creators, licenses and classes are nodes with their own fields, each made once; parents, source types and uses are links."""
    from cairn.operators import triples
    from cairn.plans import registry

    node = "array<struct<iri: string, label: string, kind: string, licenseName: string, wikidataId: string, githubProfile: string>>"
    kind = f"subject string, title string, category string, licenses array<string>, creators array<string>, parents array<string>, source_types array<string>, uses array<string>, nodes {node}"
    maker, free, none = ("k:m", "Maker", "Person", None, "e:Q1", "g:m"), ("k:l", "Free", "License", "Free", None, None), (None, "x", "License", "x", None, None)
    rows = [("u:1", "One", "k:c", ["k:l"], ["k:m"], ["e:Q2"], ["e:Q3"], ["e:Q4"], [maker, free, none, ("k:c", "C", "Category", None, None, None)]), ("u:2", None, None, None, ["k:m"], None, None, None, [maker])]
    made = [(r.s, r.p, r.o, r.o_kind) for r in triples.records_to_triples(spark.createDataFrame(rows, kind)).collect()]
    wanted = [("u:1", p, o, "iri") for p, o in (("category", "k:c"), ("license", "k:l"), ("creator", "k:m"), ("isPartOf", "e:Q2"), ("sourceType", "e:Q3"), ("uses", "e:Q4"))] + [("u:1", p, "One", "literal") for p in ("title", "label")]
    wanted += [("u:2", "creator", "k:m", "iri"), ("k:m", "label", "Maker", "literal"), ("k:m", "rdf:type", "Person", "iri"), ("k:m", "wikidataId", "e:Q1", "iri"), ("k:m", "githubProfile", "g:m", "iri")]
    wanted += [("k:l", p, "Free", "literal") for p in ("label", "licenseName")] + [("k:l", "rdf:type", "License", "iri"), ("k:c", "label", "C", "literal"), ("k:c", "rdf:type", "Category", "iri")]
    assert sorted(made) == sorted(wanted)
    whole = registry.QUERIES["records_to_triples"](spark, sf_dir)
    assert {r.o for r in whole.filter("p = 'rdf:type'").collect()} == {"Category", "SoftwareType", "License", "Person"}  # no node before
    assert whole.filter("p = 'creator'").count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
