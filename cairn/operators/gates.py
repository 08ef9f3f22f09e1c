"""Quality gates over snapshots.  Every gate gives ``violations(code, severity, dataset, subject, message)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled, is_absolute_iri, is_bare_id, page_iri, page_type, present, qid
from ..session import bounded, written

# Limits of regressions.
LOSS_ERROR, LOSS_WARNING, HOMEPAGE_WARNING, FIELD_DROP_WARNING = 0.10, 0.02, 0.30, 0.02


def violations(rows: DataFrame, code: Column | str, subject: Column | str, message: Column | str = "", severity: str = "error", dataset: Column | str | None = None) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    place = F.col("dataset") if dataset is None and "dataset" in rows.columns else F.lit(None).cast("string") if dataset is None else lit(dataset)
    who = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(lit(code).alias("code"), F.lit(severity).alias("severity"), place.alias("dataset"), who.cast("string").alias("subject"), lit(message).cast("string").alias("message"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


SHAPES = "shape string, target_kind string, target string, path string, min_count int, max_count int, datatype string, node_kind string, class string, in_values array<string>, pattern string, min_length int, node string, min_inclusive double"


def check_shapes(triples: DataFrame, shapes: DataFrame, class_property: str = "rdf:type") -> DataFrame:
    """G1: ``shapes`` has a row for each property of a shape, with the columns of ``SHAPES`` (``node`` and ``min_inclusive`` may be missing).

    Targets are the instances of a class, the subjects of a property, or none: such a shape is only referred to.  Without a ``path`` a row is about the focus node itself.
    Values are counted after one join by (subject, path), so a target without values is still seen.

    A row with ``node`` asks that each value conforms to that shape.  Those pairs of value and shape are gathered outward from the targets, a round for each step between shapes,
    and judged like targets; what does not conform then goes back along the same references, a join a round, until nothing new fails.  So a reference to a shape that refers back
    (a cycle) fails only where some node on the way fails by itself.  Each value that does not conform is one ``node`` violation of the node that holds it; its own faults are listed where it is a target.
    """
    shapes = shapes.withColumns({c: F.lit(None).cast(kind) for c, kind in (("node", "string"), ("min_inclusive", "double")) if c not in shapes.columns})
    small = bounded(shapes, SHAPE_ROWS)
    classes = triples.filter(F.col("p") == class_property).select("s", F.col("o").alias("_class"))
    targets = bounded(shapes.select("shape", "target_kind", "target").distinct(), SHAPE_ROWS)
    by_class = classes.join(targets.filter("target_kind = 'class'"), F.col("_class") == F.col("target")).select("s", "shape")
    by_path = triples.select("s", F.col("p").alias("_p")).distinct().join(targets.filter("target_kind = 'subjects_of'"), F.col("_p") == F.col("target")).select("s", "shape")
    focus = by_class.unionByName(by_path).distinct()
    if shapes.filter("node is not null").isEmpty():
        return _reported(_own_faults(focus, triples, classes, small))
    focus = written(focus, "targets")
    pairs, references = _referred(focus, triples, small)
    faults = written(_own_faults(pairs, triples, classes, small), "faults")
    failed = _failing(faults.select("s", "shape").distinct(), references)
    nested = references.join(failed.select(F.col("s").alias("o"), F.col("shape").alias("node")), ["o", "node"], "left_semi").select(F.lit("node").alias("code"), "s", "shape", "path")
    return _reported(faults.unionByName(nested).join(focus, ["s", "shape"], "left_semi"))


#: Rows of a table of shapes, which is broadcast.
SHAPE_ROWS = 100_000


def _reported(faults: DataFrame) -> DataFrame:
    return violations(faults, F.col("code"), "s", F.col("path"))


def _referred(focus: DataFrame, triples: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs ``s, shape`` to judge, and the references ``s, shape, path, o, node`` between them."""
    wanted = shapes.filter("node is not null").select("shape", F.col("path").alias("_path"), "node")
    pairs, references, new = focus, [], focus
    while not references or not new.isEmpty():
        asked = new.join(wanted, "shape")
        values = asked.filter("_path is not null").join(triples.select("s", F.col("p").alias("_path"), "o"), ["s", "_path"]).select("s", "shape", F.col("_path").alias("path"), "o", "node")
        itself = asked.filter("_path is null").select("s", "shape", F.col("_path").alias("path"), F.col("s").alias("o"), "node")
        found = written(values.unionByName(itself).distinct(), "references")
        references.append(found)
        new = written(found.select(F.col("o").alias("s"), F.col("node").alias("shape")).distinct().join(pairs, ["s", "shape"], "left_anti"), "referred")
        pairs = pairs.unionByName(new)
    return pairs, _all(*references)


def _failing(failed: DataFrame, references: DataFrame) -> DataFrame:
    """The pairs that fail by themselves or through a reference to one that fails."""
    new = failed = written(failed, "failed")
    while not new.isEmpty():
        back = references.join(new.select(F.col("s").alias("o"), F.col("shape").alias("node")), ["o", "node"], "left_semi").select("s", "shape").distinct()
        new = written(back.join(failed, ["s", "shape"], "left_anti"), "failed")
        failed = failed.unionByName(new)
    return failed


def _own_faults(focus: DataFrame, triples: DataFrame, classes: DataFrame, shapes: DataFrame) -> DataFrame:
    """``code, s, shape, path`` of constraints that do not look into another shape."""
    wanted = focus.join(shapes.drop("target_kind", "target", "node").distinct(), "shape")
    values = triples.select("s", F.col("p").alias("path"), "o", "o_kind", F.col("datatype").alias("_datatype"))
    met = wanted.filter("path is not null").join(values, ["s", "path"], "left")
    counts = met.groupBy("s", "shape", "path", "min_count", "max_count").agg(F.count("o").alias("n"))
    fault = lambda rows, code: rows.select(code.alias("code"), "s", "shape", "path")
    number = F.array_compact(F.array(F.when(F.col("n") < F.col("min_count"), F.lit("min-count")), F.when(F.col("n") > F.col("max_count"), F.lit("max-count"))))
    have = met.filter("o is not null")
    kind = F.when(F.col("node_kind") == "iri", F.col("o_kind") != "iri").when(F.col("node_kind") == "literal", F.col("o_kind") != "literal").when(F.col("node_kind") == "bnode_or_iri", ~F.col("o_kind").isin("iri", "bnode"))
    least = F.col("o").try_cast("double") >= F.col("min_inclusive")
    checks = {
        "datatype": F.col("datatype").isNotNull() & ~F.col("_datatype").eqNullSafe(F.col("datatype")), "node-kind": kind,
        "in": F.col("in_values").isNotNull() & ~F.array_contains("in_values", F.col("o")), "pattern": F.col("pattern").isNotNull() & ~F.expr("o rlike pattern"),
        "min-length": F.col("min_length").isNotNull() & (F.length("o") < F.col("min_length")), "min-inclusive": F.col("min_inclusive").isNotNull() & ~F.coalesce(least, F.lit(False)),
    }
    codes = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in checks.items())))  # one pass over the values
    itself = wanted.filter("path is null").withColumn("o", F.col("s")).select("s", "shape", "path", "o", "class")
    typed = have.select("s", "shape", "path", "o", "class").unionByName(itself).filter(F.col("class").isNotNull())
    untyped = typed.join(classes.select(F.col("s").alias("o"), F.col("_class").alias("class")).distinct(), ["o", "class"], "left_anti")
    return _all(fault(counts, F.explode(number)), fault(have, F.explode(codes)), fault(untyped, F.lit("class")))


def check_declared_terms(triples: DataFrame, schema: DataFrame, namespace: str, class_property: str = "rdf:type") -> DataFrame:
    """Predicates and classes of our namespace that ``schema(term)`` does not declare."""
    predicates = triples.select(F.col("p").alias("term"), F.lit("undeclared-predicate").alias("code"))
    classes = triples.filter(F.col("p") == class_property).select(F.col("o").alias("term"), F.lit("undeclared-class").alias("code"))
    used = predicates.union(classes).filter(F.startswith("term", F.lit(namespace))).distinct()
    return violations(used.join(schema.select("term"), "term", "left_anti"), F.col("code"), "term")


def check_public_iris(triples: DataFrame, reference_predicates: list[str]) -> DataFrame:
    """Entity numbers in the place of IRIs, and reference values that are no absolute IRI."""
    iri = triples.filter("o_kind = 'iri'")
    bare = violations(iri.filter(is_bare_id("o")), "bare-id", "s", F.col("o"))
    subjects = violations(triples.filter(is_bare_id("s")).select("s").distinct(), "bare-id", "s")
    loose = violations(triples.filter(F.col("p").isin(*reference_predicates) & (~is_absolute_iri("o") | (F.col("o_kind") != "iri")) & ~is_bare_id("o")), "not-absolute", "s", F.col("o"))
    return _all(bare, subjects, loose)


def check_item_iris(items: DataFrame, fields: list[str]) -> DataFrame:
    """G3 for items: fields that must hold absolute IRIs."""
    return _all(*(violations(items.filter(F.col(f).isNotNull() & ~is_absolute_iri(f)), "not-absolute", "qid", f) for f in fields))


def check_identities(items: DataFrame) -> DataFrame:
    """Missing and repeated ids of a dataset."""
    named = items.withColumn("_qid", qid("wikidataId"))
    missing = violations(named.filter("_qid is null"), "missing-identity", F.coalesce("title", F.lit("")))
    repeated = named.filter("_qid is not null").groupBy("dataset", "_qid").count().filter("count > 1")
    return missing.unionByName(violations(repeated, "duplicate-identity", "_qid", F.col("count")))


def check_controlled_values(triples: DataFrame, vocab: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Values of a predicate that are not in its scheme (predicate to scheme)."""
    scheme = F.create_map(*[F.lit(x) for pair in predicates.items() for x in pair])
    used = triples.filter(F.col("p").isin(*predicates)).select("s", "p", F.col("o").alias("iri"), scheme[F.col("p")].alias("scheme"))
    return violations(used.join(vocab.select("iri", "scheme"), ["iri", "scheme"], "left_anti"), "outside-scheme", "s", F.col("iri"))


def check_dimension(vocab: DataFrame) -> DataFrame:
    """Iris, labels and slugs that are not unique in their scheme."""
    return _all(*(violations(vocab.groupBy("scheme", c).count().filter("count > 1"), f"duplicate-{c}", c, F.col("scheme")) for c in ("iri", "label", "slug")))


def check_assignments(assignments: DataFrame, vocab: DataFrame) -> DataFrame:
    """Several concepts for an id, and concepts that the vocabulary does not have."""
    several = assignments.groupBy("dataset", "qid").agg(F.count_distinct("concept_iri").alias("n")).filter("n > 1")
    unknown = assignments.join(vocab.select(F.col("iri").alias("concept_iri")), "concept_iri", "left_anti")
    return violations(several, "several-concepts", "qid", F.col("n")).unionByName(violations(unknown, "unknown-concept", "qid", F.col("concept_iri")))


def check_policy(decisions: DataFrame) -> DataFrame:
    """``qid, kind exclusion|exception, evidence``: repeated decisions, decisions without evidence, ids that are both."""
    repeated = decisions.groupBy("qid", "kind").count().filter("count > 1")
    both = decisions.groupBy("qid").agg(F.count_distinct("kind").alias("n")).filter("n > 1")
    return _all(violations(repeated, "repeated-decision", "qid", F.col("kind")), violations(decisions.filter(present("evidence").isNull()), "no-evidence", "qid"), violations(both, "excluded-and-excepted", "qid"))


def _row_hash(df: DataFrame, keys: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}), 256)


def check_projection_parity(projected: DataFrame, items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items that the projection of the triples lacks, adds or changes."""
    keys = keys or ["dataset", "qid"]
    a, b = (df.select(*keys, _row_hash(df, keys).alias(n)) for df, n in ((projected, "_a"), (items, "_b")))
    both = a.join(b, keys, "full")
    code = F.when(F.col("_a").isNull(), "extra-item").when(F.col("_b").isNull(), "missing-item").when(F.col("_a") != F.col("_b"), "changed-item")
    return violations(both.withColumn("_code", code).filter("_code is not null"), F.col("_code"), keys[-1])


def check_registry(registry: DataFrame, baseline: DataFrame, items: DataFrame, base: str) -> DataFrame:
    """Slugs that collide, items that are not registered or whose page differs from the registry, reservations that were removed or changed."""
    collide = registry.groupBy("dataset", "slug").agg(F.count_distinct("qid").alias("n")).filter("n > 1")
    joined = items.select("dataset", qid("wikidataId").alias("qid"), "canonicalUrl").join(registry, ["dataset", "qid"], "left")
    wrong = joined.filter(F.col("slug").isNotNull() & ~F.col("canonicalUrl").eqNullSafe(page_iri(base, "dataset", "slug")))
    old = baseline.select("dataset", "qid", F.col("slug").alias("_old")).join(registry, ["dataset", "qid"], "left")
    return _all(
        violations(collide, "slug-collision", "slug", F.col("n")), violations(joined.filter("slug is null"), "unregistered", "qid"), violations(wrong, "uri-differs", "qid", F.col("canonicalUrl")),
        violations(old.filter("slug is null"), "reservation-removed", "qid", F.col("_old")), violations(old.filter("slug is not null and slug <> _old"), "reservation-changed", "qid", F.col("_old")),
    )


def field_coverage(items: DataFrame, fields: list[str], by: str = "dataset") -> DataFrame:
    """``dataset, field, coverage``: the share of items with a text that is not blank, a list that is not empty, or any other value."""
    def filled(c: str) -> Column:
        kind = items.schema[c].dataType.typeName()
        there = F.size(c) > 0 if kind == "array" else present(c).isNotNull() if kind == "string" else F.col(c).isNotNull()
        return F.avg(F.when(there, 1.0).otherwise(0.0)).alias(c)

    wide = items.groupBy(by).agg(*map(filled, fields))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("coverage")) for c in fields))
    return wide.select(by, F.explode(pairs).alias("f")).select(by, "f.field", "f.coverage")


def identity_diff(current: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ids with their state: lost, added, surviving."""
    keys = keys or ["dataset", "qid"]
    both = current.select(*keys).distinct().withColumn("_now", F.lit(True)).join(baseline.select(*keys).distinct().withColumn("_then", F.lit(True)), keys, "full")
    return both.select(*keys, F.when(F.col("_now").isNull(), "lost").when(F.col("_then").isNull(), "added").otherwise("surviving").alias("state"))


def check_regressions(current: DataFrame, baseline: DataFrame, fields: list[str]) -> DataFrame:
    """Losses (additions do not make up for them), changed urls of survivors, low homepage coverage, fields that fell."""
    states = identity_diff(current, baseline).groupBy("dataset").agg(F.count_if(F.col("state") == "lost").alias("lost"), F.count_if(F.col("state") != "added").alias("before"))
    ratio = F.try_divide("lost", "before")
    known = states.filter("before > 0")
    loss = violations(known.filter(ratio > LOSS_ERROR), "record-loss", "dataset", F.col("lost"))
    warn = violations(known.filter((ratio > LOSS_WARNING) & (ratio <= LOSS_ERROR)), "record-loss", "dataset", F.col("lost"), "warning")
    empty = violations(states.filter("before = 0"), "baseline-empty", "dataset")
    old = baseline.select("dataset", "qid", F.col("canonicalUrl").alias("_old"))
    moved = violations(current.join(old, ["dataset", "qid"]).filter(~F.col("_old").eqNullSafe(F.col("canonicalUrl"))), "uri-stability", "qid", F.col("canonicalUrl"))
    now = field_coverage(current, sorted({*fields, "homepage"}))
    low = violations(now.filter((F.col("field") == "homepage") & (F.col("coverage") < HOMEPAGE_WARNING)), "homepage-coverage", "field", "", "warning")
    then = field_coverage(baseline, fields).withColumnRenamed("coverage", "_then")
    fell = violations(now.join(then, ["dataset", "field"]).filter(F.col("_then") - F.col("coverage") > FIELD_DROP_WARNING), "metadata-coverage", "field", "", "warning")
    return _all(loss, warn, empty, moved, low, fell)


def check_known_records(items: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``fixtures(dataset, qid, field, expected)``: pinned values that differ or whose record is gone."""
    fields = [r.field for r in fixtures.select("field").distinct().collect() if r.field in items.columns]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("actual")) for f in fields))
    long = items.select("dataset", "qid", F.explode(pairs).alias("f")).select("dataset", "qid", "f.field", "f.actual")
    ids = items.select("dataset", "qid", F.lit(True).alias("_there")).distinct()
    joined = fixtures.join(ids, ["dataset", "qid"], "left").join(long, ["dataset", "qid", "field"], "left")
    code = F.when(F.col("_there").isNull(), "known-record-missing").when(~F.col("actual").eqNullSafe(F.col("expected")), "known-value-differs")
    return violations(joined.withColumn("_code", code).filter("_code is not null"), F.col("_code"), "qid", F.col("field"))


MENTIONS = "array<map<string,string>>"


def check_page_contracts(pages: DataFrame, items: DataFrame, sitemap: DataFrame, baseline: DataFrame, base: str) -> DataFrame:
    """Pages (``dataset, slug, html``) against records, urls, the site map, their links and mentions; lost pages of surviving records warn.

    A page mentions the record's related links that have a page and a title, in their order, and has no list of mentions without any.
    """
    data = F.regexp_extract("html", r'(?s)<script type="application/ld\+json">(.*?)</script>', 1)
    read = pages.select("dataset", page_iri(base, "dataset", "slug").alias("url"), data.alias("_data"))
    said = F.get_json_object("_data", "$.mentions")
    # Each mention as its sorted entries, so that an additional one is a difference.
    listed_mentions = F.transform(F.from_json(said, MENTIONS), lambda m: F.array_sort(F.map_entries(m)))
    # Pages are read once: all checks below need only these columns.
    named = written(read.select("dataset", "url", F.get_json_object("_data", "$['@id']").alias("_id"), said.isNotNull().alias("_said"), listed_mentions.alias("_mentions")), "pages")
    urls = named.select("url")
    records = items.select("dataset", "qid", F.col("canonicalUrl").alias("url"))
    no_record = violations(named.join(records.select("url"), "url", "left_anti"), "page-without-record", "url")
    no_data = violations(named.filter(~F.col("_id").eqNullSafe(F.col("url"))), "page-data-differs", "url", F.coalesce("_id", F.lit("")))
    not_listed = violations(named.join(sitemap.select("url"), "url", "left_anti"), "page-not-in-sitemap", "url")
    listed = sitemap.filter(F.col("url").rlike("/(resource|software)/[^/]+/$")).join(urls, "url", "left_anti")
    with_page = items.select("dataset", F.col("canonicalUrl").alias("url"), "relatedTools").join(urls, "url", "left_semi")
    links = with_page.select("dataset", "url", F.posexplode("relatedTools").alias("_pos", "_tool")).select("dataset", "url", "_pos", F.col("_tool.canonicalUrl").alias("_to"), F.col("_tool.title").alias("_title"))
    targets = urls.distinct().select(F.col("url").alias("_to"), F.lit(True).alias("_there"))
    met_links = written(links.join(targets, "_to", "left"), "links")
    dead = violations(met_links.filter("_there is null"), "related-without-page", "url", F.col("_to"))
    pairs = {"@id": F.col("_to"), "@type": page_type(base, "_to"), "name": F.col("_title")}
    entry = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()))
    wanted = met_links.filter(F.col("_there") & filled("_title")).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("_pos", entry.alias("e")))).alias("_wanted"))
    met = named.select("dataset", "url", "_said", "_mentions").join(wanted, "url", "left").withColumn("_wanted", F.transform("_wanted", lambda w: w["e"]))
    kind = met.schema["_mentions"].dataType
    differs = F.when(F.col("_wanted").isNull(), F.col("_said")).otherwise(~F.col("_mentions").eqNullSafe(F.col("_wanted").cast(kind)))
    mentions = violations(met.filter(differs), "page-mentions-differ", "url")
    lost = baseline.select("dataset", "qid").join(records, ["dataset", "qid"]).join(urls, "url", "left_anti")
    return _all(no_record, no_data, not_listed, violations(listed, "sitemap-without-page", "url"), dead, mentions, violations(lost, "page-lost", "qid", "", "warning"))


EPSILON = 1e-12


def coverage_gate(candidate: DataFrame, baseline: DataFrame, policy: dict, baseline_id: str) -> DataFrame:
    """``dataset, coverage``: below the floor, or fallen by more than the limit, unless reviewed for this baseline and catalog.

    ``policy``: maximumEmptyShare, maximumUnreviewedCoverageDecline, acceptedDeclines and acceptedShortfalls (lists of dicts).
    """
    usable = lambda k: [e for e in policy.get(k, []) if str(e.get("rationale", "")).strip() and e.get("baselineGenerationId") == baseline_id]
    declines = [e["catalog"] for e in usable("acceptedDeclines")]
    floors = {e["catalog"]: float(e["minimumCoverageShare"]) for e in usable("acceptedShortfalls")}
    normal = 1.0 - policy["maximumEmptyShare"]
    reviewed = F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])[F.col("dataset")] if floors else F.lit(None).cast("double")
    floor = F.when(F.col("coverage") < normal, F.coalesce(reviewed, F.lit(normal))).otherwise(F.lit(normal))
    low = violations(candidate.filter(F.col("coverage") + EPSILON < floor), "coverage-floor", "dataset", F.col("coverage"))
    both = candidate.join(baseline.select("dataset", F.col("coverage").alias("_then")), "dataset")
    fell = both.filter((F.col("_then") - F.col("coverage") > policy["maximumUnreviewedCoverageDecline"] + EPSILON) & ~F.col("dataset").isin(declines))
    return low.unionByName(violations(fell, "coverage-decline", "dataset", F.round(F.col("_then") - F.col("coverage"), 6)))


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each group, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
