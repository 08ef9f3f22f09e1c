"""Records as triples and triples as nested items.  ``triples(s, p, o, o_kind, datatype, lang)`` is a set; kinds: iri, bnode, literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
COLUMNS = ("s", "p", "o", "o_kind", "datatype", "lang")


def _one(p: str, o: Column, kind: str, datatype: str | None = None, lang: str | None = None) -> Column:
    fields = F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"))
    return F.array(F.when(o.isNotNull() & (o.cast("string") != ""), fields))


def _many(p: str, values: Column, kind: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(p).alias("p"), v.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")))


def _flat(rows: DataFrame, subject: Column, parts: list[Column]) -> DataFrame:
    flat = F.array_compact(F.concat(*parts))
    return rows.select(subject.alias("s"), F.explode(flat).alias("t")).select("s", "t.*").filter("o is not null")


def _exploded(rows: DataFrame, subject: Column, parts: list[Column]) -> DataFrame:
    return _flat(rows, subject, parts).distinct()


LITERALS = {"title": ("title", None, "en"), "description": ("description", None, "en"), "latestVersion": ("latestVersion", None, None), "releaseDate": ("releaseDate", XSD + "date", None)}
IRIS = {"wikidataId": "wikidataId", "homepage": "homepage", "sourceRepo": "sourceRepo", "namespaceURI": "namespaceURI", "category": "category", "softwareType": "softwareType", "partOf": "partOf"}
IRI_LISTS = {"types": "type", "licenses": "license", "creators": "creator", "parents": "isPartOf", "source_types": "sourceType", "uses": "uses"}
LITERAL_LISTS = {"programmingLanguages": "programmingLanguage", "aliases": "alias"}
NODES = {"label": ("label", "literal"), "kind": ("rdf:type", "iri"), "licenseName": ("licenseName", "literal"), "wikidataId": ("wikidataId", "iri"), "githubProfile": ("githubProfile", "iri"), "googleScholarProfile": ("googleScholarProfile", "iri")}


def records_to_triples(records: DataFrame) -> DataFrame:
    """Every present field of a record (``subject`` and the columns above) as typed triples, its title as its label too, and the fields (``NODES``) of each node that lists ``nodes(iri, ...)``.

    Nodes are the categories, software types, licenses and creators that records refer to; each is made once, whatever number of records names it.
    """
    have = set(records.columns)
    parts = [_one(p, F.col(c), "literal", datatype, lang) for c, (p, datatype, lang) in LITERALS.items() if c in have]
    parts += [_one("label", F.col("title"), "literal")] if "title" in have else []
    parts += [_one(p, F.col(c), "iri") for c, p in IRIS.items() if c in have]
    parts += [_many(p, F.col(c), "iri") for c, p in IRI_LISTS.items() if c in have] + [_many(p, F.col(c), "literal") for c, p in LITERAL_LISTS.items() if c in have]
    out = _flat(records, F.col("subject"), parts)
    if "nodes" not in have:
        return out.distinct()
    nodes = records.select(F.explode("nodes").alias("n")).select("n.*").filter("iri <> ''").distinct()
    return out.unionByName(_flat(nodes, F.col("iri"), [_one(p, F.col(c), kind) for c, (p, kind) in NODES.items() if c in nodes.columns])).distinct()


def node_id(*parts: Column) -> Column:
    """Id of a node without a name, from its content."""
    return F.concat(F.lit("_:n"), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32))


def postings_to_triples(postings: DataFrame, run_id: str, base: str) -> DataFrame:
    """T4: postings, their employers, places, salaries and evidence, and the run that saw them."""
    from ..functions.columns import slugify

    subject, c = F.concat(F.lit(base + "posting-"), F.col("id")), F.col
    employer = F.concat(F.lit(base + "employer-"), slugify("hiringOrganization", "unknown"))
    place, pay = node_id(F.lit("place"), c("location")), node_id(F.lit("salary"), c("baseSalary.currency"), c("baseSalary.minValue"), c("baseSalary.maxValue"), c("baseSalary.unitText"))
    own = [
        _one("rdf:type", F.lit("JobPosting"), "iri"), _one("title", c("title"), "literal"), _one("description", c("description"), "literal"), _one("url", c("canonicalUrl"), "iri"),
        _one("hiringOrganization", employer, "iri"), _one("datePosted", c("datePosted"), "literal", XSD + "date"), _one("validThrough", c("validThrough"), "literal", XSD + "date"),
        _one("remote", c("remote"), "literal", XSD + "boolean"), _one("firstSeenAt", c("firstSeenAt"), "literal", XSD + "dateTime"), _one("active", c("active"), "literal", XSD + "boolean"),
        _one("classification", c("classification"), "literal"), _one("wasGeneratedBy", F.lit(base + "run-" + run_id), "iri"),
        _one("jobLocation", F.when(c("location").isNotNull(), place), "bnode"), _one("baseSalary", F.when(c("baseSalary").isNotNull(), pay), "bnode"), _many("tag", c("tags"), "literal"),
    ]
    parts = [
        _exploded(postings, subject, own),
        _exploded(postings, employer, [_one("rdf:type", F.lit("Employer"), "iri"), _one("name", c("hiringOrganization"), "literal")]),
        _exploded(postings.filter("location is not null"), place, [_one("rdf:type", F.lit("Place"), "iri"), _one("name", c("location"), "literal")]),
        _exploded(postings.filter("baseSalary is not null"), pay, [
            _one("rdf:type", F.lit("MonetaryAmount"), "iri"), _one("currency", c("baseSalary.currency"), "literal"), _one("minValue", c("baseSalary.minValue"), "literal", XSD + "double"),
            _one("maxValue", c("baseSalary.maxValue"), "literal", XSD + "double"), _one("unitText", c("baseSalary.unitText"), "literal"),
        ]),
    ]
    if "evidence" in postings.columns:
        found = postings.select(subject.alias("_s"), F.explode("evidence").alias("e"))
        node = node_id(c("_s"), c("e.concept_uri"), c("e.matched_phrase"), c("e.source_field"), c("e.negated"))
        parts.append(_exploded(found, c("_s"), [_one("evidence", node, "bnode")]))
        parts.append(_exploded(found, node, [
            _one("concept", c("e.concept_uri"), "iri"), _one("matchedPhrase", c("e.matched_phrase"), "literal"), _one("sourceField", c("e.source_field"), "literal"), _one("negated", c("e.negated"), "literal", XSD + "boolean"),
        ]))
    return merge_triples(*parts)


def triples_to_items(triples: DataFrame, type_labels: DataFrame) -> DataFrame:
    """T5: nested items of subjects with a title, an id and a known type (``type, label, dataset``); the smallest of several single values; linked nodes by label."""
    labels = triples.filter("p = 'label'").groupBy("s").agg(F.min("o").alias("_label")).withColumnRenamed("s", "_node")
    single = lambda p, lang=None: F.min(F.when((F.col("p") == p) & (F.lit(True) if lang is None else F.col("lang") == lang), F.col("o")))
    wide = triples.groupBy("s").agg(
        *(single(p, lang).alias(c) for c, (p, _, lang) in LITERALS.items()), *(single(p).alias(c) for c, p in IRIS.items()),
        *(F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(c) for c, p in LITERAL_LISTS.items()),
    )
    linked = triples.filter(F.col("p").isin("license", "creator")).join(labels, F.col("o") == F.col("_node"))
    lists = linked.groupBy("s").agg(*(F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("_label")))).alias(c) for c, p in (("licenses", "license"), ("creators", "creator"))))
    types = triples.filter("p = 'type'").join(F.broadcast(type_labels.withColumnRenamed("type", "_type")), F.col("o") == F.col("_type"))
    typed = types.groupBy("s").agg(F.array_sort(F.collect_set("label")).alias("types"), F.min("dataset").alias("dataset"))
    for c in ("category", "softwareType"):
        named = labels.withColumnsRenamed({"_node": f"_{c}", "_label": f"_{c}_label"})
        wide = wide.join(named, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.col(f"_{c}_label")).drop(f"_{c}", f"_{c}_label")
    joined = wide.filter("title is not null and wikidataId is not null").join(typed, "s").join(lists, "s", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("licenses", "creators")}).withColumnRenamed("s", "canonicalUrl")


def merge_triples(*graphs: DataFrame) -> DataFrame:
    """U4: the set union."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*COLUMNS))
    return out.distinct()
