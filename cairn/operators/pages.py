"""Page membership: content filter, link health, survivors, linked data, site map, recommendation coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, page_type, present, qid, slug_from_url, trimmed

# Descriptions that say nothing, and phrases of parked and missing pages.
GENERIC = (
    "ontology", "wikimedia glossary list article", "wikimedia list article", "ontology part of obofoundry", "glossary", "controlled vocabulary", "taxonomy",
    "vocabulary", "thesaurus", "classification scheme", "terminology", "nomenclature",
)
PARKED = ("buy this domain", "domain for sale", "this domain is for sale", "domain parking", "parked domain", "sedoparking", "hugedomains")
MISSING = ("page not found", "404 not found", "not found</", "page doesn't exist", "page does not exist", "this page has been removed", "the page has been removed", "error 404")
DATASETS = ("resource", "software")


def content_filter(items: DataFrame) -> DataFrame:
    """A title that is no entity number, a description that says something, and a homepage."""
    description = F.lower(trimmed(F.coalesce("description", F.lit(""))))
    fits = filled("title") & ~F.startswith(trimmed("title"), F.lit("Q")) & (F.length(description) >= 15) & ~description.isin(*GENERIC)
    return items.filter(fits & filled("homepage"))


def link_is_healthy(status: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    says = lambda phrases: reduce(lambda a, p: a | low.contains(p), phrases, F.lit(False))
    ok = F.when(status == 403, True).when(status >= 400, False).when(F.length(low) < 100, False).when(says(PARKED), False).when(says(MISSING) & (F.length(low) < 50_000), False)
    return F.coalesce(ok.otherwise(status.isNotNull()), F.lit(False))


def classify_link_health(crawl: DataFrame) -> DataFrame:
    """``url, healthy`` of a crawl ``url, status, body``; one good answer for a url is enough."""
    return crawl.groupBy(trimmed("url").alias("url")).agg(F.bool_or(link_is_healthy(F.col("status"), F.col("body"))).alias("healthy"))


def split_membership(candidates: DataFrame, baseline: DataFrame, base: str) -> DataFrame:
    """Adds ``unchanged``: the same homepage and slug as in the baseline (``dataset, qid, homepage, slug``)."""
    named = candidates.withColumns({"qid": qid("wikidataId"), "slug": slug_from_url(base, "canonicalUrl", "dataset")})
    old = baseline.select("dataset", "qid", F.col("homepage").alias("_homepage"), F.col("slug").alias("_slug"))
    joined = named.join(old, ["dataset", "qid"], "left")
    same = F.col("_homepage").isNotNull() & F.col("_homepage").eqNullSafe(trimmed("homepage")) & F.col("_slug").eqNullSafe(F.col("slug"))
    return joined.withColumn("unchanged", same).drop("_homepage", "_slug")


def load_membership(registry: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``dataset, qid, homepage, slug`` of registered pages, and violations where the record or its homepage is missing."""
    own = items.select("dataset", qid("wikidataId").alias("qid"), F.coalesce(present("homepage"), F.lit("")).alias("homepage"))
    joined = registry.join(own, ["dataset", "qid"], "left")
    code = F.when(F.col("homepage").isNull(), "record-missing").when(F.col("homepage") == "", "homepage-missing")
    bad = joined.select(code.alias("code"), F.lit("error").alias("severity"), "dataset", F.col("qid").alias("subject")).filter("code is not null")
    return joined.filter("homepage <> ''").select("dataset", "qid", "homepage", "slug"), bad


def page_survivors(candidates: DataFrame, health: DataFrame | None, base: str, with_baseline: bool = False) -> DataFrame:
    """Candidates with an id and a slug whose link is good; against a baseline, unchanged ones need no check.

    Without ``health`` nothing was checked: all pass, or with a baseline only the unchanged ones.
    """
    named = candidates.withColumns({"qid": qid("wikidataId"), "slug": slug_from_url(base, "canonicalUrl", "dataset")}).filter("qid is not null and slug is not null")
    unchanged = F.col("unchanged") if with_baseline else F.lit(False)
    if health is None:
        return named.filter(unchanged) if with_baseline else named
    good = health.filter("healthy").select(F.col("url").alias("_url"))
    return named.join(good.distinct(), trimmed(named["homepage"]) == F.col("_url"), "left").filter(unchanged | F.col("_url").isNotNull()).drop("_url")


def prune_related(items: DataFrame, survivors: DataFrame) -> DataFrame:
    """Related links without a page are dropped; the rest keep their order."""
    urls = survivors.select(F.col("canonicalUrl").alias("_url")).filter("_url is not null").distinct()
    long = items.select("dataset", "qid", F.posexplode("relatedTools").alias("pos", "link"))
    kept = long.join(urls, F.col("link.canonicalUrl") == F.col("_url"), "left_semi")
    lists = kept.groupBy("dataset", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("_links"))
    joined = items.join(lists, ["dataset", "qid"], "left")
    empty = F.array().cast(items.schema["relatedTools"].dataType)
    return joined.withColumn("relatedTools", F.coalesce("_links", empty)).drop("_links")


def recommendation_coverage(survivors: DataFrame) -> DataFrame:
    """A10: a row for each dataset, also for an empty one: pages, pages with a surviving link, distinct links, shares."""
    urls = survivors.select(F.col("canonicalUrl").alias("_url")).filter("_url is not null").distinct()
    links = survivors.select("dataset", "qid", F.explode("relatedTools.canonicalUrl").alias("_url")).distinct().join(urls, "_url", "left_semi")
    linked = links.groupBy("dataset", "qid").count().groupBy("dataset").agg(F.count("*").alias("with_links"), F.sum("count").alias("links"))
    sizes = survivors.groupBy("dataset").agg(F.count("*").alias("pages"))
    both = survivors.sparkSession.createDataFrame([(d,) for d in DATASETS], "dataset string").join(sizes, "dataset", "left").join(linked, "dataset", "left").na.fill(0)
    share = F.when(F.col("pages") > 0, F.round(F.try_divide("with_links", "pages"), 6)).otherwise(F.lit(0.0))
    return both.select("dataset", "pages", "with_links", "links", share.alias("coverage"), F.round(1 - F.when(F.col("pages") > 0, F.try_divide("with_links", "pages")).otherwise(F.lit(0.0)), 6).alias("empty_share"))


def reasons_by_catalog(survivors: DataFrame, relationships: DataFrame) -> DataFrame:
    """``dataset, reason, count`` of relationships (``dataset, subject, candidate, reasons``) whose two ends have pages."""
    urls = survivors.select(F.col("canonicalUrl").alias("_url")).distinct()
    own = relationships.join(urls, F.col("subject") == F.col("_url"), "left_semi").join(urls, F.col("candidate") == F.col("_url"), "left_semi")
    return own.select("dataset", F.explode("reasons").alias("reason")).groupBy("dataset", "reason").count()


def _filled(value: Column) -> Column:
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))


def _json(value: Column) -> Column:
    """A JSON string literal of a text that is not null."""
    return F.btrim(F.to_json(F.array(value)), F.lit("[]"))


def _members(**texts: Column) -> Column:
    """The members of a JSON object of texts, without its braces; nulls are left out.  Its ends are braces and quotes, so no brace of a text is taken for its own."""
    return F.btrim(F.to_json(F.struct(*(v.cast("string").alias(k) for k, v in texts.items())), {"ignoreNullFields": "true"}), F.lit("{}"))


def _one_or_all(values: Column) -> Column:
    return F.when(F.size(values) == 1, _json(values[0])).when(F.size(values) > 1, F.to_json(values))


def project_json_ld(items: DataFrame, base: str, catalog_name: str) -> tuple[DataFrame, DataFrame]:
    """``dataset, qid, json_ld``, and violations of items that lack a required field.  Optional fields are left out; lists of one are bare.

    Neighbouring texts become members in one call, and lists are cleaned once, in columns of their own.
    """
    required = ("canonicalUrl", "title", "description", "homepage", "wikidataId")
    missing = F.concat_ws(", ", *(F.when(~F.coalesce(filled(c), F.lit(False)), F.lit(c)) for c in required))
    named = items.withColumn("_missing", missing)
    bad = named.filter("_missing <> ''").select(F.lit("json-ld-identity").alias("code"), F.lit("error").alias("severity"), "dataset", F.col("qid").alias("subject"), F.col("_missing").alias("message"))
    text = lambda c: F.when(filled(c), F.col(c).cast("string"))
    pair = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v))
    said = lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""
    all_of = lambda c: F.coalesce(c, F.array().cast(items.schema[c].dataType))
    person = lambda c: F.struct(c["type"].alias("type"), c["name"].alias("name"), _filled(F.array(c["wikidataId"], c["githubProfile"], c["googleScholarProfile"])).alias("same"))
    entry = lambda p: F.concat(F.lit("{"), F.concat_ws(",", _members(**{"@type": p["type"], "name": p["name"]}), pair("sameAs", _one_or_all(p["same"]))), F.lit("}"))
    mention = lambda r: F.struct(page_type(base, r["canonicalUrl"]).alias("@type"), r["canonicalUrl"].alias("@id"), r["title"].alias("name"))
    lists = {
        "_aliases": _filled(F.col("aliases")), "_languages": _filled(F.col("programmingLanguages")), "_license": F.get(_filled(F.col("licenses")), F.lit(0)),
        "_creators": F.transform(F.transform(F.filter(all_of("creators"), lambda c: said(c["type"]) & said(c["name"])), person), entry),
        "_mentions": F.filter(F.transform(F.filter(all_of("relatedTools"), lambda r: said(r["title"])), mention), lambda m: m["@type"].isNotNull()),
    }
    kind = F.when(F.col("dataset") == "software", "SoftwareApplication").otherwise("DefinedTermSet")
    identity = {"@context": F.lit("https://schema.org"), "@type": kind, "@id": F.col("canonicalUrl"), "name": F.col("title"), "description": F.col("description"), "url": F.col("homepage"), "sameAs": F.col("wikidataId")}
    details = _members(softwareVersion=text("latestVersion"), datePublished=text("releaseDate"), codeRepository=text("sourceRepo"), applicationCategory=text("softwareType"))
    some = F.when(F.size("_creators") == 1, F.col("_creators")[0]).when(F.size("_creators") > 1, F.concat(F.lit("["), F.array_join("_creators", ","), F.lit("]")))
    whole = (
        _members(**identity), pair("alternateName", _one_or_all(F.col("_aliases"))), pair("license", F.when(F.col("_license").isNotNull(), _json(F.col("_license")))),
        F.concat(F.lit('"isPartOf":{'), _members(**{"@type": F.lit("DataCatalog"), "name": F.lit(catalog_name), "url": F.lit(base)}), F.lit("}")), F.nullif(details, F.lit("")),
        pair("programmingLanguage", _one_or_all(F.col("_languages"))), pair("creator", some), pair("mentions", F.when(F.size("_mentions") > 0, F.to_json("_mentions"))),
    )
    return named.filter("_missing = ''").withColumns(lists).select("dataset", "qid", F.concat(F.lit("{"), F.concat_ws(",", *whole), F.lit("}")).alias("json_ld")), bad


def sitemap_entries(pages: DataFrame, base: str, fixed: list[tuple[str, str, float]]) -> DataFrame:
    """``url, changefreq, priority`` of pages (``dataset, slug``) and of a few fixed places (path, frequency, priority)."""
    own = pages.select(F.concat(F.lit(base + "/"), "dataset", F.lit("/"), "slug", F.lit("/")).alias("url"), F.lit("weekly").alias("changefreq"), F.lit(0.6).alias("priority"))
    few = pages.sparkSession.createDataFrame([(base + p, f, float(w)) for p, f, w in fixed], "url string, changefreq string, priority double")
    return few.unionByName(own)
