"""Postings: six feed layouts, age filter, page checks, de-duplication, evidence and classes, run figures."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    NEGATION_WINDOW, NEGATIONS, canonical_url, date_only, finite_bound, lines_digest, present, salary_range, salary_text, slugify, sorted_strings, spaced, unix_date,
)
from ..functions.html import closed_html_text, html_text
from ..functions.unicode import casefolded, identity_form
from ..session import bounded, written
from .ordered import chain_ends, previous_of_key

FIELDS = ("title", "description", "qualifications", "responsibilities")

POSTING = (
    "id string, sourceRecordId string, canonicalUrl string, sourceName string, sourceUrl string, sourceDataset string, title string, description string, "
    "hiringOrganization string, remote boolean, canonicalFingerprint string, firstSeenAt timestamp, lastSeenAt timestamp, retrievedAt timestamp, active boolean, "
    "discoveredBy array<string>, location string, applicantLocationRequirements array<string>, datePosted date, validThrough date, employmentType string, "
    "seniority string, tags array<string>, category string, salary string, baseSalary struct<currency:string,minValue:double,maxValue:double,unitText:string>"
)


def posting_schema() -> T.StructType:
    return T.StructType.fromDDL(POSTING)


def extract_text(pages: DataFrame, html: str = "body", bare: bool = True) -> DataFrame:
    """Adds ``text``; references without their semicolon are decoded as in HTML, or stay as they are unless ``bare``."""
    return pages.withColumn("text", (html_text if bare else closed_html_text)(html))


# ---- feeds


def _joined(values: Column) -> Column:
    return F.nullif(F.array_join(sorted_strings(F.transform(values, html_plain)), ", "), F.lit(""))


def html_plain(value: Column) -> Column:
    """Text of short list entries without a UDF: tags and the common references only."""
    text = F.regexp_replace(F.regexp_replace(value, r"(?i)</?(br|div|h[1-4]|li|p|tr)\b[^>]*>", " "), r"</?[A-Za-z][^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return spaced(text)


def _list(values: Column) -> Column:
    found = sorted_strings(F.transform(values, html_plain))
    return F.when(F.size(found) > 0, found)


def _true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes"), F.lit(False))


def _posting(rows: DataFrame, source: dict, at: Column, url: Column, record_id: Column, columns: dict[str, Column], discovered: Column) -> DataFrame:
    """One row of the posting schema, and ``rejected`` with the reason where a required field is missing."""
    named = rows.withColumns({"_title": html_text(columns.pop("title")), "_text": html_text(columns.pop("description")), "_org": html_text(columns.pop("organization")), "_url": url, "_rid": present(record_id)})
    digest = F.sha2("_url", 256)
    known = {
        "sourceRecordId": F.col("_rid"), "canonicalUrl": F.col("_url"), "sourceName": F.lit(source["name"]), "sourceUrl": F.col("_url"), "sourceDataset": F.lit(source["dataset"]),
        "title": F.col("_title"), "description": F.col("_text"), "hiringOrganization": F.col("_org"), "canonicalFingerprint": digest, "firstSeenAt": at, "lastSeenAt": at,
        "retrievedAt": at, "active": F.lit(True), "discoveredBy": F.array(discovered), "id": F.concat(F.lit(source["key"] + "-"), F.col("_rid")),
    }
    known |= columns
    out = [known[f.name].cast(f.dataType).alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in posting_schema().fields]
    missing = [F.when(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(None)).isNull(), F.lit(n)) for c, n in (("_title", "title"), ("_text", "description"), ("_org", "employer"), ("_rid", "id"), ("_url", "url"))]
    return named.select(*out, F.nullif(F.concat_ws(",", *missing), F.lit("")).alias("rejected"))


def normalize_feed(rows: DataFrame, layout: str, source: dict, at: Column) -> DataFrame:
    """Postings of one feed layout, ``a`` to ``f``; ``source``: key, name, dataset, query, and host where its links are bound to one.

    Rows that lack a required field come back with ``rejected`` set, for a quarantine; ``at`` is the time of retrieval.
    """
    c, host = F.col, source.get("host")
    query = c("query") if "query" in rows.columns else F.lit(source.get("query"))
    if layout == "a":
        low, high = finite_bound("minSalary"), finite_bound("maxSalary")
        link = canonical_url("applicationLink", host)
        url = F.when(canonical_url("guid", host) == link, link)
        places = _list(c("locationRestrictions"))
        columns = {
            "title": c("title"), "description": F.coalesce(F.nullif("description", F.lit("")), "excerpt"), "organization": c("companyName"), "remote": F.lit(True),
            "id": F.concat(F.lit(source["key"] + "-"), F.substring(F.sha2(link, 256), 1, 16)), "applicantLocationRequirements": places, "location": F.array_join(places, ", "),
            "datePosted": unix_date("pubDate"), "validThrough": unix_date("expiryDate"), "employmentType": html_plain(c("employmentType")), "tags": _list(c("categories")),
            "seniority": _joined(c("seniority")), "salary": salary_text(html_plain(c("currency")), low, high, html_plain(c("salaryPeriod"))),
            "baseSalary": salary_range(html_plain(c("currency")), low, high, html_plain(c("salaryPeriod"))),
        }
        return _posting(rows, source, at, url, c("guid"), columns, query)
    if layout == "b":
        columns = {
            "title": c("title"), "description": c("description"), "organization": c("company_name"), "remote": F.lit(True), "location": F.nullif(html_plain(c("candidate_required_location")), F.lit("")),
            "datePosted": date_only("publication_date"), "employmentType": F.nullif(html_plain(c("job_type")), F.lit("")), "category": F.nullif(html_plain(c("category")), F.lit("")),
            "tags": _list(c("tags")), "salary": F.nullif(html_plain(c("salary")), F.lit("")),
        }
        return _posting(rows, source, at, canonical_url("url", host), c("id").cast("string"), columns, query)
    if layout == "c":
        created = F.when(c("created_at").rlike(r"^\d{9,12}$"), unix_date(c("created_at").try_cast("double"))).otherwise(date_only("created_at"))
        columns = {
            "title": c("title"), "description": c("description"), "organization": c("company_name"), "remote": _true(c("remote").cast("string")), "location": F.nullif(html_plain(c("location")), F.lit("")),
            "datePosted": created, "employmentType": _joined(c("job_types")), "tags": _list(c("tags")), "salary": F.nullif(html_plain(c("salary")), F.lit("")),
        }
        return _posting(rows, source, at, canonical_url("url"), c("slug"), columns, query)
    if layout == "d":
        place = F.trim(F.regexp_replace(html_plain(c("jobGeo")), r"\s*,\s*", ", "), F.lit(", "))
        columns = {
            "title": c("jobTitle"), "description": F.coalesce(F.nullif("jobDescription", F.lit("")), "jobExcerpt"), "organization": c("companyName"), "remote": F.lit(True),
            "location": F.nullif(place, F.lit("")), "datePosted": date_only("pubDate"), "employmentType": _joined(c("jobType")), "tags": _list(c("jobIndustry")),
        }
        return _posting(rows, source, at, canonical_url("url", host), c("id").cast("string"), columns, query)
    if layout == "e":
        place = html_plain(c("location"))
        columns = {
            "title": c("title"), "description": c("snippet"), "organization": c("company"), "remote": F.when(F.lower(place) == "remote", F.lit(True)), "location": F.nullif(place, F.lit("")),
            "datePosted": date_only("updated"), "employmentType": F.nullif(html_plain(c("type")), F.lit("")), "salary": F.nullif(html_plain(c("salary")), F.lit("")),
        }
        return _posting(rows, source, at, canonical_url("link", host), c("id").cast("string"), columns, query)
    if layout == "f":
        positive = lambda v: F.when(v.cast("double") > 0, v.cast("double"))
        low, high = positive(c("salary_min")), positive(c("salary_max"))
        bounds = F.array_join(F.array_compact(F.array(F.format_number(low, 0), F.format_number(high, 0))), "–")
        some = low.isNotNull() | high.isNotNull()
        words = [F.nullif(F.initcap(F.replace(html_plain(c(x)), F.lit("_"), F.lit(" "))), F.lit("")) for x in ("contract_type", "contract_time")]
        label = F.nullif(html_plain(c("category.label")), F.lit(""))
        columns = {
            "title": c("title"), "description": c("description"), "organization": c("company.display_name"), "location": F.nullif(html_plain(c("location.display_name")), F.lit("")),
            "datePosted": date_only("created"), "employmentType": F.nullif(F.concat_ws(", ", *words), F.lit("")), "tags": F.when(label.isNotNull(), F.array(label)),
            "salary": F.when(some, F.concat(F.lit("USD "), bounds)), "baseSalary": salary_range(F.lit("USD"), low, high, F.lit(None).cast("string")),
        }
        return _posting(rows, source, at, canonical_url("redirect_url"), c("id").cast("string"), columns, query)
    raise ValueError(f"no such layout: {layout}")


def filter_posting_age(postings: DataFrame, max_days: int | None, hosted: str) -> DataFrame:
    """Without those whose link tells an age above ``max_days`` (unknown ages stay) and those whose link is not a hosted page (pattern)."""
    link = F.coalesce(F.col("link"), F.lit(""))
    age = F.regexp_extract(link, r"[?&]jobAge=(\d+)\b", 1).try_cast("bigint")
    kept = postings.filter(link.rlike(hosted))
    return kept if max_days is None else kept.filter(age.isNull() | (age <= max_days))


def validate_feed_pages(pages: DataFrame, rule: str, page_size: int = 0, limit: int = 0) -> DataFrame:
    """Adds ``error`` (null if the page is sound) and ``complete`` to ``request_no, current_page, returned, total, has_next, last_page``.

    Rules: ``total`` (all returned), ``next`` (numbered pages with stable totals, ends without a next page), ``short`` (less than a page).
    """
    before = F.lag("total").over(Window.partitionBy("source").orderBy("request_no"))
    error = F.when(F.col("returned").isNull(), "no array of postings")
    if rule == "total":
        error = error.when(F.col("total").isNull() | (F.col("total") < F.col("returned")), "invalid total")
        complete = (F.col("total") == F.col("returned")) & (F.lit(limit) >= F.col("returned"))
    elif rule == "next":
        error = error.when(F.col("current_page").isNull() | (F.col("current_page") < 1), "invalid page number")
        error = error.when(F.col("current_page") != F.col("request_no"), "not the page asked for")
        error = error.when((F.col("last_page") < F.col("current_page")) | (F.col("has_next") != (F.col("current_page") < F.col("last_page"))), "inconsistent page numbers")
        error = error.when(F.col("total") < F.col("returned"), "invalid total").when((F.col("request_no") > 1) & ~before.eqNullSafe(F.col("total")), "the total changed")
        complete = ~F.col("has_next") & (F.lit(limit) >= F.col("returned"))
    else:
        error = error.when(F.col("total").isNull() | (F.col("total") < 0), "invalid total")
        complete = F.col("returned") < page_size
    return pages.withColumn("error", error).withColumn("complete", F.coalesce(complete, F.lit(False)) & F.col("error").isNull())


def query_results(pages: DataFrame, declared: int, multi: bool = True) -> DataFrame:
    """``source, queries, returned, complete``: complete if every declared query ran and completed; of a paged feed the last page decides."""
    last = F.max_by("complete", "request_no")
    whole = F.bool_and("complete") & (F.count_distinct("query") == declared) if multi else last
    return pages.groupBy("source").agg(F.count_distinct("query").alias("queries"), F.sum("returned").alias("returned"), whole.alias("complete"))


# ---- de-duplication


def dedup_postings(records: DataFrame) -> DataFrame:
    """One row of each group of copies, ``discoveredBy`` united; independent of the order of rows.

    In the order of (dataset, source id, fingerprint, url, id) a record joins what the first of its keys says that an earlier record had: (source, id), fingerprint, urls; visible
    fields count only without those.  A key stands for whatever the last record that had it belongs to.  So each record has at most one parent, the record before it by that key,
    and the first of its group is the end of its chain of parents.  Parents come from one sort of all keys over all tasks (``previous_of_key``), ends from rounds by the logarithm of the longest
    chain (``chain_ends``): neither a component nor a hot key is a task.  Records that tie in the whole order are taken as they come.
    """
    folded = {"_rid": "sourceRecordId", "_fp": "canonicalFingerprint", "_url": "canonicalUrl", "_surl": "sourceUrl", "_org": "hiringOrganization", "_title": "title", "_loc": "location"}
    order = ("sourceDataset", "sourceRecordId", "canonicalFingerprint", "canonicalUrl", "id")
    ranks = {f"_o{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(order)}
    in_order = records.withColumns({k: identity_form(v) for k, v in folded.items()} | ranks).repartitionByRange(*ranks).sortWithinPartitions(*ranks)
    named = written(in_order.withColumn("_row", F.monotonically_increasing_id()).drop(*ranks), "postings")
    source = F.coalesce("sourceDataset", F.lit(""))
    key = lambda kind, *cols: F.when(F.col(cols[-1] if kind != "v" else "_row").isNotNull(), F.concat_ws("\x1f", F.lit(kind), *[source if c == "s" else F.coalesce(c, F.lit("")) for c in cols]))
    stable = F.coalesce("_rid", "_fp", "_url", "_surl").isNotNull()
    keys = F.array_distinct(F.array_compact(F.array(key("s", "s", "_rid"), key("f", "_fp"), key("u", "_url"), key("u", "_surl"))))
    keys = F.when(stable, keys).otherwise(F.array(key("v", "s", "_org", "_title", "_loc")))
    before = previous_of_key(named.select("_row", F.posexplode(keys).alias("_place", "_key")), "_key", "_row").filter("before is not null")
    parents = before.groupBy(F.col("_row").alias("node")).agg(F.min_by("before", "_place").alias("parent"))
    roots = written(chain_ends(parents).select(F.col("node").alias("_row"), "root"), "roots")
    member = named.select("_row", F.explode("discoveredBy").alias("_by")).filter("_by is not null").join(roots, "_row", "left").select(F.coalesce("root", "_row").alias("_row"), "_by").distinct()
    pairs = member.withColumn("_fold", casefolded("_by")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_fold", "_by"))).alias("_pairs"))
    kept = named.join(roots, "_row", "left_anti").join(pairs, "_row", "left")
    united = F.coalesce(F.transform("_pairs", lambda p: p["_by"]), F.array().cast("array<string>"))
    return kept.withColumn("discoveredBy", united).select(*records.columns)


# ---- evidence


_NEGATED = re.compile("|".join(rf"\b{re.escape(cue)}\b" for cue in NEGATIONS))
#: Terms of a vocabulary, which is sent to all executors.
TERMS = 200_000
#: Matches that a task holds before it hands them on.
MATCHES = 10_000


@functools.cache
def _folds() -> dict[int, str]:
    """Characters whose form without case is not their lower-case letter, and that form: one character each, so places stay."""
    out = {}
    for code in range(0x1E944):
        char = chr(code)
        form = char
        for change in (str.upper, str.lower, str.casefold):
            form = changed if len(changed := change(form)) == 1 else form
        if form != char.lower() or char == "\u03a3":  # that letter's lower case depends on its place in a word
            out[code] = form if code != 0x130 else "i"
    return out


def _folded(text: str) -> str:
    return text.translate(_folds()).lower()


class TermScanner:
    """All matches of many terms as whole words in one scan: an automaton over the folded text, and a test of each place that it gives.

    A match is one of the pattern ``\\bterm\\b``, with or without case; matches of one term do not overlap.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms, by_form = terms, {}
        for i, (text, _) in enumerate(terms):
            if text:
                by_form.setdefault(_folded(text), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for form, own in by_form.items():
            self.automaton.add_word(form, (len(form), own))
        self.any = bool(by_form)
        if self.any:
            self.automaton.make_automaton()
        self.patterns: dict[int, re.Pattern] = {}

    def _pattern(self, i: int) -> re.Pattern:
        if i not in self.patterns:  # only terms that occur are compiled
            self.patterns[i] = re.compile(rf"\b{re.escape(self.terms[i][0])}\b", 0 if self.terms[i][1] else re.I)
        return self.patterns[i]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(term, start, end), by term and place."""
        found, ends = [], {}
        for last, (size, own) in self.automaton.iter(_folded(text)) if self.any else ():
            start = last + 1 - size
            for i in own:
                if start >= ends.get(i, 0) and (m := self._pattern(i).match(text, start)):
                    ends[i] = m.end()
                    found.append((i, start, m.end()))
        return sorted(found)


def _negated(text: str, start: int) -> bool:
    """Whether a cue of negation stands before the place, in its clause and window."""
    before = text[max(0, start - NEGATION_WINDOW) : start]
    return _NEGATED.search(re.split(r"[.!?;\n]", before)[-1].lower()) is not None


def _evidence(batch: pa.RecordBatch, scanner: TermScanner, terms: list[tuple], names: list[str], cues: bool) -> Iterator[pa.RecordBatch]:
    """Matches in the texts of a batch, ``MATCHES`` at a time; one text at a time is a Python object."""
    types = [batch.schema.field(names[0]).type, *[pa.string()] * 6, pa.int32(), pa.bool_()]
    ids, numbers, texts = (batch.column(c) for c in (names[0], "field_no", "text"))
    made = lambda found: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names)
    rows = []
    for i in range(batch.num_rows):
        k, no, clean = ids[i].as_py(), numbers[i].as_py(), " ".join(unicodedata.normalize("NFC", texts[i].as_py()).split())
        for term, a, b in scanner.find(clean):
            rows.append((k, *terms[term][2:], clean[a:b], FIELDS[no], no, cues and _negated(clean, a)))
            if len(rows) == MATCHES:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def find_evidence(records: DataFrame, terms: DataFrame, key: str = "id", cues: bool = True) -> DataFrame:
    """A row for every match of every term in the four text fields: term columns, ``matched_phrase``, ``source_field``, ``field_no``, ``negated``.

    ``terms`` (``text, case_sensitive, concept_uri, concept_label, concept_scheme, strength``) is a vocabulary of ``TERMS`` rows at most, which goes to all executors; a text is scanned once for
    all of them (``TermScanner``), so its cost is that of its length and its matches, of which a task holds ``MATCHES`` at most.  Empty terms match nothing.  Without ``cues`` no match is negated.
    """
    vocabulary = sorted(bounded(terms, TERMS).collect(), key=lambda t: (t.concept_uri, t.text))
    columns = ("concept_uri", "concept_label", "concept_scheme", "strength")
    shared = records.sparkSession.sparkContext.broadcast([(t.text or "", bool(t.case_sensitive), *(t[c] for c in columns)) for t in vocabulary])
    kind = records.schema[key].dataType.simpleString()

    names = [key, *columns, "matched_phrase", "source_field", "field_no", "negated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = TermScanner([t[:2] for t in shared.value])
        for batch in batches:
            yield from _evidence(batch, scanner, shared.value, names, cues)

    texts = F.array(*(F.struct(F.lit(i).alias("field_no"), F.col(f).alias("text")) for i, f in enumerate(FIELDS) if f in records.columns))
    long = records.select(key, F.explode(texts).alias("t")).select(key, "t.field_no", "t.text").filter("text is not null and text <> ''")
    schema = f"{key} {kind}, concept_uri string, concept_label string, concept_scheme string, strength string, matched_phrase string, source_field string, field_no int, negated boolean"
    return long.mapInArrow(run, schema)


def classify_evidence(records: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """``key, classification``: qualified by one strong concept, review by two contextual ones, else not_match; negated ones do not count."""
    strong, contextual = (F.count_distinct(F.when(~F.col("negated") & (F.col("strength") == s), F.col("concept_uri"))) for s in ("strong", "contextual"))
    found = evidence.groupBy(key).agg(strong.alias("strong"), contextual.alias("contextual"))
    verdict = F.when(F.col("strong") > 0, "qualified").when(F.col("contextual") > 1, "review").otherwise("not_match")
    return records.select(key).join(found, key, "left").select(key, verdict.alias("classification"))


def matched_concepts(evidence: DataFrame, base: str, key: str = "id") -> DataFrame:
    """``key, concepts``: sorted local names of concepts that are matched without negation."""
    mine = evidence.filter(~F.col("negated") & F.startswith("concept_uri", F.lit(base)))
    return mine.groupBy(key).agg(F.array_sort(F.collect_set(F.substring(F.col("concept_uri"), len(base) + 1, 1 << 20))).alias("concepts"))


# ---- runs and employers


def union_sources(refreshed: DataFrame, previous: DataFrame, source: str) -> DataFrame:
    """One source's new records with the last ones of all other sources."""
    return refreshed.unionByName(previous.filter(~F.col("sourceDataset").eqNullSafe(F.lit(source))))


def preserve_first_seen(current: DataFrame, previous: DataFrame, at: Column) -> DataFrame:
    """Earlier first sightings are kept by id; what is no longer there is left out."""
    earlier = previous.groupBy("id").agg(F.min("firstSeenAt").alias("_first"))
    joined = current.join(earlier, "id", "left")
    return joined.withColumns({"firstSeenAt": F.coalesce("_first", "firstSeenAt"), "lastSeenAt": at, "retrievedAt": at, "active": F.lit(True)}).select(*current.columns)


CLASSES = ("qualified", "review", "not_match")


def classification_counts(postings: DataFrame) -> DataFrame:
    """One row with a count for each class, zero where it has none."""
    return postings.agg(*(F.count_if(F.col("classification") == c).alias(c) for c in CLASSES))


def run_summary(postings: DataFrame, at: str, fetched: int, complete: bool) -> DataFrame:
    """One row: counts by class, active and all, completeness, and an id made of the time and a digest of the ids (``lines_digest``)."""
    stamp = at.replace("-", "").replace(":", "")
    digest = lines_digest(postings.select(F.col("id").alias("line"))).select(F.concat(F.lit(stamp + "-"), F.substring("digest", 1, 12)).alias("runId"))
    counts = postings.agg(
        F.lit(fetched).cast("bigint").alias("fetchedCount"), F.count("*").alias("deduplicatedCount"), F.count_if("active").alias("activeCount"), F.lit(complete).alias("completeSourceSnapshot"),
        *(F.count_if(F.col("classification") == c).alias(c) for c in CLASSES),
    )
    return digest.crossJoin(counts)  # a row each


def employers(postings: DataFrame) -> DataFrame:
    """``slug, name, postings``: the name of the posting of the smallest id."""
    named = postings.withColumn("slug", slugify("hiringOrganization", "unknown"))
    return named.groupBy("slug").agg(F.min_by("hiringOrganization", "id").alias("name"), F.count("*").alias("postings"))


def apply_confirmed_matches(present_employers: DataFrame, matches: DataFrame) -> DataFrame:
    """Confirmed identities (``slug, entity``) of employers that are in this run."""
    return matches.join(present_employers.select("slug").distinct(), "slug", "left_semi")


def propose_entity_matches(names: DataFrame, labels: DataFrame, claims: DataFrame, org_types: list[str], instance: str = "P31", website: str = "P856") -> DataFrame:
    """``slug, name, qid, label, is_organization, website``: entities whose label or alias is the employer's name, case folded."""
    fold = lambda c: F.lower(spaced(c))
    found = names.select("slug", "name", fold(F.col("name")).alias("fold")).join(labels.select(F.col("entity").alias("qid"), F.col("text").alias("label"), fold(F.col("text")).alias("fold")), "fold")
    about = claims.filter(F.col("property").isin(instance, website)).groupBy(F.col("subject").alias("qid")).agg(
        F.collect_set(F.when(F.col("property") == instance, F.col("value"))).alias("types"), F.min(F.when(F.col("property") == website, F.col("value"))).alias("website")
    )
    joined = found.join(about, "qid", "left")
    typed = F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, org_types))), F.lit(False))
    return joined.select("slug", "name", "qid", "label", typed.alias("is_organization"), "website").distinct()
