"""Scalar expressions on catalog values; each takes and gives columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .unicode import ascii_form, canonical_https_url, casefolded

# Fixed values.
ENTITY = "http://www.wikidata.org/entity/"
SHARED_HOSTS = ("bitbucket.org", "github.com", "gitlab.com")
STOP_WORDS = "about and data for from graph knowledge ontology resource semantic software that the this tool using vocabulary with".split()
NEGATIONS = ("no", "not", "without", "excluding", "except", "never", "n't", "isn't", "aren't", "don't", "doesn't", "won't", "wasn't")
NEGATION_WINDOW = 60
YEARLY = {"annual": 1, "yearly": 1, "monthly": 12, "weekly": 52, "daily": 260, "hourly": 2080}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trimmed(value: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(value), r"(?U)^\s+|\s+$", "")


def present(value: Column | str) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(trimmed(value), F.lit(""))


def filled(value: Column | str) -> Column:
    """Whether ``present`` leaves anything; null for null."""
    return _c(value).rlike(r"(?U)\S")


def spaced(value: Column | str) -> Column:
    """White space folded to single spaces and trimmed."""
    return F.trim(F.regexp_replace(_c(value), r"(?U)\s+", " "))


# F01
def qid(value: Column | str) -> Column:
    """The entity number at the end of an IRI, null without one."""
    return F.nullif(F.regexp_extract(F.rtrim(_c(value), F.lit("/")), r"(Q\d+)$", 1), F.lit(""))


def entity_iri(value: Column | str) -> Column:
    return F.concat(F.lit(ENTITY), qid(value))


def page_iri(base: str, dataset: Column | str, slug: Column | str) -> Column:
    return F.concat(F.lit(base + "/"), _c(dataset), F.lit("/"), _c(slug), F.lit("/"))


# F02, F03, F04
def slugify(value: Column | str, otherwise: str = "item") -> Column:
    slug = F.trim(F.regexp_replace(F.lower(ascii_form(_c(value))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(otherwise))


def sanitize_label(value: Column | str) -> Column:
    clean = F.trim(F.regexp_replace(ascii_form(_c(value)), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit("Resource"))
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("Resource_"), clean)).otherwise(clean)


def mint_iri(base: str, kind: str, label: Column | str, entity: Column | str) -> Column:
    """``<base>Kind_Label_Q1``; the entity's number stands in for a missing label."""
    return F.concat(F.lit(f"{base}{kind}_"), sanitize_label(F.coalesce(_c(label), qid(entity))), F.lit("_"), qid(entity))


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme in lower case, authority without user (host in lower case, port kept), path with single slashes."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return scheme, authority, F.regexp_replace(path, "/+", "/")


# F05
def canonical_repository(url: Column | str) -> Column:
    """``https://host/path`` of a repository; null for other schemes, bare hosts, and accounts on shared hosts."""
    scheme, authority, path = _parts(trimmed(url))
    path = F.regexp_replace(F.rtrim(path, F.lit("/")), r"(?i)\.git$", "")
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    shared = F.regexp_replace(authority, r":\d+$", "").isin(*SHARED_HOSTS)
    fits = scheme.isin("http", "https") & (authority != "") & (path != "") & ~(shared & (segments < 2))
    return F.when(fits, F.concat(F.lit("https://"), authority, path))


# F06
def namespace_family(url: Column | str) -> Column:
    """Scheme, authority and whole base path of a namespace; null for a bare host."""
    clean = trimmed(url)
    scheme, authority, path = _parts(clean)
    hierarchical = clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    base = F.rtrim(path, F.lit("/#"))
    fits = (scheme != "") & (base != "") & (~hierarchical | (authority != ""))
    return F.when(fits, F.concat(scheme, F.lit(":"), F.when(hierarchical, F.concat(F.lit("//"), authority)).otherwise(""), base))


# F07, F08
def text_tokens(*fields: Column | str) -> Column:
    """The set of words of four and more ASCII letters and digits that are no stop words."""
    text = casefolded(F.concat_ws(" ", *map(_c, fields)))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 4), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union > 0, F.size(F.array_intersect(_c(a), _c(b))) / union).otherwise(F.lit(0.0))


# F09, F10
def parse_datetime(value: Column | str) -> Column:
    """A leading plus is dropped; ISO times in UTC, else the date of the first ten characters, else null."""
    text = F.ltrim(trimmed(value), F.lit("+"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(text))
    day = F.substring(text, 1, 10)
    return F.coalesce(iso, F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day)))


def date_only(value: Column | str) -> Column:
    day = F.substring(trimmed(value), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(day)))


def unix_date(seconds: Column | str) -> Column:
    """The UTC date of epoch seconds."""
    return F.to_date(F.timestamp_seconds(_c(seconds).cast("double")))


# F11
def canonical_url(url: Column | str, allowed_host: str | None = None) -> Column:
    clean = canonical_https_url(_c(url))
    if allowed_host is None:
        return clean
    return F.when(F.regexp_replace(F.regexp_extract(clean, "^https://([^/?#]*)", 1), r":\d+$", "") == allowed_host, clean)


# F12
def _grouped(number: Column) -> Column:
    return F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.regexp_replace(F.format_number(number, 6), "0+$", ""))


def finite_bound(value: Column | str) -> Column:
    """A finite number that is not negative, else null."""
    number = _c(value).cast("double")
    return F.when(~F.isnan(number) & (number >= 0) & (number < float("inf")), number)


def salary_text(currency: Column | str, low: Column | str, high: Column | str, period: Column | str | None = None) -> Column:
    """``EUR 1,000–2,000 / year`` from what is there; null without bounds."""
    bounds = F.array_join(F.array_compact(F.array(_grouped(_c(low)), _grouped(_c(high)))), "–")
    value = F.concat_ws(" ", present(currency), bounds)
    shown = value if period is None else F.when(present(period).isNotNull(), F.concat(value, F.lit(" / "), present(period))).otherwise(value)
    return F.when(_c(low).isNotNull() | _c(high).isNotNull(), shown)


def salary_range(currency: Column | str, low: Column | str, high: Column | str, period: Column | str) -> Column:
    fields = F.struct(present(currency).alias("currency"), _c(low).alias("minValue"), _c(high).alias("maxValue"), present(period).alias("unitText"))
    return F.when(_c(low).isNotNull() | _c(high).isNotNull(), fields)


# F13
def sorted_strings(values: Column | str) -> Column:
    """Distinct texts with folded white space, by folded case and then text."""
    clean = F.array_distinct(F.filter(F.transform(_c(values), spaced), lambda v: v.isNotNull() & (v != "")))
    pairs = F.transform(clean, lambda v: F.struct(F.regexp_replace(F.lower(v), "ß", "ss").alias("f"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


# F14
def is_absolute_iri(value: Column | str) -> Column:
    return F.coalesce(_c(value).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"), F.lit(False))


def is_bare_id(value: Column | str) -> Column:
    return F.coalesce(_c(value).rlike(r"^[QP]\d+$"), F.lit(False))


# F15
def slug_from_url(base: str, url: Column | str, dataset: Column | str) -> Column:
    """What follows ``base/dataset/``; null for other urls."""
    prefix = F.concat(F.lit(base + "/"), _c(dataset), F.lit("/"))
    rest = F.rtrim(F.substring(_c(url), F.length(prefix) + 1, F.length(_c(url))), F.lit("/"))
    return F.when(F.startswith(_c(url), prefix), F.nullif(rest, F.lit("")))


def page_type(base: str, url: Column | str) -> Column:
    """Schema type of a canonical page url, null for others."""
    kinds = {"resource": "DefinedTermSet", "software": "SoftwareApplication"}
    out = F.lit(None).cast("string")
    for dataset, kind in kinds.items():
        out = F.when(_c(url).rlike(rf"^{_quoted(f'{base}/{dataset}/')}[^/]+/\z"), F.lit(kind)).otherwise(out)
    return out


def _quoted(text: str) -> str:
    """A Java pattern of the text itself."""
    return re.sub(r"[^A-Za-z0-9]", lambda m: rf"\x{{{ord(m[0]):x}}}", text)


# F16
def vector_id(generation: Column | str, dataset: Column | str, entity: Column | str) -> Column:
    """``generation:dataset:entity``; null beyond 64 bytes."""
    whole = F.concat_ws(":", _c(generation), _c(dataset), _c(entity))
    return F.when(F.octet_length(whole) <= 64, whole)


def generation_of(vector: Column | str) -> Column:
    """The generation of a qualified id, null for others."""
    return F.nullif(F.regexp_extract(_c(vector), r"^(.+):(?:ontologies|software):(?:Q\d+)$", 1), F.lit(""))


# F17
def is_sensitive_query(query: Column | str) -> Column:
    """Whether a mail address or a web address stands in it."""
    return F.lower(trimmed(query)).rlike(r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b|\bhttps?://|\bwww\.")


def sanitize_query(query: Column | str) -> Column:
    """Lower case, folded space, ASCII letters, digits, ``_`` and ``-``, 64 characters; empty for null."""
    return F.substring(F.regexp_replace(spaced(F.lower(F.coalesce(_c(query), F.lit("")))), "[^a-z0-9 _-]", ""), 1, 64)


def logged_query(query: Column | str) -> Column:
    """What a search log may keep: the sanitized query, ``[redacted]`` for addresses, null for nothing."""
    clean = F.nullif(sanitize_query(query), F.lit(""))
    return F.when(clean.isNotNull(), F.when(is_sensitive_query(query), F.lit("[redacted]")).otherwise(clean))


# F18
def generation_id(completed_at: Column | str, digest: Column | str) -> Column:
    return F.concat(F.date_format(_c(completed_at), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(_c(digest), 1, 12))


# F19
def is_negated(before: Column | str) -> Column:
    """Whether a negation stands in the clause just before a match, at most sixty characters back."""
    clause = F.lower(F.regexp_extract(F.right(_c(before), F.lit(NEGATION_WINDOW)), r"[^.!?;\n]*$", 0))
    cues = "|".join(NEGATIONS)
    return clause.rlike(rf"(?U)\b(?:{cues})\b")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def lines_digest(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``lines, digest`` of a column ``line``, for each ``by``: independent of the order of rows, and of no task that holds them all.

    Lines fall into parts by the first four hexadecimal digits of their SHA-256; a part's digest is the SHA-256 of its sorted lines, joined by newlines, and the whole
    digest is that of the parts' digests in the order of those digits, joined by newlines.
    """
    part = F.substring(F.sha2("line", 256), 1, 4)
    parts = lines.filter("line is not null").groupBy(*by, part.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\n")
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.sha2(joined, 256).alias("digest"))
