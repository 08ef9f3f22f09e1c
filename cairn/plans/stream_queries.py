"""Registered queries over streams, files and single expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import postings
from ..session import new_folder
from ..sources import catalog
from ..streaming import refresh
from .bindings import BASE, bound, catalog_items, sql
from .item_queries import FEED, _feed_pages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if text:
            SQL[function.__name__] = text
        return function

    return register


def _streamed(df: DataFrame, name: str, files: int = 3) -> DataFrame:
    """A table as a stream of a few files, one a batch."""
    folder = new_folder(df.sparkSession, name)
    df.repartition(files).write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


# ---- files


@query(sql("items", "select dataset, title, homepage, releaseDate from items"))
def read_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: documents of items, written as files of one document and read again."""
    items = catalog_items(spark, sf_dir)
    fields = [f.split()[0] for f in ("title", "description", "wikidataId", "canonicalUrl", "homepage", "releaseDate", "types", "licenses", "aliases", "creators", "relatedTools")]
    out = None
    for dataset in ("resource", "software"):
        folder = new_folder(spark, "catalog")
        own = items.filter(F.col("dataset") == dataset)
        parts = own.groupBy(F.col("p_partkey") % 8).agg(F.collect_list(F.struct(*fields)).alias("items"))
        parts.select(F.to_json(F.struct(F.lit("2024-01-01").alias("generatedAt"), "items")).alias("value")).write.text(folder)
        one = catalog.read_catalog_lines(spark, folder, dataset).select("dataset", "title", "homepage", "releaseDate")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("items", "select qid, title from items"))
def write_catalog(spark, sf_dir):
    """S5"""
    folder = new_folder(spark, "written")
    catalog.write_catalog(catalog_items(spark, sf_dir), folder, "2024-01-01T00:00:00Z")
    return spark.read.schema("wikidataId string, title string").json(folder).select(c.qid("wikidataId").alias("qid"), "title")


@query("select p_partkey // 100 as k, sum(length(p_name) + 1) as size, sha256(string_agg(p_name, chr(10) order by p_partkey) || chr(10)) as sha256 from part group by 1")
def read_files_with_digest(spark, sf_dir):
    """A file of a hundred names each, in order."""
    folder, own = new_folder(spark, "files"), table(spark, sf_dir, "part").withColumn("k", F.floor(F.col("p_partkey") / 100))
    own.repartition("k").sortWithinPartitions("k", "p_partkey").select(F.col("p_name").alias("value"), "k").write.partitionBy("k").text(folder)
    found = catalog.read_files_with_digest(spark, folder, ("_",))
    return found.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("bigint").alias("k"), "size", "sha256")


# ---- streams


@query(sql("log", "select session, event_id, tab from log where event_id % 19 <> 0"))
def append_query_log(spark, sf_dir):
    """S8"""
    stream = _streamed(bound(spark, sf_dir, "log"), "log")
    out = new_folder(spark, "appended")
    clean = stream.withColumn("q", c.logged_query("q")).filter("q is not null").select("session", "event_id", "tab", "q")
    catalog.append_query_log(clean, out, new_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("session", "event_id", "tab")


@query(sql("log", r"""select session, ts, tab, query from (select *, coalesce(lag(mark) over (partition by session order by ts, event_id), '') as before from (select session, ts, event_id, tab, q, case when trim(q) = '' then null when contains(q, '@') then '[redacted]' else replace(regexp_replace(lower(q), ' +', ' ', 'g'), '!', '') end as query, case when trim(q) = '' then '' else tab || '|' || case when contains(q, '@') then '[redacted]' else replace(regexp_replace(lower(q), ' +', ' ', 'g'), '!', '') end end as mark from log)) where query is not null and mark <> before"""))
def query_log_stream(spark, sf_dir):
    """Several batches out of order; a search far in the future, of no session and without text, moves the watermark past all others."""
    searches = bound(spark, sf_dir, "log").select("session", "ts", "event_id", "tab", "q")
    last = searches.agg(F.lit("").alias("session"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("").alias("tab"), F.lit(None).cast("string").alias("q"))
    folder = new_folder(spark, "searches")
    searches.withColumn("event_id", F.col("event_id").cast("bigint")).repartition(4, "event_id").write.parquet(folder)
    last.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(last.schema).parquet(folder)
    out = new_folder(spark, "searched")
    logged = refresh.query_log_stream(stream, "event_id")
    logged.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("session string, ts timestamp, tab string, query string").parquet(out)


def _normalized(rows: DataFrame) -> DataFrame:
    return postings.normalize_feed(rows, "b", {"key": "b", "name": "Feed b", "dataset": "feed-b"}, F.lit("2024-03-01").cast("timestamp"))


@query("""select 'b-' || cast(page_id as string) as id, 'not_match' as classification, 'feed-b' as sourceDataset from (select page_id, row_number() over (partition by replace(replace(replace(url, '?utm_source=feed', ''), '#top', ''), '&ref=x', '')
order by cast(page_id as string)) as n from pages where page_id % 9 <> 0 and url like 'https:%') where n = 1""")
def refresh_postings(spark, sf_dir):
    """Raw rows of one feed in a batch; the snapshot after it."""
    rows = catalog.postings_of(_feed_pages(spark, sf_dir), FEED, "jobs")
    path = new_folder(spark, "snapshot")
    terms = bound(spark, sf_dir, "match_terms").filter("text <> 'the'")
    refresh.refresh_postings(_streamed(rows, "raw", 1), path, new_folder(spark, "checkpoint"), _normalized, terms, F.lit("2024-03-02").cast("timestamp")).awaitTermination()
    return refresh.current_snapshot(spark, path).select("id", "classification", "sourceDataset")


# ---- the other feed layouts


def _laid_out(spark, sf_dir, layout: str, fields: dict[str, F.Column]) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(*(v.alias(k) for k, v in fields.items()))
    out = postings.normalize_feed(rows, layout, {"key": layout, "name": layout, "dataset": layout, "query": "q"}, F.lit("2024-03-01").cast("timestamp"))
    shown = ("sourceRecordId", "title", "description", "location", "employmentType", "salary")
    return out.select(*shown, "remote", "datePosted", F.array_join("tags", ",").alias("tags"), F.coalesce("rejected", F.lit("")).alias("rejected"))


SECURE = "url like 'https:%'"


def _s(*parts):
    return F.concat(*(F.col(p) if p in ("page_id", "url") else F.lit(p) for p in parts))


@query(f"select url as sourceRecordId, 'T' || page_id as title, 'Ex & co' as description, 'A,b' as location, 'Full time' as employmentType, 'EUR ' || format('{{:,}}', page_id * 1000) || ' / year' as salary, true as remote, date '1970-01-01' + cast(page_id as int) as datePosted, 'x' as tags, case when not {SECURE} then 'url' else '' end as rejected from pages".replace("'A,b' as location", "'A, b' as location"))
def normalize_feed_a(spark, sf_dir):
    none, k = F.lit(None).cast("string"), F.col("page_id")
    return _laid_out(spark, sf_dir, "a", {
        "title": _s("<b>T", "page_id", "</b>"), "excerpt": F.lit("Ex &amp; co"), "description": F.lit(""), "companyName": F.lit("Firm"), "employmentType": F.lit("Full  time"), "minSalary": (k * 1000).cast("double"), "maxSalary": F.lit(-1.0),
        "salaryPeriod": F.lit("year"), "currency": F.lit("EUR"), "seniority": F.array(F.lit("Lead")), "locationRestrictions": F.array(F.lit("b"), F.lit("A"), F.lit(" A ")), "categories": F.array(F.lit("x")), "pubDate": k * 86400, "expiryDate": none.cast("bigint"),
        "applicationLink": _s("url"), "guid": _s("url"),
    })


@query(f"select 's' || page_id as sourceRecordId, 'T' || page_id as title, 'D' as description, 'Rome' as location, 'full, part' as employmentType, cast(null as string) as salary, page_id % 2 = 0 as remote, cast(to_timestamp(1600000000 + page_id * 86400) as date) as datePosted, 'a,B' as tags, case when not {SECURE} then 'url' else '' end as rejected from pages")
def normalize_feed_c(spark, sf_dir):
    return _laid_out(spark, sf_dir, "c", {
        "slug": _s("s", "page_id"), "company_name": F.lit("Firm"), "title": _s("T", "page_id"), "description": F.lit("<p>D</p>"), "remote": F.col("page_id") % 2 == 0, "url": _s("url"), "tags": F.array(F.lit("B"), F.lit("a")),
        "job_types": F.array(F.lit("part"), F.lit("full")), "location": F.lit(" Rome "), "created_at": (F.col("page_id") * 86400 + 1600000000).cast("string"), "salary": F.lit(""),
    })


@query(f"select cast(page_id as string) as sourceRecordId, 'T' || page_id as title, 'Ex' as description, 'USA, Canada' as location, 'Full' as employmentType, cast(null as string) as salary, true as remote, date '2024-02-03' as datePosted, 'IT' as tags, case when not {SECURE} then 'url' else '' end as rejected from pages")
def normalize_feed_d(spark, sf_dir):
    return _laid_out(spark, sf_dir, "d", {
        "id": F.col("page_id"), "url": _s("url"), "jobTitle": _s("T", "page_id"), "jobDescription": F.lit(None).cast("string"), "jobExcerpt": F.lit("Ex"), "companyName": F.lit("Firm"), "jobGeo": F.lit("USA ,Canada,"),
        "pubDate": F.lit("2024-02-03 10:00"), "jobType": F.array(F.lit("Full")), "jobIndustry": F.array(F.lit("IT"), F.lit("IT")),
    })


@query(f"select cast(page_id as string) as sourceRecordId, 'T' || page_id as title, 'S' as description, case when page_id % 2 = 0 then 'Remote' else 'Paris' end as location, cast(null as string) as employmentType, '5k' as salary, case when page_id % 2 = 0 then true end as remote, cast(null as date) as datePosted, cast(null as string) as tags, case when not {SECURE} then 'url' else '' end as rejected from pages")
def normalize_feed_e(spark, sf_dir):
    return _laid_out(spark, sf_dir, "e", {
        "id": F.col("page_id").cast("string"), "title": _s("T", "page_id"), "company": F.lit("Firm"), "snippet": F.lit("S"), "link": _s("url"), "location": F.when(F.col("page_id") % 2 == 0, "Remote").otherwise("Paris"), "updated": F.lit("soon"),
        "type": F.lit(""), "salary": F.lit("5k"),
    })


@query(f"select cast(page_id as string) as sourceRecordId, 'T' || page_id as title, 'D' as description, 'Town' as location, 'Permanent, Full Time' as employmentType, 'USD ' || format('{{:,}}', 1000 + page_id) as salary, cast(null as boolean) as remote, date '2024-05-05' as datePosted, 'IT' as tags, concat_ws(',', case when page_id % 4 = 0 then 'employer' end, case when not {SECURE} then 'url' end) as rejected from pages")
def normalize_feed_f(spark, sf_dir):
    return _laid_out(spark, sf_dir, "f", {
        "id": F.col("page_id").cast("string"), "title": _s("T", "page_id"), "company": F.when(F.col("page_id") % 4 != 0, F.struct(F.lit("Firm").alias("display_name"))), "description": F.lit("D"), "redirect_url": _s("url"),
        "location": F.struct(F.lit("Town").alias("display_name")), "created": F.lit("2024-05-05T01:02:03Z"), "salary_min": (F.col("page_id") + 1000).cast("double"), "salary_max": F.lit(0.0), "contract_type": F.lit("permanent"), "contract_time": F.lit("full_time"),
        "category": F.struct(F.lit("IT").alias("label"), F.lit("it").alias("tag")),
    })


# ---- scalar expressions


@query("select p_partkey, 'Q' || cast(p_partkey as string) as qid, 'http://www.wikidata.org/entity/Q' || cast(p_partkey as string) as iri, 'https://catalog.example/resource/' || p_brand || '/' as page from part")
def qid(spark, sf_dir):
    iri = F.concat(F.lit("https://any/Q"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", c.qid(iri).alias("qid"), c.entity_iri(iri).alias("iri"), c.page_iri(BASE, F.lit("resource"), "p_brand").alias("page"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'Resource_' else '' end || trim(regexp_replace(case when p_partkey % 3 = 0 then '9 ' else '' end || p_name || '!', '[^A-Za-z0-9]+', '_', 'g'), '_') as label from part")
def sanitize_label(spark, sf_dir):
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "9 ").otherwise(""), "p_name", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", c.sanitize_label(text).alias("label"))


@query("select s_suppkey, 'k:License_' || case when s_suppkey % 2 = 0 then regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g') else 'Q' || cast(s_suppkey as string) end || '_Q' || cast(s_suppkey as string) as iri from supplier")
def mint_iri(spark, sf_dir):
    entity = F.concat(F.lit("http://e/Q"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", c.mint_iri("k:", "License", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), entity).alias("iri"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^https?', 'http') as family from pages")
def namespace_family(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", c.namespace_family(F.regexp_replace("url", "^https?", "HTTP")).alias("family"))


@query("select p_partkey, array_to_string(list_sort([w for w in list_distinct(string_split(lower(p_name), ' ')) if length(w) >= 4]), ',') as tokens from part")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(c.text_tokens("p_name", F.lit("About THE graph"))), ",").alias("tokens"))


@query("select event_id, case when event_id % 4 <> 0 then cast(ts as date) end as day, cast(to_timestamp(event_id * 86400) as date) as unix_day from events")
def date_only(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "2024-13-01").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", c.date_only(text).alias("day"), c.unix_date(F.col("event_id") * 86400).alias("unix_day"))


@query("""select l_orderkey, l_linenumber, 'EUR ' || format('{:,}', cast(l_quantity as bigint)) || case when l_linenumber % 2 = 0 then '–' || format('{:,}', cast(l_quantity * 1000 as bigint)) else '' end || ' / year' as shown, l_quantity as low from lineitem""")
def salary_text(spark, sf_dir):
    low, high = c.finite_bound("l_quantity"), F.when(F.col("l_linenumber") % 2 == 0, c.finite_bound(F.col("l_quantity") * 1000))
    shown = c.salary_text(F.lit("EUR"), low, high, F.lit("year"))
    pay = c.salary_range(F.lit("EUR"), low, high, F.lit("year"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"), pay["minValue"].alias("low"))


@query("select p_partkey, array_to_string([x[2] for x in list_sort([[lower(w), w] for w in list_distinct([p_brand, upper(p_type), 'a b', 'A b'])])], ',') as values from part")
def sorted_strings(spark, sf_dir):
    values = F.array(F.concat(F.lit(" "), "p_brand"), F.upper("p_type"), F.lit("a\t b"), F.lit("A b"), F.col("p_brand"), F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(c.sorted_strings(values), ",").alias("values"))


@query("select page_id, page_id % 3 <> 0 as absolute, page_id % 3 = 0 as bare from pages")
def is_absolute_iri(spark, sf_dir):
    value = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Q"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", c.is_absolute_iri(value).alias("absolute"), c.is_bare_id(value).alias("bare"))


@query(sql("items", "select qid, 'part-' || cast(p_partkey as string) as slug, case dataset when 'software' then 'SoftwareApplication' else 'DefinedTermSet' end as kind from items"))
def slug_from_url(spark, sf_dir):
    return bound(spark, sf_dir, "items").select("qid", c.slug_from_url(BASE, "canonicalUrl", "dataset").alias("slug"), c.page_type(BASE, "canonicalUrl").alias("kind"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'g:software:Q' || cast(p_partkey as string) end as id, case when p_partkey % 2 = 0 then 'g' end as generation from part")
def vector_id(spark, sf_dir):
    entity = F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))
    made = c.vector_id(F.when(F.col("p_partkey") % 2 == 0, "g").otherwise("g" * 60), F.lit("software"), entity)
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("id"), c.generation_of(made).alias("generation"))


@query("select event_id, case when event_id % 10 = 0 then '[redacted]' else substr(lower(event_type) || ' cc ' || cast(user_id as string), 1, 64) end as query from events")
def sanitize_query(spark, sf_dir):
    asked = F.when(F.col("event_id") % 10 == 0, "see https://x.org").otherwise(F.concat(F.lit("  "), F.upper("event_type"), F.lit("  c++c "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", c.logged_query(asked).alias("query"))


@query("select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(event_type), 1, 12) as generation from events")
def generation_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", c.generation_id("ts", F.sha2("event_type", 256)).alias("generation"))


@query("select event_id, event_id % 3 = 0 as negated from events")
def is_negated(spark, sf_dir):
    before = F.when(F.col("event_id") % 3 == 0, "Fine. There is NOT any ").when(F.col("event_id") % 3 == 1, "It is not so. We have ").otherwise(F.concat(F.lit("not "), F.repeat(F.lit("x"), 60)))
    return table(spark, sf_dir, "events").select("event_id", c.is_negated(before).alias("negated"))
