"""Readers and writers of catalog files: claims, feeds, items, triples, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIM = "array<struct<id:string,rank:string,mainsnak:struct<datatype:string,datavalue:struct<value:string>>>>"


def _statements(entities: DataFrame) -> DataFrame:
    entity = F.from_json("json", f"id string, claims map<string,{CLAIM}>")
    each = entities.select(entity.alias("e")).filter("e.id is not null").select(F.col("e.id").alias("subject"), F.explode("e.claims").alias("property", "statements"))
    flat = each.select("subject", "property", F.explode("statements").alias("s"))
    raw = F.col("s.mainsnak.datavalue.value")
    value = F.coalesce(F.get_json_object(raw, "$.id"), F.when(~F.startswith(raw, F.lit("{")), raw))
    return flat.select("subject", "property", F.col("s.rank").alias("rank"), F.col("s.mainsnak.datatype").alias("datatype"), value.alias("value"), F.col("s.id").alias("guid"))


def claims_of(entities: DataFrame) -> DataFrame:
    """Flat claims of entity documents, a column ``json`` of text; malformed parts are left to ``rejected_claims``."""
    return _statements(entities).filter("rank is not null and datatype is not null")


def rejected_claims(entities: DataFrame) -> DataFrame:
    """``json, subject, property, guid, reason`` of documents without an id, and of statements without rank or datatype."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    documents = entities.filter(F.from_json("json", "id string")["id"].isNull()).select("json", none("subject"), none("property"), none("guid"), F.lit("document").alias("reason"))
    statements = _statements(entities).filter("rank is null or datatype is null").select(none("json"), "subject", "property", "guid", F.lit("statement").alias("reason"))
    return documents.unionByName(statements)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """S1 from files of one entity document a line."""
    return claims_of(spark.read.text(path).withColumnRenamed("value", "json"))


def postings_of(pages: DataFrame, item: str, array: str, most: int | None = None) -> DataFrame:
    """A row for each posting of response pages (``source, request_no, query, json``, and what else is known of the page): its place and ``item`` (DDL) fields.

    ``most`` is a feed's own limit of records for a run, counted in the order of requests and places.  It is counted by pages: of a feed's pages with postings only the first ``most``
    can matter, and tasks keep no more before they meet.
    """
    body = F.from_json("json", f"`{array}` array<struct<{item}>>")[array]
    known = [c for c in pages.columns if c != "json"]
    if most is None:
        return pages.select(*known, F.posexplode(body).alias("pos", "item")).select(*known, "pos", "item.*")
    filled = pages.withColumn("_items", body).filter(F.size("_items") > 0)
    order = Window.partitionBy("source").orderBy("request_no", F.xxhash64("json"))
    first = filled.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    before = F.sum(F.size("_items")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = first.withColumn("_left", F.lit(most) - F.coalesce(before, F.lit(0))).filter("_left > 0")
    taken = left.select(*known, F.posexplode(F.slice("_items", 1, F.col("_left").cast("int"))).alias("pos", "item"))
    return taken.select(*known, "pos", "item.*")


REQUEST = "request_no bigint, query string, page struct<current:bigint,last:bigint,total:bigint,has_next:boolean>, body string"


def read_feed(spark: SparkSession, path: str, source: str, item: str, array: str, most: int | None = None) -> DataFrame:
    """S2 from files of one captured request a line, ``{request_no, query, page: {current, last, total, has_next}, body}``, where the body is the response's text."""
    captured = spark.read.schema(REQUEST).json(path)
    page = {"current_page": "current", "last_page": "last", "total": "total", "has_next": "has_next"}
    pages = captured.select(F.lit(source).alias("source"), "request_no", "query", *(F.col(f"page.{f}").alias(c) for c, f in page.items()), F.col("body").alias("json"))
    return postings_of(pages, item, array, most)


ITEM = (
    "title string, description string, wikidataId string, canonicalUrl string, homepage string, sourceRepo string, namespaceURI string, partOf string, category string, softwareType string, "
    "latestVersion string, releaseDate string, types array<string>, licenses array<string>, programmingLanguages array<string>, aliases array<string>, "
    "creators array<struct<name:string,type:string,wikidataId:string,githubProfile:string,googleScholarProfile:string>>, relatedTools array<struct<title:string,canonicalUrl:string>>"
)


def _items(documents: DataFrame, dataset: str) -> DataFrame:
    found = documents.select(F.explode("items").alias("i")).select(F.lit(dataset).alias("dataset"), "i.*")
    return found.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _document() -> T.StructType:
    return T.StructType([T.StructField("generatedAt", T.StringType()), T.StructField("items", T.ArrayType(T.StructType.fromDDL(ITEM)))])


def read_catalog(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """S3: items of files that are one document ``{generatedAt, items}`` each."""
    return _items(spark.read.schema(_document()).json(path, multiLine=True), dataset)


def read_catalog_lines(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """S3 for catalogs that are cut into documents of one line, which tasks can read side by side."""
    return _items(spark.read.schema(_document()).json(path), dataset)


def write_catalog(items: DataFrame, path: str, generated_at: str) -> None:
    """Items as JSON lines, in the order of title and id, with the time of generation; absent fields are left out."""
    from ..operators.records import ordered_items

    ordered_items(items).withColumn("generatedAt", F.lit(generated_at)).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


_LITERAL = r'^(<[^>]*>|_:\S+) <([^>]*)> (?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?) \.$'


def to_ntriples(triples: DataFrame) -> DataFrame:
    """A line for each triple."""
    node = lambda c, kind: F.when(kind == "bnode", c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    escaped = F.col("o")
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    tail = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), tail)).otherwise(node(F.col("o"), F.col("o_kind")))
    subject = F.when(F.startswith("s", F.lit("_:")), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return triples.select(F.concat(subject, F.lit(" <"), "p", F.lit("> "), value, F.lit(" .")).alias("value"))


def from_ntriples(lines: DataFrame) -> DataFrame:
    """Triples of lines; lines that do not parse are left to ``rejected_ntriples``."""
    at = lambda i: F.nullif(F.regexp_extract("value", _LITERAL, i), F.lit(""))
    parsed = lines.filter(F.col("value").rlike(_LITERAL)).select(at(1).alias("s"), at(2).alias("p"), at(3).alias("iri"), at(4).alias("node"), F.regexp_extract("value", _LITERAL, 5).alias("text"), at(6).alias("datatype"), at(7).alias("lang"))
    text = F.replace(F.col("text"), F.lit("\\\\"), F.lit("\x00"))
    for code, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    kind = F.when(F.col("iri").isNotNull(), "iri").when(F.col("node").isNotNull(), "bnode").otherwise("literal")
    return parsed.select(F.regexp_replace("s", "^<|>$", "").alias("s"), "p", F.coalesce("iri", "node", text).alias("o"), kind.alias("o_kind"), "datatype", "lang")


def rejected_ntriples(lines: DataFrame) -> DataFrame:
    """Lines that do not parse, but for empty ones and comments."""
    return lines.filter(~F.col("value").rlike(_LITERAL) & ~F.col("value").rlike(r"^\s*(#|$)"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    to_ntriples(triples.distinct()).write.mode("overwrite").text(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return from_ntriples(spark.read.text(path)).distinct()


def read_files_with_digest(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``path`` (below ``path``), ``size`` and ``sha256`` of every file whose name has no excluded prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.regexp_replace("path", "^.*?" + path.rstrip("/").replace(".", r"\.") + "/", "")
    named = files.select(inner.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    for prefix in excluded:
        named = named.filter(~F.startswith("path", F.lit(prefix)))
    return named


def append_query_log(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends a stream of searches to Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
