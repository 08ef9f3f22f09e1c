"""Inputs of the registered queries as SQL over the given tables, in words that Spark and other engines share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
BASE = "https://catalog.example"

B: dict[str, str] = {}

B["claims"] = """
select 'Q' || cast(100 + n_nationkey as string) as subject, 'P279' as property, 'normal' as rank, 'wikibase-item' as datatype, 'Q' || cast(10 + n_regionkey as string) as value, 'n' || cast(n_nationkey as string) as guid from nation
union all select 'Q' || cast(1000 + s_suppkey as string), 'P31', 'normal', 'wikibase-item', 'Q' || cast(100 + s_nationkey as string), 's' || cast(s_suppkey as string) from supplier
union all select 'Q' || cast(1000000 + c_custkey as string), 'P31', 'normal', 'wikibase-item', 'Q' || cast(100 + c_nationkey as string), 'c' || cast(c_custkey as string) from customer
union all select 'Q' || cast(1000000 + o_custkey as string), 'P' || cast(500 + o_orderkey % 4 as string), case o_orderstatus when 'F' then 'preferred' when 'O' then 'normal' else 'deprecated' end,
  case when o_orderkey % 7 = 0 then 'string' else 'wikibase-item' end, 'Q' || cast(10000000 + o_orderkey as string), 'o' || cast(o_orderkey as string) from orders
"""
B["classes"] = "select 'Q' || cast(10 + r_regionkey as string) as node from region where r_regionkey < 3"
B["entities"] = "select 'Q' || cast(100 + n_nationkey as string) as qid from nation union all select 'Q' || cast(1000 + s_suppkey as string) from supplier"
B["terms"] = """
select 'Q' || cast(100 + n_nationkey as string) as entity, 'label' as kind, case when n_nationkey % 3 = 0 then 'en' when n_nationkey % 3 = 1 then 'mul' else 'fr' end as lang, n_name as text from nation
union all select 'Q' || cast(100 + n_nationkey as string), 'label', 'de', n_name || ' (de)' from nation where n_nationkey % 2 = 0
union all select 'Q' || cast(1000 + s_suppkey as string), 'label', 'en', s_name from supplier where s_suppkey % 4 <> 0
union all select 'Q' || cast(1000 + s_suppkey as string), 'description', case when s_suppkey % 2 = 0 then 'mul' else 'en' end, 'Supplier in ' || cast(s_nationkey as string) from supplier where s_suppkey % 3 <> 0
union all select 'Q' || cast(1000 + s_suppkey as string), 'description', 'fr', 'Fournisseur' from supplier
union all select 'Q' || cast(1000 + s_suppkey as string), 'alias', case when s_suppkey % 5 = 0 then 'fr' else 'en' end, 'S-' || cast(s_suppkey % 10 as string) from supplier
union all select 'Q' || cast(1000 + s_suppkey as string), 'alias', 'en', 'Supp ' || cast(s_suppkey as string) from supplier where s_suppkey % 2 = 0
"""
B["edges"] = """
select 'C' || cast(o_custkey as string) as subject_qid, 'ordered' as property_id, 'O' || cast(o_orderkey as string) as object_qid from orders
union all select 'O' || cast(l_orderkey as string), 'part', 'P' || cast(l_partkey as string) from lineitem
union all select 'O' || cast(l_orderkey as string), 'supplier', 'S' || cast(l_suppkey as string) from lineitem
"""
B["members"] = """
select 'C' || cast(c_custkey as string) as qid, 'people' as catalog from customer where c_custkey % 5 <> 0
union all select 'O' || cast(o_orderkey as string), 'papers' from orders where o_orderkey % 3 <> 0
union all select 'P' || cast(p_partkey as string), 'things' from part
union all select 'P' || cast(p_partkey as string), 'papers' from part where p_partkey % 10 = 0
"""
B["versions"] = """
select 'C' || cast(o_custkey as string) as item, o_orderpriority as version, case when o_orderstatus = 'P' or o_custkey % 9 = 0 then null else cast(cast(o_orderdate as date) as string) end as pub_date from orders
"""
B["items"] = f"""
select case when p_partkey % 2 = 0 then 'resource' else 'software' end as dataset, 'Q' || cast(2000000 + p_partkey as string) as qid, p_partkey as position,
  case when p_partkey % 13 = 0 then null else p_name || ' ' || cast(p_partkey as string) end as title,
  case when p_partkey % 17 = 0 then 'Glossary' else p_name || ', a ' || p_type || ' of ' || p_brand end as description,
  'http://www.wikidata.org/entity/Q' || cast(2000000 + p_partkey as string) as wikidataId,
  '{BASE}/' || case when p_partkey % 2 = 0 then 'resource' else 'software' end || '/part-' || cast(p_partkey as string) || '/' as canonicalUrl,
  case when p_partkey % 11 = 0 then null else 'https://host' || cast(p_partkey % 97 as string) || '.example.org/p' || cast(p_partkey as string) end as homepage,
  case when p_partkey % 5 = 0 then '' when p_partkey % 3 = 0 then 'http://GitHub.com/' || replace(p_brand, '#', '-') || '/r' || cast(p_partkey % 50 as string) || '.git' else 'https://github.com/' || replace(p_brand, '#', '-') end as sourceRepo,
  'http://ns.example.org/' || replace(p_brand, '#', '-') || '/s' || cast(p_size as string) || '#' as namespaceURI,
  p_type as category, p_brand as softwareType, cast(p_size as string) as latestVersion, cast(null as string) as partOf,
  case when p_size % 4 = 0 then null else '2024-01-' || case when p_size % 28 < 9 then '0' else '' end || cast(p_size % 28 + 1 as string) end as releaseDate,
  p_size, p_brand, p_type, p_name, p_partkey from part
"""
B["features"] = """
select case when p_partkey % 2 = 0 then 'resource' else 'software' end as dataset, 'p' || cast(p_partkey as string) as subject, 'entity' as kind, 'part:' || cast(p_partkey as string) as key from part
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'parent', p_brand || '|' || cast(p_size as string) from part
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'source_type', p_type || '|' || p_brand from part
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'creator', 'c' || cast(p_partkey % 400 as string) from part
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'uses', 'part:' || cast(p_partkey + 2 as string) from part where p_partkey % 50 < 2
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'category', p_type from part
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'license', 'l' || cast(p_size % 5 as string) from part
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'token', lower(split_part(p_name, ' ', 1)) from part where length(split_part(p_name, ' ', 1)) >= 4
union all select case when p_partkey % 2 = 0 then 'resource' else 'software' end, 'p' || cast(p_partkey as string), 'token', lower(split_part(p_name, ' ', 2)) from part where length(split_part(p_name, ' ', 2)) >= 4
union all select distinct 'resource', 'b:' || p_brand || '|' || cast(p_size as string), 'entity', p_brand || '|' || cast(p_size as string) from part where p_size % 6 <> 0
"""
B["slugs_in"] = """
select case when p_partkey % 2 = 0 then 'resource' else 'software' end as dataset, 'Q' || cast(p_partkey as string) as qid, p_name as label, 'http://www.wikidata.org/entity/Q' || cast(p_partkey as string) as item_iri from part
"""
B["registry"] = """
select case when p_partkey % 2 = 0 then 'resource' else 'software' end as dataset, 'Q' || cast(p_partkey as string) as qid, 'part-' || cast(p_partkey as string) as slug from part where p_partkey % 3 = 0
"""
B["current"] = f"""
select case when o_orderkey % 2 = 0 then 'resource' else 'software' end as dataset, 'O' || cast(o_orderkey as string) as qid, '{BASE}/o/' || cast(case when o_orderkey % 501 = 0 then 0 else o_orderkey end as string) as canonicalUrl,
  case when o_orderkey % 4 = 0 then null else 'https://h.example/' || cast(o_orderkey as string) end as homepage, case when o_orderstatus = 'F' then '' else o_orderpriority end as license from orders where o_orderkey % 20 <> 0
"""
B["baseline"] = f"""
select case when o_orderkey % 2 = 0 then 'resource' else 'software' end as dataset, 'O' || cast(o_orderkey as string) as qid, '{BASE}/o/' || cast(o_orderkey as string) as canonicalUrl,
  case when o_orderkey % 8 = 0 then null else 'https://h.example/' || cast(o_orderkey as string) end as homepage, o_orderpriority as license from orders where o_orderkey % 33 <> 0
"""
B["triples"] = """
select 'S' || cast(s_suppkey as string) as s, 'rdf:type' as p, 'k:Supplier' as o, 'iri' as o_kind, cast(null as string) as datatype, cast(null as string) as lang from supplier
union all select 'S' || cast(s_suppkey as string), 'k:name', s_name, 'literal', cast(null as string), 'en' from supplier where s_suppkey % 7 <> 0
union all select 'S' || cast(s_suppkey as string), 'k:name', s_name || ' Ltd', 'literal', cast(null as string), 'en' from supplier where s_suppkey % 9 = 0
union all select 'S' || cast(s_suppkey as string), 'k:nation', 'k:nation' || cast(s_nationkey as string), case when s_suppkey % 11 = 0 then 'literal' else 'iri' end, cast(null as string), cast(null as string) from supplier
union all select 'S' || cast(s_suppkey as string), 'k:balance', cast(cast(round(s_acctbal) as bigint) as string), 'literal', case when s_suppkey % 13 = 0 then cast(null as string) else 'xsd:integer' end, cast(null as string) from supplier
union all select 'S' || cast(s_suppkey as string), 'k:segment', case when s_suppkey % 6 = 0 then 'Q' || cast(s_suppkey as string) else 'k:seg' || cast(s_suppkey % 4 as string) end, 'iri', cast(null as string), cast(null as string) from supplier
union all select 'k:nation' || cast(n_nationkey as string), 'rdf:type', 'k:Nation', 'iri', cast(null as string), cast(null as string) from nation where n_nationkey % 5 <> 0
"""
B["postings"] = """
select 'j' || cast(page_id as string) as id, cast(page_id as string) as sourceRecordId, url as canonicalUrl, url as sourceUrl, 'feed' || cast(page_id % 3 as string) as sourceDataset, 'Job ' || cast(page_id % 40 as string) as title,
  'Firm ' || cast(page_id % 25 as string) as hiringOrganization, 'City ' || cast(page_id % 7 as string) as location, cast(null as string) as canonicalFingerprint from pages
union all select 'k' || cast(page_id as string), 'x' || cast(page_id as string), url, url || '?utm_source=feed', 'feed' || cast(page_id % 3 as string), 'Job ' || cast(page_id % 40 as string), 'Firm ' || cast(page_id % 25 as string), 'City ' || cast(page_id % 7 as string), cast(null as string) from pages where page_id % 2 = 0
union all select 'm' || cast(page_id as string), cast(null as string), cast(null as string), cast(null as string), 'feed' || cast(page_id % 3 as string), 'Job ' || cast(page_id % 40 as string), 'Firm ' || cast(page_id % 25 as string), 'City ' || cast(page_id % 7 as string), cast(null as string) from pages where page_id % 5 = 0
"""
B["classified"] = """
select 'd' || cast(doc_id as string) as id, case when doc_id % 3 = 0 then 'qualified' when doc_id % 3 = 1 then 'not_match' else 'review' end as classification, doc_id % 4 <> 0 as active, source as sourceDataset, 'Firm ' || cast(doc_id % 31 as string) || case when doc_id % 2 = 0 then '!' else '' end as hiringOrganization from documents
"""
B["texts"] = "select 'd' || cast(doc_id as string) as id, doc_id, text as description, lang from documents"
B["match_terms"] = """
select 'the' as text, false as case_sensitive, 'k:the' as concept_uri, 'The' as concept_label, 'S' as concept_scheme, 'contextual' as strength union all select 'thing', true, 'k:thing', 'Thing', 'S', 'strong'
union all select 'and', true, 'k:and', 'And', 'S', 'contextual' union all select 'Licensed', true, 'k:licence', 'Licence', 'S', 'strong'
"""
B["vectors"] = "select 'g1:ontologies:Q' || cast(vec_id as string) as id, case when vec_id % 50 = 0 then 'g2' else 'g1' end as namespace, cast(label as string) as dataset, embedding as vec, vec_id from embeddings"
B["expected_ids"] = "select 'g1:ontologies:Q' || cast(vec_id as string) as id from embeddings where vec_id % 40 <> 0 union all select 'g1:ontologies:Q9' || cast(vec_id as string) || '9' from embeddings where vec_id % 100 = 1"
B["states"] = """
select 'g' || cast(s_suppkey as string) as generation_id, case when s_suppkey % 3 = 0 then 'ready' else 'seeding' end as status, s_suppkey as vector_count, cast(s_suppkey % 17 as bigint) * 1000 + s_suppkey as verified_at, cast(null as string) as failure_reason from supplier
"""
B["state_updates"] = """
select 'g' || cast(s_suppkey + 10 as string) as generation_id, case when s_suppkey % 2 = 0 then 'retired' end as status, cast(null as bigint) as vector_count, s_suppkey * 7 as verified_at, 'why' as failure_reason from supplier
"""
B["log"] = "select cast(user_id as string) as session, ts, event_id, 'tab' || cast(event_id % 2 as string) as tab, case when event_id % 19 = 0 then '  ' when event_id % 23 = 0 then 'mail me@example.org' else upper(event_type) || '  x!' end as q from events"
B["crawl"] = "select url, html as body, case when page_id % 10 = 0 then 403 when page_id % 10 = 1 then 404 when page_id % 10 = 2 then 500 else 200 end as status from pages"
B["files"] = "select 'part' || cast(p_partkey % 3 as string) || '/' || cast(p_partkey as string) as path, p_name as content from part"
B["queries"] = """
select cast(p_partkey as string) as query_id, p_name as q, case when p_partkey % 2 = 0 then lower(p_type) end as category, cast(null as string) as dataset from part where p_partkey % 50 = 0
union all select 'i' || cast(p_partkey as string), 'http://www.wikidata.org/entity/q' || cast(2000000 + p_partkey as string), null, null from part where p_partkey % 50 = 0
"""
B["claim_edits"] = """
select 'Q' || cast(1000000 + o_custkey as string) as qid, 'o' || cast(o_orderkey as string) as guid, 'P' || cast(o_orderkey % 3 as string) as property, 'V' || cast(o_custkey % 5 as string) as value, 'normal' as rank from orders
"""
B["intent_edits"] = """
select 'Q' || cast(1000000 + c_custkey as string) as qid, case when c_custkey % 2 = 0 then 'remove' else 'add' end as action, 'P' || cast(c_custkey % 4 as string) as property, 'V' || cast(c_custkey % 5 as string) as value from customer
"""

B["vocab"] = "select 'k' || cast(s_suppkey as string) as iri, 'Label ' || cast(s_suppkey as string) as label, 'slug' || cast(s_suppkey % 90 as string) as slug, 'scheme' || cast(s_suppkey % 2 as string) as scheme, s_suppkey as sort_order from supplier"
B["assigned"] = "select case when p_partkey % 2 = 0 then 'resource' else 'software' end as dataset, 'Q' || cast(p_partkey as string) as qid, 'k' || cast(p_partkey % 150 as string) as concept_iri from part where p_partkey % 4 <> 0"
B["decisions"] = "select 'Q' || cast(c_custkey % 700 as string) as qid, case when c_custkey % 3 = 0 then 'exclusion' else 'exception' end as kind, case when c_custkey % 50 = 0 then ' ' else 'seen' end as evidence from customer"

_NAME = re.compile(r"\b(from|join)\s+(" + "|".join(TABLES) + r")\b")


#: Rows of a task of wide bindings, and the column that deals them out: a compressed file of a few MB may hold millions of rows, and is read by one task, which would also do all that follows.
#: The table is dealt out, not the binding, whose rows are several times as wide.
ROWS = 20_000
WIDE = {"items": ("part", f"'{BASE}/' || case when p_partkey % 2 = 0 then 'resource' else 'software' end || '/part-' || cast(p_partkey as string) || '/'")}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding over the tables of ``sf_dir``."""
    ship(spark)
    text = _NAME.sub(r"\1 {\2}", B[name])
    used = {m[2]: spark.read.parquet(f"{sf_dir}/{m[2]}.parquet") for m in _NAME.finditer(B[name])}
    if name in WIDE:
        table, key = WIDE[name]
        parts = -(-used[table].count() // ROWS)
        used[table] = used[table].repartition(parts, F.expr(key)) if parts > 1 else used[table]
    return spark.sql(text, **used)


def sql(names: str, query: str) -> str:
    """The query after the bindings it names, as common table expressions."""
    return "with " + ", ".join(f"{n} as ({B[n]})" for n in names.split()) + " " + query


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their lists."""
    c = F.col
    return bound(spark, sf_dir, "items").withColumns({
        "subject": c("canonicalUrl"), "types": F.array("p_type"), "licenses": F.when(c("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("L"), c("p_size") % 3))),
        "programmingLanguages": F.array(F.element_at(F.array(F.lit("Java"), F.lit("Rust"), F.lit("C")), (c("p_partkey") % 3 + 1).cast("int"))),
        "aliases": F.when(c("p_partkey") % 3 == 0, F.array(F.upper(F.substring("p_name", 1, 4)))).otherwise(F.array().cast("array<string>")),
        "creators": F.array(F.struct(F.concat(F.lit("Maker "), c("p_partkey") % 20).alias("name"), F.lit("Person").alias("type"), F.lit(None).cast("string").alias("wikidataId"), F.lit(None).cast("string").alias("githubProfile"), F.lit(None).cast("string").alias("googleScholarProfile"))),
        "relatedTools": F.transform(F.array(c("p_partkey") + 2, c("p_partkey") + 22), lambda k: F.struct(F.concat(F.lit("Part "), k).alias("title"), F.concat(F.lit(BASE + "/"), c("dataset"), F.lit("/part-"), k.cast("string"), F.lit("/")).alias("canonicalUrl"))),
    })


def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records behind the items: creators and entities by IRI, and the nodes that a record refers to."""
    c, fields = F.col, ("licenseName", "wikidataId", "githubProfile", "googleScholarProfile")
    entity = lambda *parts: F.concat(F.lit("http://www.wikidata.org/entity/"), F.translate(F.concat(*parts), " #", "--"))
    creator = lambda v: F.concat(F.lit(BASE + "/creator/"), F.lower(F.replace(v["name"], F.lit(" "), F.lit("-"))))
    node = lambda iri, label, kind, **more: F.struct(iri.alias("iri"), label.alias("label"), kind.alias("kind"), *(more.get(f, F.lit(None).cast("string")).alias(f) for f in fields))
    classes = F.array(node(c("category"), c("category"), F.lit("Category")), node(c("softwareType"), c("softwareType"), F.lit("SoftwareType")))
    licenses = F.transform("licenses", lambda v: node(v, v, F.lit("License"), licenseName=v))
    creators = F.transform("creators", lambda v: node(creator(v), v["name"], v["type"], **{f: v[f] for f in fields[1:]}))
    return catalog_items(spark, sf_dir).withColumns({
        "nodes": F.concat(classes, licenses, creators), "creators": F.transform("creators", creator),
        "parents": F.array(entity("p_brand", F.lit("-"), c("p_size").cast("string"))), "source_types": F.array(entity("p_type", F.lit("-"), "p_brand")),
        "uses": F.when(c("p_partkey") % 50 < 2, F.array(entity(F.lit("Q"), (c("p_partkey") + 2000002).cast("string")))),
    })
