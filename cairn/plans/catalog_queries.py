"""Registered queries over claims, records, related records, profiles and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, claims, profile, records, related
from ..session import written
from .bindings import ROWS, bound, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if text:
            SQL[function.__name__] = text
        return function

    return register


def joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


# ---- claims

TRUTHY = """, best as (select *, max(case when rank = 'preferred' then 1 else 0 end) over (partition by subject, property) as pref from claims),
truthy as (select distinct subject as subject_qid, property as property_id, value as object_qid from best
  where ((pref = 1 and rank = 'preferred') or (pref = 0 and rank = 'normal')) and datatype = 'wikibase-item')"""


@query(sql("claims", "select subject, property, rank, datatype, value, guid from claims"))
def read_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as files of entity documents, and flat again."""
    from ..session import new_folder
    from ..sources.catalog import read_claims as flat_claims

    flat, folder = bound(spark, sf_dir, "claims"), new_folder(spark, "entities")
    snak = F.struct("datatype", F.struct(F.to_json(F.struct(F.col("value").alias("id"))).alias("value")).alias("datavalue"))
    one = F.struct(F.col("guid").alias("id"), "rank", snak.alias("mainsnak"))
    by_property = flat.groupBy("subject", "property").agg(F.collect_list(one).alias("s"))
    entities = by_property.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("property", "s"))).alias("claims"))
    entities.select(F.to_json(F.struct(F.col("subject").alias("id"), "claims")).alias("value")).write.text(folder)
    return flat_claims(spark, folder)


@query("""select case when o_orderkey % 10 = 0 then 'order ' || cast(o_orderkey as string) end as json, case when o_orderkey % 10 <> 0 then 'Q' || cast(o_orderkey as string) end as subject, case when o_orderkey % 10 <> 0 then 'P1' end as property,
case when o_orderkey % 10 <> 0 then 'g' || cast(o_orderkey as string) end as guid, case when o_orderkey % 10 = 0 then 'document' else 'statement' end as reason from orders where o_orderkey % 10 in (0, 2, 3)""")
def rejected_claims(spark, sf_dir):
    """Text that is no document, and statements without rank or datatype."""
    from ..sources.catalog import rejected_claims as rejects

    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    statement = F.concat(F.lit('{"id":"g'), key, F.lit('"'), F.when(k % 10 != 2, F.lit(',"rank":"normal"')).otherwise(""), F.lit(',"mainsnak":{'), F.when(k % 10 != 3, F.lit('"datatype":"string"')).otherwise(""), F.lit("}}"))
    document = F.concat(F.lit('{"id":"Q'), key, F.lit('","claims":{"P1":['), statement, F.lit("]}}"))
    return rejects(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(k % 10 == 0, F.concat(F.lit("order "), key)).otherwise(document).alias("json")))


@query(sql("claims", "").rstrip() + TRUTHY + " select * from truthy")
def truthy_edges(spark, sf_dir):
    return claims.truthy_edges(bound(spark, sf_dir, "claims"))


@query(
    sql("claims", "").rstrip() + TRUTHY + """ select 'Q' || cast(1000000 + c_custkey as string) as qid, coalesce(string_agg(case when property_id = 'P500' then object_qid end, ',' order by object_qid), '') as made,
coalesce(string_agg(case when property_id = 'P501' then object_qid end, ',' order by object_qid), '') as uses from customer left join truthy on subject_qid = 'Q' || cast(1000000 + c_custkey as string) group by 1"""
)
def apply_declared_relationships(spark, sf_dir):
    edges = claims.truthy_edges(bound(spark, sf_dir, "claims"))
    mapping = spark.createDataFrame([("P500", "made"), ("P501", "uses")], "property_id string, field string")
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("Q"), (F.col("c_custkey") + 1000000).cast("string")).alias("qid"))
    return claims.apply_declared_relationships(own, edges, mapping).select("qid", joined("made"), joined("uses"))


@query(
    "with recursive " + sql("claims classes", "")[5:].rstrip()
    + ", reach(root, node) as (select node, node from classes union select reach.root, claims.subject from reach join claims on claims.value = reach.node and claims.property = 'P279') "
    "select distinct claims.subject as item, reach.root as matched_class from claims join reach on claims.value = reach.node where claims.property = 'P31'"
)
def instances_of(spark, sf_dir):
    return claims.instances_of(bound(spark, sf_dir, "claims"), bound(spark, sf_dir, "classes"))


@query(sql("claims", """select subject as item, coalesce(string_agg(distinct case when property = 'P31' then value end, ',' order by case when property = 'P31' then value end), '') as types,
coalesce(string_agg(distinct case when property in ('P500', 'P501') then value end, ',' order by case when property in ('P500', 'P501') then value end), '') as creators from claims where try_cast(substr(subject, 2) as bigint) >= 1000000 group by 1"""))
def optional_properties(spark, sf_dir):
    own = bound(spark, sf_dir, "claims")
    items = own.select(F.col("subject").alias("item")).filter("try_cast(substr(item, 2) as bigint) >= 1000000").distinct()
    return claims.optional_properties(items, own, {"types": ["P31"], "creators": ["P500", "P501"]}).select("item", joined("types"), joined("creators"))


BEST = "case lang when 'en' then 0 when 'mul' then 1 else 2 end"


@query(sql("entities terms", f"""select qid, coalesce((select text from (select text, row_number() over (order by {BEST}, text) as n from terms where terms.entity = entities.qid and kind = 'label') where n = 1), qid) as label from entities"""))
def resolve_labels(spark, sf_dir):
    return claims.resolve_labels(bound(spark, sf_dir, "entities"), bound(spark, sf_dir, "terms"))


@query(sql("entities terms", f", best as (select entity, text, row_number() over (partition by entity order by {BEST}, text) as n from terms where kind = 'description' and lang in ('en', 'mul')) select qid, text as description from entities left join best on qid = entity and n = 1").replace(") , best", "), best"))
def resolve_descriptions(spark, sf_dir):
    return claims.resolve_descriptions(bound(spark, sf_dir, "entities"), bound(spark, sf_dir, "terms"))


@query(sql("entities terms", "select qid, coalesce(string_agg(distinct text, ',' order by text), '') as aliases from entities left join terms on qid = entity and kind = 'alias' and lang = 'en' group by 1"))
def resolve_aliases(spark, sf_dir):
    return claims.resolve_aliases(bound(spark, sf_dir, "entities"), bound(spark, sf_dir, "terms")).select("qid", joined("aliases"))


@query(sql("claims", "select subject as qid, bool_or(property = 'P31' and value = 'Q105') as is_human from claims where try_cast(substr(subject, 2) as bigint) >= 1000000 group by 1"))
def human_creators(spark, sf_dir):
    own = bound(spark, sf_dir, "claims")
    return claims.human_creators(own.filter("try_cast(substr(subject, 2) as bigint) >= 1000000").select(F.col("subject").alias("qid")).distinct(), own, human="Q105")


@query(sql("claims", "select subject as qid, min(case when property = 'P500' then 'https://a/' || value end) as a, min(case when property = 'P501' then 'https://b/' || value end) as b from claims where property in ('P500', 'P501') group by 1"))
def person_identifiers(spark, sf_dir):
    own = bound(spark, sf_dir, "claims")
    humans = own.select(F.col("subject").alias("qid")).distinct()
    return claims.person_identifiers(humans, own, {"a": ("P500", "https://a/"), "b": ("P501", "https://b/")})


# ---- records


@query("""select 'C' || cast(o_custkey as string) as item, min(o_orderpriority) as description, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as types,
string_agg(distinct cast(cast(o_orderdate as date) as string), ',' order by cast(cast(o_orderdate as date) as string)) as homepages from orders group by 1""")
def build_resource_records(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit(" C"), F.col("o_custkey").cast("string")).alias("item"), F.col("o_orderpriority").alias("description"), "o_orderstatus", F.to_date("o_orderdate").cast("string").alias("day")
    )
    return records.build_resource_records(rows, {"types": "o_orderstatus", "homepages": "day"}).select("item", "description", joined("types"), joined("homepages"))


@query("""select 'Q' || cast(o_custkey as string) as qid, string_agg(distinct 'Q' || cast(o_orderkey % 6 as string), ',' order by 'Q' || cast(o_orderkey % 6 as string)) as types,
coalesce(string_agg(distinct case when o_orderkey % 3 = 0 then 'Q' || cast(o_custkey // 2 as string) end, ',' order by case when o_orderkey % 3 = 0 then 'Q' || cast(o_custkey // 2 as string) end), '') as parents from orders group by 1""")
def candidate_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("qid", joined("types"), joined("parents"))


def _facts(spark, sf_dir):
    c = F.col
    iri = lambda k: F.concat(F.lit("http://www.wikidata.org/entity/Q"), k.cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        iri(c("o_custkey")).alias("item"), iri(c("o_orderkey") % 6).alias("type"), F.when(c("o_orderkey") % 3 == 0, iri(F.floor(c("o_custkey") / 2))).alias("parent")
    )
    return records.candidate_facts(rows)


@query(sql("versions", """, best as (select item, version, pub_date, row_number() over (partition by item order by case when pub_date is null then 1 else 0 end, pub_date desc, version desc) as n from versions)
select item, version, cast(pub_date as date) as release_date from best where n = 1""").replace(") , best", "), best"))
def latest_version(spark, sf_dir):
    return records.latest_version(bound(spark, sf_dir, "versions"))


ELIGIBLE = """with recursive facts as (select o_custkey as k, 'Q' || cast(o_custkey as string) as qid, bool_or(o_orderkey % 6 = 3) as marked, bool_or(o_orderkey % 3 = 0) as has_parent from orders group by o_custkey),
linked as (select f.*, case when f.has_parent then p.k end as parent from facts f left join facts p on p.k = f.k // 2),
decided as (select k, qid, case when k % 50 = 7 then 'declared' when k % 50 = 9 then 'exception' when not marked then 'unmarked' else 'orphan' end as reason from linked where k % 50 in (7, 9) or not marked or parent is null
  union all select l.k, l.qid, case when d.reason in ('exception', 'unmarked', 'orphan') then 'rule' else 'orphan' end from linked l join decided d on l.parent = d.k where l.k % 50 not in (7, 9) and l.marked and l.k <> d.k),
verdicts as (select f.qid, case when d.reason is null then null else d.reason in ('exception', 'unmarked', 'orphan') end as eligible, coalesce(d.reason, 'cycle') as reason from facts f left join decided d on d.k = f.k)"""


@query(ELIGIBLE + " select qid, eligible, reason from verdicts")
def eligible_records(spark, sf_dir):
    facts = _facts(spark, sf_dir).withColumn("k", F.substring("qid", 2, 20).cast("bigint"))
    few = lambda cond: facts.filter(cond).select("qid")
    return records.eligible_records(facts.drop("k"), ["Q3"], few("k % 50 = 7"), few("k % 50 = 9"))


@query(ELIGIBLE + " select qid from verdicts where eligible")
def filter_eligible(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return records.filter_eligible(facts.select("qid"), eligible_records(spark, sf_dir))


@query(sql("slugs_in registry", """, named as (select *, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') as plain from slugs_in s where not exists (select 1 from registry r where r.dataset = s.dataset and r.qid = s.qid)),
ranked as (select *, row_number() over (partition by dataset, plain order by lower(label), item_iri) as n from named)
select dataset, qid, slug from registry union all select dataset, qid, case when n = 1 and not exists (select 1 from registry r where r.dataset = ranked.dataset and r.slug = ranked.plain) then plain else plain || '-' || lower(qid) end from ranked""").replace(") , named", "), named"))
def assign_slugs(spark, sf_dir):
    return records.assign_slugs(bound(spark, sf_dir, "slugs_in"), bound(spark, sf_dir, "registry"))




@query(sql("slugs_in assigned vocab", "select s.dataset, s.qid, a.concept_iri, case when v.iri is null then 'missing' else 'set' end as state from slugs_in s left join assigned a on s.qid = a.qid left join vocab v on v.iri = a.concept_iri").replace("a.concept_iri, case", "case when v.iri is null then null else a.concept_iri end as concept_iri, case"))
def apply_curated(spark, sf_dir):
    done, missing = records.apply_curated(bound(spark, sf_dir, "slugs_in"), bound(spark, sf_dir, "assigned"), bound(spark, sf_dir, "vocab"))
    rest = missing.select("dataset", "qid", F.lit(None).cast("string").alias("concept_iri"), F.lit("missing").alias("state"))
    return done.select("dataset", "qid", "concept_iri", F.lit("set").alias("state")).unionByName(rest)


@query(sql("assigned registry", "select a.dataset, a.qid, coalesce('https://catalog.example/' || a.dataset || '/' || slug || '/', 'http://www.wikidata.org/entity/' || a.qid) as subject from assigned a left join registry r on a.dataset = r.dataset and a.qid = r.qid"))
def curated_subjects(spark, sf_dir):
    return records.curated_subjects(bound(spark, sf_dir, "assigned"), bound(spark, sf_dir, "registry"), "https://catalog.example")


@query(sql("assigned vocab", "select qid, label, sort_order from assigned join vocab on iri = concept_iri"))
def classification_projection(spark, sf_dir):
    return records.classification_projection(bound(spark, sf_dir, "assigned"), bound(spark, sf_dir, "vocab"))


@query(sql("items", "select qid, title from items"))
def ordered_items(spark, sf_dir):
    return records.ordered_items(bound(spark, sf_dir, "items")).select("qid", "title")


@query("select 'C' || cast(o_custkey as string) as item, min(o_orderstatus) as types from orders group by 1")
def first_homepage(spark, sf_dir):
    """W12"""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("item")).agg(F.collect_set("o_orderstatus").alias("types"))
    return records.single_values(rows, ["types"])


@query(sql("members", "select qid, string_agg(distinct catalog, ',' order by catalog) as catalogs from members group by 1"))
def raw_cohort(spark, sf_dir):
    own = bound(spark, sf_dir, "members")
    return records.raw_cohort(*((c, own.filter(F.col("catalog") == c)) for c in ("people", "papers", "things"))).select("qid", joined("catalogs"))


# ---- related records


@query(sql("features", """select kind, key, count(distinct subject) as degree, exists (select 1 from features e where e.kind = 'entity' and e.key = f.key) as cataloged from features f where kind in ('parent', 'source_type') group by kind, key"""))
def similarity_context(spark, sf_dir):
    return related.similarity_context(bound(spark, sf_dir, "features"))


EVIDENCE = sql("features", "").rstrip() + """, degrees as (select kind, key, count(distinct subject) as degree from features where kind in ('parent', 'source_type') group by kind, key),
usable as (select kind, key from degrees where (kind = 'parent' and degree <= 6 and key in (select key from features where kind = 'entity')) or (kind = 'source_type' and degree between 2 and 6)),
keyed as (select * from features where kind in ('creator', 'repository', 'namespace') union all select f.* from features f join usable using (kind, key)),
direct as (select a.dataset, a.subject as x, b.subject as y, a.kind, a.subject || case a.kind when 'parent' then ' isPartOf ' else ' uses ' end || b.subject as said
  from features a join features b on a.dataset = b.dataset and a.key = b.key and b.kind = 'entity' where a.kind in ('parent', 'uses') and a.subject <> b.subject),
evidence as (select a.dataset, a.subject, b.subject as candidate, case a.kind when 'creator' then 'shared_creator' when 'repository' then 'same_repository' when 'namespace' then 'same_namespace_family' when 'parent' then 'shared_parent' else 'shared_source_type' end as feature, a.key as evidence
  from keyed a join keyed b on a.dataset = b.dataset and a.kind = b.kind and a.key = b.key and a.subject <> b.subject
  union select dataset, x, y, case kind when 'parent' then 'direct_relationship' else 'direct_uses' end, said from direct
  union select dataset, y, x, case kind when 'parent' then 'direct_relationship' else 'direct_uses' end, said from direct)"""
SCORED = EVIDENCE + """, strong as (select dataset, subject, candidate, sum(case feature when 'direct_relationship' then 120 when 'direct_uses' then 120 when 'shared_parent' then 100 when 'shared_source_type' then 65 when 'same_repository' then 90 when 'same_namespace_family' then 70 else 55 end) as points,
  string_agg(feature, ',' order by feature) as reasons from (select distinct dataset, subject, candidate, feature from evidence) group by 1, 2, 3),
weak as (select s.dataset, s.subject, s.candidate, f.kind, count(*) as common from strong s join features f on f.dataset = s.dataset and f.subject = s.subject join features g on g.dataset = s.dataset and g.subject = s.candidate and g.kind = f.kind and g.key = f.key where f.kind in ('category', 'license') group by 1, 2, 3, 4),
tokens as (select dataset, subject, list(key) as t from features where kind = 'token' group by 1, 2),
texts as (select s.dataset, s.subject, s.candidate, len(list_intersect(a.t, b.t)) as common, len(list_distinct(list_concat(a.t, b.t))) as together from strong s join tokens a on a.dataset = s.dataset and a.subject = s.subject join tokens b on b.dataset = s.dataset and b.subject = s.candidate),
scored as (select s.dataset, s.subject, s.candidate, reasons, cast(points + coalesce((select sum(case kind when 'category' then 4 else 2 end) from weak w where w.dataset = s.dataset and w.subject = s.subject and w.candidate = s.candidate), 0)
  + coalesce((select case when common >= 2 and common * 1.0 / together >= 0.25 then 3 else 0 end from texts x where x.dataset = s.dataset and x.subject = s.subject and x.candidate = s.candidate), 0) as bigint) as score from strong s)"""


def _scored(spark, sf_dir):
    features = written(bound(spark, sf_dir, "features"), "features")
    context = related.similarity_context(features)
    return features, context, related.score_pairs(features, context)


def _best(spark, sf_dir):
    features = written(bound(spark, sf_dir, "features"), "features")
    return related.best_related(features, related.similarity_context(features))


def _flat():
    return F.array_join(F.array_sort("reasons"), ",").alias("reasons")


@query(EVIDENCE + " select distinct dataset, subject, candidate from evidence")
def related_candidates(spark, sf_dir):
    features = written(bound(spark, sf_dir, "features"), "features")
    return related.related_candidates(features, related.similarity_context(features))


@query(SCORED + " select dataset, subject, candidate, reasons, score, score >= 60 as qualifies from scored")
def score_pairs(spark, sf_dir):
    _, _, scored = _scored(spark, sf_dir)
    return scored.select("dataset", "subject", "candidate", F.col("reason_text").alias("reasons"), F.col("score").cast("bigint").alias("score"), "qualifies")


TOP = SCORED + ", ranked as (select *, row_number() over (partition by dataset, subject order by score desc, candidate) as rank from scored where score >= 60), top as (select * from ranked where rank <= 5)"


@query(TOP + " select dataset, subject, candidate, reasons, score, rank from top")
def related_top_k(spark, sf_dir):
    return _best(spark, sf_dir).select("dataset", "subject", "candidate", _flat(), F.col("score").cast("bigint").alias("score"), "rank")


@query(
    TOP + """ select dataset, 'candidate_resources' as measure, cast(null as string) as name, count(distinct subject) as value from features where kind = 'entity' group by 1
union all select dataset, 'structural_candidates', null, count(*) from scored group by 1 union all select dataset, 'below_threshold', null, count(*) filter (score < 60) from scored group by 1
union all select dataset, 'selected', null, count(*) from top group by 1
union all select dataset, 'suppressed_parent', key, degree from (select distinct dataset, kind, key from features) join degrees using (kind, key) where kind = 'parent' and (degree > 6 or key not in (select key from features where kind = 'entity'))
union all select dataset, 'suppressed_source_type', key, degree from (select distinct dataset, kind, key from features) join degrees using (kind, key) where kind = 'source_type' and degree > 6
union all select dataset, 'reason', r, count(*) from (select dataset, unnest(string_split(reasons, ',')) as r from top) group by 1, 3"""
)
def related_diagnostics(spark, sf_dir):
    features = written(bound(spark, sf_dir, "features"), "features")
    context = written(related.similarity_context(features), "context")
    best = written(related.best_related(features, context).drop("components"), "best")
    return related.related_diagnostics(related.pair_counts(features, context), best, features, context)


STOPS = "('about', 'data', 'from', 'graph', 'knowledge', 'ontology', 'resource', 'semantic', 'software', 'that', 'this', 'tool', 'using', 'vocabulary', 'with')"
OWN_FEATURES = sql("items", "").rstrip() + f""", usable as (select *, canonicalUrl as subject from items where homepage is not null)
select distinct dataset, subject, kind, key from (
select dataset, subject, 'entity' as kind, wikidataId as key from usable union all select dataset, subject, 'category', p_type from usable
union all select dataset, subject, 'license', 'L' || cast(p_size % 3 as string) from usable where p_partkey % 4 <> 0
union all select dataset, subject, 'language', case p_partkey % 3 when 0 then 'java' when 1 then 'rust' else 'c' end from usable
union all select dataset, subject, 'repository', 'https://github.com/' || replace(p_brand, '#', '-') || '/r' || cast(p_partkey % 50 as string) from usable where p_partkey % 5 <> 0 and p_partkey % 3 = 0
union all select dataset, subject, 'namespace', 'http://ns.example.org/' || replace(p_brand, '#', '-') || '/s' || cast(p_size as string) from usable
union all select dataset, subject, 'token', key from (select dataset, subject, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || description), '[a-z0-9]+')) as key from usable) where length(key) >= 4 and key not in {STOPS}) """


@query(OWN_FEATURES)
def extract_features(spark, sf_dir):
    from .bindings import catalog_items

    items = catalog_items(spark, sf_dir)
    named = items.withColumns({"repositories": F.array("sourceRepo"), "namespaces": F.array("namespaceURI"), "languages": F.col("programmingLanguages"), "categories": F.array("category")})
    return related.extract_features(named)


@query(TOP + """, named as (select t.dataset, t.subject, lower(p_name || ' ' || cast(p_partkey as string)) as fold, p_name || ' ' || cast(p_partkey as string) as title, 'u' || cast(p_partkey as string) as url from top t join part on t.candidate = 'p' || cast(p_partkey as string) where p_partkey % 13 <> 0)
select dataset, subject, string_agg(title || '=' || url, ',' order by fold, url) as tools from named group by 1, 2""")
def related_projection(spark, sf_dir):
    items = bound(spark, sf_dir, "items").select("dataset", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("subject"), "title", F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("canonicalUrl"))
    out = related.related_projection(_best(spark, sf_dir), items)
    return out.select("dataset", "subject", F.array_join(F.transform("relatedTools", lambda t: F.concat(t["title"], F.lit("="), t["canonicalUrl"])), ",").alias("tools"))


@query(TOP + """, needed as (select 'Q' || cast(p_partkey as string) as subject_qid, 'uses' as property_id, 'Q' || cast(p_partkey + 2 as string) as object_qid, p_partkey from part where p_partkey % 50 < 25 and p_partkey + 2 <= (select max(p_partkey) from part))
select subject_qid, property_id, object_qid from needed where p_partkey % 3 = 0 and not exists (select 1 from top where subject = 'p' || cast(p_partkey as string) and candidate = 'p' || cast(p_partkey + 2 as string))""")
def verify_exemplars(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("Q"), c.cast("string"))
    exemplars = part.filter(k % 50 < 25).select(name(k).alias("subject_qid"), F.lit("uses").alias("property_id"), name(k + 2).alias("object_qid"))
    edges = part.filter(k % 3 == 0).select(name(k).alias("subject_qid"), F.lit("uses").alias("property_id"), name(k + 2).alias("object_qid"))
    own = part.select(name(k).alias("qid"), F.concat(F.lit("p"), k.cast("string")).alias("subject"), F.lit("h").alias("homepage"))
    return related.verify_exemplars(_best(spark, sf_dir), exemplars, own, edges)


# ---- profiles

COHORT = sql("members edges", "").rstrip() + """, cohort as (select qid, list(distinct catalog) as catalogs from members group by 1),
own as (select e.*, a.catalogs as sc, b.catalogs as oc from (select distinct * from edges) e join cohort a on a.qid = subject_qid join cohort b on b.qid = object_qid)"""


def _cohort(spark, sf_dir):
    return bound(spark, sf_dir, "members").groupBy("qid").agg(F.collect_set("catalog").alias("catalogs"))


@query(
    COHORT + """, outs as (select property_id, subject_qid, count(*) as degree from own group by 1, 2), ins as (select property_id, object_qid, count(*) as degree from own group by 1, 2),
o as (select property_id, count(*) as unique_subjects, min(degree) as out_min, quantile_disc(degree, 0.5) as out_median, quantile_disc(degree, 0.95) as out_p95, max(degree) as out_max, round(avg(degree), 6) as out_mean from outs group by 1),
i as (select property_id, count(*) as unique_objects, min(degree) as in_min, quantile_disc(degree, 0.5) as in_median, quantile_disc(degree, 0.95) as in_p95, max(degree) as in_max, round(avg(degree), 6) as in_mean from ins group by 1),
u as (select property_id, count(*) as unique_records from (select property_id, subject_qid as q from own union select property_id, object_qid from own) group by 1),
x as (select property_id, string_agg(subject_qid || '>' || object_qid, ',' order by subject_qid || '>' || object_qid) as examples from (select *, row_number() over (partition by property_id order by subject_qid, object_qid) as n from own) where n <= 5 group by 1),
t as (select property_id, count(*) as edges, count(*) filter (list_has_any(sc, oc)) as same_catalog, count(*) filter (not list_has_any(sc, oc)) as cross_catalog from own group by 1)
select * from t join o using (property_id) join i using (property_id) join u using (property_id) join x using (property_id)"""
)
def predicate_profile(spark, sf_dir):
    return profile.predicate_profile(bound(spark, sf_dir, "edges"), _cohort(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))


@query(COHORT + """ select property_id, catalog, count(distinct subject_qid) as subjects, round(count(distinct subject_qid) * 1.0 / max(m), 6) as share from (select property_id, subject_qid, unnest(sc) as catalog from own) join (select catalog, count(distinct qid) as m from members group by 1) using (catalog) group by 1, 2""")
def subject_coverage(spark, sf_dir):
    return profile.subject_coverage(bound(spark, sf_dir, "edges"), _cohort(spark, sf_dir))


@query("""select min(n) as min, quantile_disc(n, 0.5) as median, quantile_disc(n, 0.95) as p95, max(n) as max, round(avg(n), 6) as mean from (select o_custkey, count(*) as n from orders group by 1)""")
def degree_summary(spark, sf_dir):
    return profile.degree_summary(spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("degree")))


REVIEWED = sql("edges members", "").rstrip() + """, mine as (select distinct e.* from edges e where subject_qid in (select qid from members) and property_id in ('ordered', 'part')),
degrees as (select property_id, subject_qid, count(*) as degree from mine group by 1, 2)"""


@query(REVIEWED + """ select 'ordered' as property_id, count(*) as subjects, sum(degree) as edges, min(degree) as min, quantile_disc(degree, 0.5) as median, quantile_disc(degree, 0.95) as p95, max(degree) as max, round(avg(degree), 6) as mean from degrees where property_id = 'ordered'
union all select 'part', count(*), sum(degree), min(degree), quantile_disc(degree, 0.5), quantile_disc(degree, 0.95), max(degree), round(avg(degree), 6) from degrees where property_id = 'part' union all select 'absent', 0, 0, 0, 0, 0, 0, 0.0""")
def reviewed_profile(spark, sf_dir):
    reviewed = spark.createDataFrame([("ordered",), ("part",), ("absent",)], "property_id string")
    return profile.reviewed_profile(bound(spark, sf_dir, "edges"), _cohort(spark, sf_dir), reviewed)[0]


@query(REVIEWED + """ select property_id, object_qid, degree, rank from (select property_id, object_qid, degree, row_number() over (partition by property_id order by degree desc, object_qid) as rank from (select property_id, object_qid, count(*) as degree from mine group by 1, 2)) where rank <= 20""")
def highest_degree(spark, sf_dir):
    reviewed = spark.createDataFrame([("ordered",), ("part",), ("absent",)], "property_id string")
    return profile.reviewed_profile(bound(spark, sf_dir, "edges"), _cohort(spark, sf_dir), reviewed)[1]


@query(COHORT + """ select catalog, count(distinct qid) as members, cast(null as string) as digest from members group by 1
union all select 'all', sum(n), sha256(string_agg(d, chr(10) order by part)) from (select substr(sha256(line), 1, 4) as part, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as d from (select qid || ':' || array_to_string(list_sort(catalogs), ',') as line from cohort) group by 1)""")
def cohort_summary(spark, sf_dir):
    return profile.cohort_summary(_cohort(spark, sf_dir))


# ---- audit


@query("""select 'Q' || cast(o_custkey as string) as qid, min(o_orderpriority) as label, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as types from orders group by 1""")
def capture_cohort(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("qid"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("string").alias("description"),
        F.col("o_orderstatus").alias("type"), *(F.lit(None).cast("string").alias(c) for c in ("parent", "website", "matched_class")),
    )
    return audit.capture_cohort(rows).select("qid", "label", joined("types"))


def _signalled(spark, sf_dir):
    c = F.col
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(
        F.concat(F.lit("Q"), (c("p_partkey") + 1000000).cast("string")).alias("qid"), F.when(c("p_partkey") % 7 == 0, F.lit("a property name")).otherwise(c("p_name")).alias("label"),
        F.when(c("p_partkey") % 5 == 0, F.lit("An ontology term of note")).otherwise(c("p_type")).alias("description"), F.array("p_brand").alias("types"), F.array(F.concat(F.lit("Q"), (c("p_size") % 4).cast("string"))).alias("matched_classes"),
        F.when(c("p_partkey") % 9 == 0, F.array(F.lit("Q1"))).otherwise(F.array().cast("array<string>")).alias("parents"), F.array(F.concat(F.lit("https://x/"), F.when(c("p_partkey") % 4 == 0, "#a").otherwise(""))).alias("websites"),
    )
    return audit.candidate_signals(rows, ["Brand#11", "Brand#1"], part.filter("p_partkey % 30 = 0").select(F.concat(F.lit("Q"), (c("p_partkey") + 1000000).cast("string")).alias("qid")))


SIGNALS = """concat_ws(',', case when p_partkey % 30 = 0 then 'confirmed-exclusion' end, case when p_brand in ('Brand#11', 'Brand#1') then 'direct-term-component-type' end,
case when p_partkey % 9 = 0 then 'direct-part-of' end, case when p_partkey % 4 = 0 then 'fragment-homepage' end, case when p_partkey % 5 = 0 then 'term-like-description' end, case when p_partkey % 7 = 0 then 'term-like-label' end)"""


@query(f"select 'Q' || cast(p_partkey + 1000000 as string) as qid, {SIGNALS} as signals from part")
def candidate_signals(spark, sf_dir):
    return _signalled(spark, sf_dir).select("qid", joined("signals"))


EDITS = sql("claim_edits intent_edits", "").rstrip() + """, met as (select qid, property, value, count(*) as n, min(guid) as guid from claim_edits group by 1, 2, 3),
resolved as (select i.qid, action, i.property, i.value, case when action = 'remove' and n = 1 then guid end as claim_guid,
case when action = 'remove' and coalesce(n, 0) <> 1 then 'removal without exactly one claim' when action = 'add' and coalesce(n, 0) > 0 then 'addition already there' end as error from intent_edits i left join met m on i.qid = m.qid and i.property = m.property and i.value = m.value)"""


@query(EDITS + " select * from resolved")
def resolve_edit_operations(spark, sf_dir):
    return audit.resolve_edit_operations(bound(spark, sf_dir, "claim_edits"), bound(spark, sf_dir, "intent_edits"))


@query(EDITS + """ select qid, guid, property, value, rank from claim_edits c where not exists (select 1 from resolved r where action = 'remove' and r.qid = c.qid and r.claim_guid = c.guid)
union all select qid, null, property, value, 'normal' from resolved where action = 'add' and error is null""")
def apply_edit_operations(spark, sf_dir):
    before = bound(spark, sf_dir, "claim_edits")
    return audit.apply_edit_operations(before, audit.resolve_edit_operations(before, bound(spark, sf_dir, "intent_edits")).filter("error is null"))


@query("select distinct 'Q' || cast(1000000 + o_custkey as string) as qid, true as matches from orders union select 'Q' || cast(1000000 + c_custkey as string), true from customer where c_custkey % 2 = 1 and (c_custkey % 4 = 3 or not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 3 = c_custkey % 4))")
def claims_match_proposal(spark, sf_dir):
    before = bound(spark, sf_dir, "claim_edits")
    proposed = audit.apply_edit_operations(before, audit.resolve_edit_operations(before, bound(spark, sf_dir, "intent_edits")).filter("error is null"))
    after = proposed.withColumn("guid", F.coalesce("guid", F.lit("new")))
    return audit.claims_match_proposal(after, proposed, before)


def _audit(spark, sf_dir):
    # Records and claims are dealt out alike, so what follows by record neither grows with a file nor is dealt again.
    before = bound(spark, sf_dir, "claim_edits")
    parts = max(1, -(-before.count() // ROWS))
    before, signalled = before.repartition(parts, "qid"), _signalled(spark, sf_dir).repartition(parts, "qid")
    n = F.substring("qid", 2, 20).cast("bigint") - 1000000
    intent = signalled.filter(n % 10 == 3).select("qid", F.lit("edit").alias("decision"), F.lit("because").alias("rationale"), F.array(F.lit("https://e.example/1")).alias("evidence_urls"))
    operations = bound(spark, sf_dir, "intent_edits").join(intent.select("qid"), "qid", "left_semi")
    planned = audit.build_audit(signalled, before, intent, operations, signalled.select("qid", (n * 10 + 1).alias("revision")))
    kind = F.floor(n / 100) % 4
    left = F.transform("proposed_claims", lambda c: F.struct(c["property"].alias("property"), c["value"].alias("value"), F.when(c["guid"] == "", "new").otherwise(c["guid"]).alias("guid"), c["rank"].alias("rank")))
    made = planned.filter((n % 100 == 23) & (F.col("status") == "planned")).select(
        "qid", F.when(kind == 2, F.array().cast(audit.CLAIM_LIST)).otherwise(left).alias("claims"), (F.col("old_revision") + F.when(kind == 1, 0).otherwise(1)).alias("revision")
    )
    return signalled, intent, audit.record_edits(planned, made)


AUDIT = EDITS + f""", signalled as (select p_partkey as n, p_partkey // 100 % 4 as kind, 'Q' || cast(p_partkey + 1000000 as string) as qid, case when p_partkey % 7 = 0 then 'a property name' else p_name end as label, {SIGNALS} as signals, 'Q' || cast(p_size % 4 as string) as classes from part),
mine as (select r.* from resolved r join signalled s on s.qid = r.qid where n % 10 = 3),
proposed as (select qid, guid, property, value, rank from claim_edits c where not exists (select 1 from mine where error is null and action = 'remove' and mine.qid = c.qid and claim_guid = c.guid) union all select qid, '', property, value, 'normal' from mine where error is null and action = 'add'),
b as (select qid, string_agg(property || '|' || value || '|' || guid || '|' || rank, ',' order by property, value, guid) as before_claims from claim_edits group by 1),
p as (select qid, string_agg(property || '|' || value || '|' || guid || '|' || rank, ',' order by property, value, guid) as proposed_claims, string_agg(property || '|' || value || '|' || case guid when '' then 'new' else guid end || '|' || rank, ',' order by property, value, guid) as after_claims from proposed group by 1),
audits as (select n, kind, s.qid, label, signals, case when n % 10 = 3 then 'edit' when n % 30 = 0 then 'exclude-locally' else 'retain' end as decision, case when n % 100 = 23 then 'executed' when n % 10 = 3 then 'planned' else 'no-edit' end as status,
  case when n % 10 = 3 then 'because' when n % 30 = 0 then 'Exclude locally after source review against source class match(es) ' || classes || '. The reviewed record is not a standalone {audit.STANDALONE}. No additional Wikidata claim change is proposed.'
  else 'Retain after review against source class match(es) ' || classes || ': ' || coalesce(nullif(concat_ws('; ', case when n % 9 = 0 then '{audit.OBSERVATIONS[("direct-part-of",)]}' end, case when n % 4 = 0 then '{audit.OBSERVATIONS[("fragment-homepage",)]}' end,
    case when n % 5 = 0 or n % 7 = 0 then '{audit.OBSERVATIONS[("term-like-description", "term-like-label")]}' end), ''), '{audit.NO_OBSERVATION}') || '. No Wikidata claim change is proposed.' end as rationale,
  action || '|' || m.property || '|' || m.value || '|' || coalesce(claim_guid, '') as operations, cast(case when error is null then 0 else 1 end as bigint) as edit_errors, before_claims, proposed_claims,
  concat_ws(',', case when n % 10 = 3 then 'https://e.example/1' end, 'https://www.wikidata.org/wiki/' || s.qid, case when n % 4 = 0 then 'https://x/#a' else 'https://x/' end) as evidence_urls, n * 10 + 1 as old_revision,
  case when n % 100 = 23 then case when kind = 2 then '' else after_claims end end as after_claims, case when n % 100 = 23 then n * 10 + case when kind = 1 then 1 else 2 end end as new_revision
  from signalled s left join mine m on m.qid = s.qid left join b on b.qid = s.qid left join p on p.qid = s.qid where signals <> '')"""


def _lines(column: str, *fields: str) -> F.Column:
    return F.array_join(F.transform(column, lambda c: F.concat_ws("|", *(F.coalesce(c[f], F.lit("")) for f in fields))), ",").alias(column)


@query(AUDIT + " select * exclude (n, kind), 'https://www.wikidata.org/w/index.php?title=' || qid || '&diff=' || cast(new_revision as string) || '&oldid=' || cast(old_revision as string) as diff_url from audits")
def build_audit(spark, sf_dir):
    lists = {c: _lines(c, "property", "value", "guid", "rank") for c in ("before_claims", "proposed_claims", "after_claims")}
    lists |= {"operations": _lines("operations", "action", "property", "value", "claim_guid"), "signals": joined("signals"), "evidence_urls": joined("evidence_urls")}
    return _audit(spark, sf_dir)[2].withColumns(lists)


@query(AUDIT + " select case when done = 0 then 'review-first' when done = total then 'executed' else 'partially-executed' end as mode from (select count(*) filter (status = 'executed') as done from audits), (select count(*) as total from signalled where n % 10 = 3)")
def audit_mode(spark, sf_dir):
    _, intent, rows = _audit(spark, sf_dir)
    return audit.audit_mode(rows, intent)


@query(AUDIT + """, held as (select * from audits where n % 10 <> 5)
select 'candidate-missing' as code, qid as subject from audits where n % 10 = 5 union all select 'intent-missing', qid from signalled where n % 10 = 3 and signals = '' union all select 'operation-unresolved', qid from held where edit_errors > 0
union all select 'planned-state', qid from held where status = 'planned' and operations is null union all select 'revision-evidence-missing', qid from held where status = 'executed' and after_claims is null
union all select 'revision-not-advanced', qid from held where status = 'executed' and kind = 1 union all select 'diff-url-differs', qid from held where status = 'executed' and kind = 3
union all select 'after-claims-differ', qid from held where status = 'executed' and kind = 2 and proposed_claims is not null""")
def audit_checks(spark, sf_dir):
    signalled, intent, rows = _audit(spark, sf_dir)
    n = F.substring("qid", 2, 20).cast("bigint") - 1000000
    changed = rows.withColumn("diff_url", F.when((n % 100 == 23) & (F.floor(n / 100) % 4 == 3), "https://else.example/").otherwise(F.col("diff_url")))
    return audit.audit_checks(changed.filter(n % 10 != 5), signalled, intent)


def _first_letter(batch):
    return {q: t[:1].upper() for q, t in batch if t}


@query("select 'Q' || cast(p_partkey as string) as qid, upper(substr(p_name, 1, 1)) as answer, upper(substr(p_name, 1, 1)) in ('A', 'B', 'C', 'S') as accepted from part")
def classify_missing(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), F.col("p_name").alias("text"))
    vocab = spark.createDataFrame([("A",), ("B",), ("C",), ("S",)], "label string")
    return audit.classify_missing(items, vocab, _first_letter).select("qid", "answer", "accepted")
