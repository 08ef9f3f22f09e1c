"""Claim extraction: pattern queries over entity, property and value, with labels and descriptions.

Tables: ``claims(subject, property, rank, datatype, value, guid)``, ``terms(entity, kind, lang, text)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present
from ..session import written

ITEM = "wikibase-item"


def truthy_edges(claims: DataFrame) -> DataFrame:
    """Per subject and property the preferred statements, or the normal ones if none is; of those, the item-valued ones, as a set."""
    own = Window.partitionBy("subject", "property")
    best = F.max(F.col("rank") == "preferred").over(own)
    ranked = claims.withColumn("_best", best).filter(F.when(F.col("_best"), F.col("rank") == "preferred").otherwise(F.col("rank") == "normal"))
    items = ranked.filter((F.col("datatype") == ITEM) & F.col("value").isNotNull())
    return items.select(F.col("subject").alias("subject_qid"), F.col("property").alias("property_id"), F.col("value").alias("object_qid")).distinct()


def apply_declared_relationships(records: DataFrame, edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds a sorted array for each reviewed field.  ``mapping(property_id, field)`` is a small table of declared predicates."""
    fields = [r.field for r in mapping.select("field").distinct().orderBy("field").collect()]
    found = edges.join(F.broadcast(mapping), "property_id")
    wide = found.groupBy("subject_qid").agg(*(F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("object_qid")))).alias(f) for f in fields))
    joined = records.join(wide, records["qid"] == wide["subject_qid"], "left").drop("subject_qid")
    return joined.withColumns({f: F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields})


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(root, node)``: every node that reaches a start over zero or more edges ``child, parent``, at any depth; cycles end by themselves.

    The frontier is joined with the edges, and only pairs not seen before go on; each round writes its new pairs to the shared folder.
    """
    frontier = written(start.select(F.col("node").alias("root"), "node").distinct(), "closure")
    paths, schema = [frontier._cairn_path], frontier.schema
    while True:
        seen = start.sparkSession.read.schema(schema).parquet(*paths)
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        frontier = written(step.join(seen, ["root", "node"], "left_anti"), "closure")
        if frontier.isEmpty():
            return seen
        paths.append(frontier._cairn_path)


def instances_of(claims: DataFrame, classes: DataFrame, instance: str = "P31", subclass: str = "P279") -> DataFrame:
    """Items whose class reaches one of ``classes(node)`` over zero or more subclass edges, with the class that matched."""
    up = claims.filter(F.col("property") == subclass).select(F.col("subject").alias("child"), F.col("value").alias("parent")).distinct()
    below = closure(up, classes)
    items = claims.filter(F.col("property") == instance).select(F.col("subject").alias("item"), F.col("value").alias("node")).distinct()
    return items.join(below, "node").select("item", F.col("root").alias("matched_class")).distinct()


def optional_properties(items: DataFrame, claims: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """A sorted array of distinct values for each field (a union of properties), empty where the item has none."""
    wanted = claims.filter(F.col("property").isin(sorted({p for ps in fields.values() for p in ps})))
    values = wanted.groupBy("subject").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("property").isin(ps), F.col("value")))).alias(name) for name, ps in fields.items())
    )
    joined = items.join(values, items["item"] == values["subject"], "left").drop("subject")
    return joined.withColumns({name: F.coalesce(F.col(name), F.array().cast("array<string>")) for name in fields})


def _text_by_language(terms: DataFrame, kind: str, languages: tuple[str, ...]) -> DataFrame:
    """The text of the first language that an entity has, other languages after those named; the smallest of several."""
    order = reduce(lambda rest, i: F.when(F.col("lang") == languages[i], i).otherwise(rest), reversed(range(len(languages))), F.lit(len(languages)))
    texts = terms.filter((F.col("kind") == kind) & present("text").isNotNull())
    return texts.groupBy("entity").agg(F.min(F.struct(order.alias("rank"), present("text").alias("text"))).alias("best")).select("entity", F.col("best.text").alias("text"), F.col("best.rank").alias("rank"))


def resolve_labels(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """``qid, label``: English, multilingual, any other language, else the id."""
    found = _text_by_language(terms, "label", ("en", "mul"))
    return entities.join(found, entities["qid"] == found["entity"], "left").select("qid", F.coalesce("text", "qid").alias("label"))


def resolve_descriptions(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """``qid, description``: English, else multilingual, else null."""
    found = _text_by_language(terms.filter(F.col("lang").isin("en", "mul")), "description", ("en", "mul"))
    return entities.join(found, entities["qid"] == found["entity"], "left").select("qid", F.col("text").alias("description"))


def resolve_aliases(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """``qid, aliases``: the sorted set of English alternate labels, never null."""
    found = terms.filter((F.col("kind") == "alias") & (F.col("lang") == "en")).groupBy("entity").agg(F.array_sort(F.collect_set(present("text"))).alias("aliases"))
    joined = entities.join(found, entities["qid"] == found["entity"], "left")
    return joined.select("qid", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def human_creators(creators: DataFrame, claims: DataFrame, human: str = "Q5", instance: str = "P31") -> DataFrame:
    """``qid, is_human``: instance of human itself; the rest are organizations."""
    humans = claims.filter((F.col("property") == instance) & (F.col("value") == human)).select(F.col("subject").alias("human_qid")).distinct()
    joined = creators.join(humans, creators["qid"] == humans["human_qid"], "left")
    return joined.select("qid", F.col("human_qid").isNotNull().alias("is_human"))


def person_identifiers(humans: DataFrame, claims: DataFrame, profiles: dict[str, tuple[str, str]]) -> DataFrame:
    """``qid`` and a url for each profile (name to property and url prefix), the smallest of several."""
    wanted = claims.filter(F.col("property").isin([p for p, _ in profiles.values()])).filter(present("value").isNotNull())
    urls = wanted.groupBy("subject").agg(
        *(F.min(F.when(F.col("property") == p, F.concat(F.lit(prefix), present("value")))).alias(name) for name, (p, prefix) in profiles.items())
    )
    return humans.join(urls, humans["qid"] == urls["subject"]).drop("subject")
