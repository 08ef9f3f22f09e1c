"""Degree statistics and coverage of a graph's edges.  Tables: ``edges(subject_qid, property_id, object_qid)``, ``cohort(qid, catalogs)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lines_digest
from ..session import written


def degree_aggregates(column: str, prefix: str = "") -> list[Column]:
    """Min, nearest-rank median and 95th percentile, max, and mean to six places; zeros without rows."""
    found = {
        "min": F.min(column), "median": F.expr(f"percentile_disc(0.5) within group (order by {column})"), "p95": F.expr(f"percentile_disc(0.95) within group (order by {column})"),
        "max": F.max(column), "mean": F.round(F.avg(column), 6),
    }
    return [F.coalesce(v.cast("double") if k == "mean" else v.cast("bigint"), F.lit(0)).alias(prefix + k) for k, v in found.items()]


def degree_summary(counts: DataFrame, column: str = "degree") -> DataFrame:
    """A7 over a whole table of degrees."""
    return counts.agg(*degree_aggregates(column))


def in_cohort(edges: DataFrame, cohort: DataFrame) -> DataFrame:
    """Edges with both ends in the cohort, and the catalogs of each end."""
    left = cohort.select(F.col("qid").alias("subject_qid"), F.col("catalogs").alias("subject_catalogs"))
    right = cohort.select(F.col("qid").alias("object_qid"), F.col("catalogs").alias("object_catalogs"))
    return leaving(edges, cohort).join(left.hint("merge"), "subject_qid").join(right.hint("merge"), "object_qid")


def leaving(edges: DataFrame, cohort: DataFrame) -> DataFrame:
    """Distinct edges whose subject is in the cohort.

    Edges are dealt out by subject once: the distinct after the join needs no other shuffle, as equal edges have met by then.  A cohort grows with its records, so it is merged at every size and never sent to all executors.
    """
    return edges.join(cohort.select(F.col("qid").alias("subject_qid")).hint("merge"), "subject_qid", "left_semi").distinct()


def predicate_profile(edges: DataFrame, cohort: DataFrame, examples: int = 5) -> DataFrame:
    """A row for each property: edges, same- and cross-catalog edges, distinct ends, degree statistics both ways, and a few examples.

    Edges inside the cohort are found and written once.  Degrees are counted first per (property, subject) and (property, object), so a property with most of the edges is many rows until the last step.
    """
    own = written(in_cohort(edges, cohort).withColumn("same", F.arrays_overlap("subject_catalogs", "object_catalogs")).select("property_id", "subject_qid", "object_qid", "same"), "profile")
    out = written(own.groupBy("property_id", "subject_qid").agg(F.count("*").alias("degree"), F.count_if("same").alias("same")), "degrees")
    into = written(own.groupBy("property_id", "object_qid").agg(F.count("*").alias("degree")), "degrees")
    totals = out.groupBy("property_id").agg(F.sum("degree").alias("edges"), F.sum("same").alias("same_catalog"), F.sum(F.col("degree") - F.col("same")).alias("cross_catalog"))
    outs = out.groupBy("property_id").agg(F.count("*").alias("unique_subjects"), *degree_aggregates("degree", "out_"))
    ins = into.groupBy("property_id").agg(F.count("*").alias("unique_objects"), *degree_aggregates("degree", "in_"))
    ends = out.select("property_id", F.col("subject_qid").alias("qid")).union(into.select("property_id", "object_qid")).distinct().groupBy("property_id").agg(F.count("*").alias("unique_records"))
    best = Window.partitionBy("property_id").orderBy("subject_qid", "object_qid")
    few = own.select("property_id", "subject_qid", "object_qid").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= examples)
    shown = few.groupBy("property_id").agg(F.array_sort(F.collect_list(F.concat_ws(">", "subject_qid", "object_qid"))).alias("examples"))
    joined = totals
    for part in (outs, ins, ends, shown):
        joined = joined.join(part, "property_id")
    return joined


def subject_coverage(edges: DataFrame, cohort: DataFrame) -> DataFrame:
    """``property_id, catalog, subjects, share`` of each catalog's members that have the property."""
    size = cohort.select(F.explode("catalogs").alias("catalog")).groupBy("catalog").agg(F.count("*").alias("members"))
    having = in_cohort(edges, cohort).select("property_id", "subject_qid", F.explode("subject_catalogs").alias("catalog")).distinct()
    return having.groupBy("property_id", "catalog").agg(F.count("*").alias("subjects")).join(size, "catalog").select("property_id", "catalog", "subjects", F.round(F.col("subjects") / F.col("members"), 6).alias("share"))


def highest_degree(degrees: DataFrame, k: int = 20, by: str = "property_id") -> DataFrame:
    """Of each ``by`` the ``k`` objects of the highest degree, ties by id."""
    best = Window.partitionBy(by).orderBy(F.col("degree").desc(), "object_qid")
    return degrees.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def reviewed_profile(edges: DataFrame, cohort: DataFrame, reviewed: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Statistics of the cohort's outgoing edges for each reviewed property (zeros without edges), and its objects of the highest degree."""
    own = leaving(edges.join(F.broadcast(reviewed.select("property_id")), "property_id", "left_semi"), cohort)
    objects = own.groupBy("property_id", "object_qid").agg(F.count("*").alias("degree"))
    out = own.groupBy("property_id", "subject_qid").agg(F.count("*").alias("degree")).groupBy("property_id").agg(F.sum("degree").alias("edges"), F.count("*").alias("subjects"), *degree_aggregates("degree"))
    stats = reviewed.select("property_id").join(out, "property_id", "left").na.fill(0)
    return stats, highest_degree(objects, k)


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """Members of each catalog, of all, and a digest of the sorted ``qid:catalogs`` lines (``lines_digest``)."""
    each = cohort.select(F.explode("catalogs").alias("catalog")).groupBy("catalog").agg(F.count("*").alias("members"))
    whole = lines_digest(cohort.select(F.concat_ws(":", "qid", F.array_join(F.array_sort("catalogs"), ",")).alias("line")))
    return each.select("catalog", "members", F.lit(None).cast("string").alias("digest")).unionByName(whole.select(F.lit("all").alias("catalog"), F.col("lines").alias("members"), "digest"))
