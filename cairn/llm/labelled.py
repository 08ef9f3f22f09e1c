"""Labelled rows for fitting and calibrating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_sample(labels: DataFrame, bound: int | None = None) -> DataFrame:
    """Documents with a quality label: ``doc_id, good, fold``; all of them, or ``bound`` at most, those of the smallest hashes.

    A document of several labels is good if all say so; rows without id or quality are left out.  Fold 0 fits, fold 1 calibrates.
    """
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    one = one.withColumn("h", F.xxhash64(F.lit("labelled"), "doc_id"))
    if bound is not None:
        one = one.orderBy("h", "doc_id").limit(bound)
    return one.select("doc_id", "good", F.pmod(F.col("h"), F.lit(2)).cast("int").alias("fold"))


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest value of a column, by counting into 4096 ranges and going on inside the one that holds it."""
    low, high, total = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not total or k >= total:
        return float("-inf") if low is None else low
    if k < 1:
        return float("inf")
    above = 0
    while low < high:
        width = (high - low) / 4096
        inside = keys.filter((F.col(column) >= low) & (F.col(column) <= high))
        place = F.least(F.lit(4095), F.floor((F.col(column) - low) / width)).alias("place") if width else F.lit(0).alias("place")
        found = inside.groupBy(place).agg(F.count("*"), F.min(column), F.max(column)).collect()
        for _, count, first, last in sorted(found, reverse=True):
            if above + count >= k:
                break
            above += count
        if (first, last) == (low, high):
            break
        low, high = first, last
    return low
