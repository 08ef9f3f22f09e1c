"""Snapshots: counts, digests of files, tables and pages, manifests, and what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import generation_id
from ..session import written
from .gates import violations


def catalog_counts(items: DataFrame, triples: DataFrame) -> DataFrame:
    """``dataset, records, triples``, with a row ``all`` for the total."""
    count = lambda df, n: df.rollup("dataset").agg(F.count("*").alias(n), F.grouping("dataset").alias("_all")).filter("_all = 1 or dataset is not null").select(F.coalesce("dataset", F.lit("all")).alias("dataset"), n)
    return count(items, "records").join(count(triples, "triples"), "dataset", "full").na.fill(0)


def row_digest(df: DataFrame, volatile: list[str] | None = None) -> Column:
    """A digest of a row's lasting columns, whatever their order."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in (volatile or [])))), 256)


def table_digest(df: DataFrame, volatile: list[str] | None = None) -> DataFrame:
    """One row ``rows, digest`` that does not depend on the order of rows: three sums over the rows' digests."""
    h = row_digest(df, volatile)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(F.coalesce(part(i), F.lit("0")) for i in range(3))), 256).alias("digest"))


def substantive_changes(candidate: DataFrame, baseline: DataFrame, keys: list[str], volatile: list[str] | None = None) -> DataFrame:
    """Keys with ``change``: added, removed, changed, after volatile columns are left out; order does not count."""
    a, b = (df.select(*keys, row_digest(df, volatile).alias(n)) for df, n in ((candidate, "_a"), (baseline, "_b")))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def page_fingerprints(pages: DataFrame, html: str = "html", volatile: str = r'\s(?:data-generated|data-build|nonce)="[^"]*"|<!--.*?-->') -> DataFrame:
    """Adds ``fingerprint``: the digest of a page without its volatile attributes and comments."""
    return pages.withColumn("fingerprint", F.sha2(F.regexp_replace(html, f"(?s){volatile}", ""), 256))


#: Hexadecimal digits of a leaf of a digest tree: 4,096 leaves for each tree of files.
DEPTH = 3


def _leaf(depth: int) -> Column:
    return F.substring(F.sha2("path", 256), 1, depth)


def digest_tree(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``tree, level, node, files, sha256`` of ``files(path, sha256)``: a tree of digests for each tree of files (the first part of the path).

    A leaf holds the files whose path's SHA-256 begins with its ``depth`` digits, and its digest is that of its lines ``path sha256`` in order; a node of a lower level, of one digit less,
    has that of its children's digests, in order.  So no row and no task holds all files: a leaf has its share of them, a node 16 children.
    """
    leaf = files.groupBy(F.substring_index("path", "/", 1).alias("tree"), _leaf(depth).alias("node")).agg(
        F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256"))), "\n"), 256).alias("sha256")
    )
    levels = [written(leaf.withColumn("level", F.lit(depth)), "leaves")]
    for level in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "sha256"))), lambda c: c["sha256"])
        parent = levels[-1].groupBy("tree", F.substring("node", 1, level).alias("parent")).agg(F.sum("files").alias("files"), F.sha2(F.array_join(children, "\n"), 256).alias("sha256"))
        levels.append(parent.select("tree", F.col("parent").alias("node"), "files", "sha256", F.lit(level).alias("level")))
    return written(reduce(DataFrame.unionByName, levels).select("tree", "level", "node", "files", "sha256"), "digest-tree")


def manifest(tree: DataFrame, counts: DataFrame, started: str, retrieved: str, completed: str) -> DataFrame:
    """One row: the id, ordered times, counts, and the root of each tree of digests; the tree itself and the files are tables beside it."""
    if not started <= retrieved <= completed:
        raise ValueError("the times are not in order")
    whole = tree.filter("level = 0").agg(F.array_sort(F.collect_list(F.struct("tree", "files", "sha256"))).alias("trees"))
    sums = counts.agg(F.array_sort(F.collect_list(F.struct("dataset", "records", "triples"))).alias("counts"))
    digest = F.sha2(F.array_join(F.transform("trees", lambda t: t["sha256"]), "\n"), 256)
    times = {"startedAt": started, "sourceRetrievedAt": retrieved, "completedAt": completed}
    return whole.join(sums).select(generation_id(F.to_timestamp(F.lit(completed)), digest).alias("generationId"), *(F.lit(v).alias(k) for k, v in times.items()), "counts", "trees")


def differing_leaves(ours: DataFrame, theirs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``tree, node`` of leaves whose digests differ, or that one side has alone; a level is read only below nodes that differ."""
    suspects = None
    for level in range(depth + 1):
        sides = []
        for side, tree in (("_a", ours), ("_b", theirs)):
            rows = tree.filter(F.col("level") == level).select("tree", "node", F.col("sha256").alias(side))
            if suspects is not None:
                above = suspects.withColumnRenamed("node", "_above")
                rows = rows.withColumn("_above", F.substring("node", 1, level - 1)).join(above, ["tree", "_above"], "left_semi").drop("_above")
            sides.append(rows)
        suspects = sides[0].join(sides[1], ["tree", "node"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("tree", "node")
    return suspects


def verify_manifest(tree: DataFrame, listed: DataFrame, files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Files that are missing, not listed, listed twice, or whose digest differs: those of ``listed`` (``path, sha256``, with its ``tree``) and ``files`` in leaves that differ."""
    leaves = differing_leaves(tree, digest_tree(files, depth), depth)
    within = lambda rows: rows.withColumns({"tree": F.substring_index("path", "/", 1), "node": _leaf(depth)}).join(leaves, ["tree", "node"], "left_semi").drop("tree", "node")
    held = written(within(listed.select("path", F.col("sha256").alias("_want"))), "listed")
    twice = violations(held.groupBy("path").count().filter("count > 1"), "listed-twice", "path")
    both = held.distinct().join(within(files.select("path", "sha256")), "path", "full")
    code = F.when(F.col("sha256").isNull(), "file-missing").when(F.col("_want").isNull(), "file-not-listed").when(F.col("_want") != F.col("sha256"), "digest-differs")
    return twice.unionByName(violations(both.withColumn("_code", code).filter("_code is not null"), F.col("_code"), "path"))


def check_partitions(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Every file lies in exactly one part (``part, prefix``)."""
    met = files.join(F.broadcast(parts), F.startswith("path", F.col("prefix")), "left").groupBy("path").agg(F.count_distinct("part").alias("n"))
    return violations(met.filter("n = 0"), "file-in-no-part", "path").unionByName(violations(met.filter("n > 1"), "file-in-several-parts", "path"))
