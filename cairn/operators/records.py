"""Record building: eligibility, grouping, latest versions, stable slugs, curated assignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_datetime, present, qid, slugify
from ..functions.unicode import casefolded
from ..session import written
from .ordered import chain_ends

SETS = ("types", "homepages", "repositories", "namespaces", "licenses", "parents", "creators", "languages")


def _set(column: str) -> F.Column:
    return F.array_sort(F.collect_set(present(column)))


def build_resource_records(rows: DataFrame, sets: dict[str, str]) -> DataFrame:
    """A1: a record for each ``item``: the first description in text order and a sorted set for each field (field to column)."""
    return rows.filter(present("item").isNotNull()).groupBy(F.trim("item").alias("item")).agg(
        F.min(present("description")).alias("description"), *(_set(column).alias(field) for field, column in sets.items())
    )


def candidate_facts(rows: DataFrame) -> DataFrame:
    """A2: ``qid`` with its sets of direct types and parents."""
    named = rows.select(qid("item").alias("qid"), qid("type").alias("type"), qid("parent").alias("parent"))
    return named.filter("qid is not null").groupBy("qid").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("parent")).alias("parents"))


def latest_version(versions: DataFrame) -> DataFrame:
    """A3: ``item, version, release_date`` from ``item, version, pub_date``.

    Of dated rows the last by (date, version), both from one row; without dated rows the last version and no date.
    """
    clean = versions.select(F.col("item"), present("version").alias("version"), parse_datetime("pub_date").alias("at")).filter("item is not null and version is not null")
    best = F.max(F.struct(F.col("at").isNotNull().alias("dated"), F.col("at"), F.col("version")))
    return clean.groupBy("item").agg(best.alias("b")).select("item", F.col("b.version").alias("version"), F.to_date("b.at").alias("release_date"))


def eligible_records(facts: DataFrame, markers: list[str], exclusions: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``qid, eligible, reason`` from ``qid, types, parents``; reason: declared, exception, unmarked, rule, orphan, cycle.

    Only marked records depend on parents.  A round decides those with an eligible parent (not eligible) and those whose parents in the snapshot are
    all decided and not eligible (eligible), for as long as a round decides any; what is left then is a cycle, with a null verdict.  A round reads what the one before decided, and the edges to parents that are still open.

    Where a round leaves most edges open, chains are contracted: a record that waits for one parent alone is that parent's opposite, so it stands for the end of its chain or for that one's opposite, found
    by pointer doubling, and edges to it go to the end.  So the rounds do not grow with the length of chains.
    """
    marked = F.arrays_overlap("types", F.array(*map(F.lit, markers))) if markers else F.lit(False)
    out, allowed = exclusions.select("qid", F.lit(True).alias("_out")).distinct(), exceptions.select("qid", F.lit(True).alias("_in")).distinct()
    state = facts.select("qid", marked.alias("marked")).join(out, "qid", "left").join(allowed, "qid", "left")
    reason = F.when(F.col("_out"), "declared").when(F.col("_in"), "exception").when(~F.coalesce("marked", F.lit(False)), "unmarked")
    state = written(state.select("qid", reason.alias("reason")), "eligibility")
    open_ = state.filter("reason is null").select("qid")
    parents = facts.select("qid", F.explode("parents").alias("parent")).join(facts.select(F.col("qid").alias("parent")), "parent", "left_semi")
    # ``turned``: the edge asks for the opposite of its parent's verdict.
    waiting = written(parents.join(open_, "qid", "left_semi").select("qid", "parent", F.lit(0).alias("turned")).distinct(), "waiting")
    decided, stands, size = [written(state.filter("reason is not null"), "decided")], [], waiting.count()
    while True:
        known = decided[-1].select(F.col("qid").alias("parent"), F.col("reason").isin(*ELIGIBLE).cast("int").alias("ok"))
        met = waiting.join(known, "parent")
        rule = met.filter("ok <> turned").select("qid").distinct()
        waits = written(waiting.join(known, "parent", "left_anti").join(rule, "qid", "left_anti"), "waiting")
        orphan = open_.join(rule, "qid", "left_anti").join(waits.select("qid").distinct(), "qid", "left_anti")
        now = written(rule.withColumn("reason", F.lit("rule")).unionByName(orphan.withColumn("reason", F.lit("orphan"))), "decided")
        before, left = size, waits.count()
        open_ = written(open_.join(now, "qid", "left_anti"), "open")
        decided.append(now)
        waiting, size, stood = waits, left, False
        if left > max(CHAINS, before // 2):
            contracted = _contracted(waiting, open_)
            if stood := contracted is not None:
                waiting, open_, ends = contracted
                stands.append(ends)
                size = waiting.count()
        if now.isEmpty() and not stood:
            break
    done = reduce(DataFrame.unionByName, decided).unionByName(open_.withColumn("reason", F.lit("cycle")))
    for ends in reversed(stands):  # a chain's end was decided after the chain was contracted, or stands for another one that was
        of_end = done.select(F.col("qid").alias("root"), F.when(F.col("reason") != "cycle", F.col("reason").isin(*ELIGIBLE).cast("int")).alias("ok"))
        own = ends.join(of_end, "root", "left")
        reason = F.when(F.col("ok").isNull(), "cycle").when(F.col("ok") != F.col("turn"), "orphan").otherwise("rule")
        done = written(done.unionByName(own.select("qid", reason.alias("reason"))), "decided")
    verdict = F.when(F.col("reason").isin(*ELIGIBLE), True).when(F.col("reason").isin("declared", "rule"), False)
    return done.select("qid", verdict.alias("eligible"), "reason")


ELIGIBLE = ("exception", "unmarked", "orphan")
#: Edges that may wait without a look for chains.
CHAINS = 16


def _contracted(waiting: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Edges and open records without those that wait for one parent alone, and ``qid, root, turn`` of these (null for those of a cycle); None without any."""
    one = waiting.groupBy("qid").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("turned").alias("turned")).filter("n = 1")
    single = written(one.select(F.col("qid").alias("node"), "parent", (1 - F.col("turned")).alias("turn")), "single")
    if single.isEmpty():
        return None
    ends = written(single.select(F.col("node").alias("qid")).join(chain_ends(single).withColumnRenamed("node", "qid"), "qid", "left"), "ends")
    rest = waiting.join(ends.select("qid"), "qid", "left_anti").join(ends.select(F.col("qid").alias("parent"), "root", "turn"), "parent", "left")
    turned = ((F.col("turned") + F.coalesce("turn", F.lit(0))) % 2).cast("int")
    rest = rest.select("qid", F.coalesce("root", "parent").alias("parent"), turned.alias("turned")).distinct()
    return written(rest, "waiting"), written(open_.join(ends.select("qid"), "qid", "left_anti"), "open"), ends


def filter_eligible(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of eligible records."""
    return rows.join(verdicts.filter("eligible").select("qid"), "qid", "left_semi")


def assign_slugs(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``dataset, qid, slug``: registered slugs as they are, and one for every other record (``dataset, qid, label, item_iri``).

    New records claim slugs in the order of (folded label, iri); the first gets it, later ones and those whose slug is registered get
    ``slug-qid``.  A suffixed slug may equal the plain slug of a later record, which then is suffixed as well; passes repeat until that settles.
    """
    taken = registry.select("dataset", F.col("slug").alias("natural")).distinct().withColumn("_taken", F.lit(True))
    pending = records.join(registry, ["dataset", "qid"], "left_anti").withColumn("natural", slugify("label")).withColumn("_key", casefolded("label"))
    order = Window.partitionBy("dataset", "natural").orderBy("_key", "item_iri")
    suffixed = F.concat(F.col("natural"), F.lit("-"), F.lower("qid"))
    first = F.row_number().over(order) == 1
    state = pending.withColumn("_first", first).join(taken, ["dataset", "natural"], "left")
    slug = F.when(F.col("_first") & F.col("_taken").isNull(), F.col("natural")).otherwise(suffixed)
    state = written(state.select("dataset", "qid", "natural", "_key", "item_iri", slug.alias("slug")), "slugs")
    while True:
        claims = state.filter("slug <> natural").select("dataset", F.col("slug").alias("natural"), F.col("_key").alias("_by_key"), F.col("item_iri").alias("_by_iri"))
        clash = state.filter("slug = natural").join(claims, ["dataset", "natural"])
        clash = clash.filter((F.col("_by_key") < F.col("_key")) | (F.col("_by_key") == F.col("_key")) & (F.col("_by_iri") < F.col("item_iri"))).select("dataset", "qid").distinct().withColumn("_clash", F.lit(True))
        if clash.isEmpty():
            break
        state = written(state.join(clash, ["dataset", "qid"], "left").withColumn("slug", F.when(F.col("_clash"), suffixed).otherwise(F.col("slug"))).drop("_clash"), "slugs")
    return registry.select("dataset", "qid", "slug").unionByName(state.select("dataset", "qid", "slug"))


def apply_curated(records: DataFrame, assignments: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the curated concept, where the vocabulary has it, and those that still miss one."""
    known = assignments.join(vocab.select(F.col("iri").alias("concept_iri")).distinct(), "concept_iri", "left_semi")
    return records.join(known.select("dataset", "qid", "concept_iri"), ["dataset", "qid"], "inner"), records.join(known, ["dataset", "qid"], "left_anti")


def curated_subjects(assignments: DataFrame, registry: DataFrame, base: str) -> DataFrame:
    """``dataset, qid, subject``: the registered page, else the entity."""
    from ..functions.columns import ENTITY, page_iri

    joined = assignments.select("dataset", "qid").join(registry, ["dataset", "qid"], "left")
    return joined.select("dataset", "qid", F.coalesce(page_iri(base, "dataset", "slug"), F.concat(F.lit(ENTITY), F.col("qid"))).alias("subject"))


def classification_projection(assignments: DataFrame, vocab: DataFrame) -> DataFrame:
    """``qid, label, sort_order`` of assigned concepts, by qid."""
    return assignments.join(vocab.select(F.col("iri").alias("concept_iri"), "label", "sort_order"), "concept_iri").select("qid", "label", "sort_order").orderBy("qid")


def ordered_items(items: DataFrame) -> DataFrame:
    """By folded title, then id."""
    return items.orderBy(casefolded("title"), "qid")


def single_values(records: DataFrame, fields: list[str]) -> DataFrame:
    """The smallest value of each set, null for an empty one."""
    return records.withColumns({f: F.array_min(f) for f in fields})


def raw_cohort(*catalogs: tuple[str, DataFrame]) -> DataFrame:
    """``qid, catalogs``: every id with the sorted names of the catalogs that hold it."""
    ids = None
    for name, df in catalogs:
        one = df.select("qid").distinct().withColumn("catalog", F.lit(name))
        ids = one if ids is None else ids.unionByName(one)
    return ids.groupBy("qid").agg(F.array_sort(F.collect_set("catalog")).alias("catalogs"))
