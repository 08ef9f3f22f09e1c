"""Audit of classifications: signals, planned claim edits, and checks of what was done.

Claims: ``qid, guid, property, value, rank``.  Operations: ``qid, action, property, value``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present
from ..session import bounded, written

# Phrases that speak of a term or part rather than a whole.
TERM_LIKE = (
    r"(?i)\b(?:individual|controlled|vocabulary|ontology|thesaurus)\s+(?:term|component)\b|\bterm\s+(?:for|in|of|from|used)\b|\b(?:property|value)\s+(?:that|for|of)\b"
)
TERM_LIKE_LABEL = r"(?i)\b(?:term|property|component)\b"
EDITABLE = ("planned", "approved", "executed")


def capture_cohort(rows: DataFrame) -> DataFrame:
    """``qid`` with its label and the sorted sets of types, parents, websites and matched classes."""
    sets = {"types": "type", "parents": "parent", "websites": "website", "matched_classes": "matched_class"}
    return rows.groupBy("qid").agg(F.min(present("label")).alias("label"), F.min(present("description")).alias("description"), *(F.array_sort(F.collect_set(present(c))).alias(n) for n, c in sets.items()))


def candidate_signals(records: DataFrame, markers: list[str], exclusions: DataFrame) -> DataFrame:
    """P5: adds ``signals``, up to seven reasons to look at a record."""
    out = exclusions.select("qid", F.lit(True).alias("_out")).distinct()
    named = records.join(out, "qid", "left")
    label, description = F.coalesce("label", F.lit("")), F.coalesce("description", F.lit(""))
    found = [
        F.when(F.col("_out"), F.lit("confirmed-exclusion")), F.when(F.arrays_overlap("types", F.array(*map(F.lit, markers))), F.lit("direct-term-component-type")),
        F.when(F.size("parents") > 0, F.lit("direct-part-of")), F.when(F.exists("websites", lambda w: w.rlike("#.")), F.lit("fragment-homepage")),
        F.when(description.rlike(TERM_LIKE), F.lit("term-like-description")), F.when(label.rlike(TERM_LIKE_LABEL), F.lit("term-like-label")), F.when(label.rlike("[a-z][A-Z]"), F.lit("camel-case-label")),
    ]
    return named.withColumn("signals", F.array_compact(F.array(*found))).drop("_out")


def resolve_edit_operations(before: DataFrame, intent: DataFrame) -> DataFrame:
    """Adds ``claim_guid`` and ``error``: a removal needs exactly one claim with a guid, an addition none."""
    matches = before.groupBy("qid", "property", "value").agg(F.count("*").alias("_n"), F.min("guid").alias("_guid"))
    joined = intent.join(matches, ["qid", "property", "value"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    error = (
        F.when((F.col("action") == "remove") & ((F.col("_n") != 1) | F.coalesce(F.col("_guid") == "", F.lit(True))), "removal without exactly one claim")
        .when((F.col("action") == "add") & (F.col("_n") > 0), "addition already there")
        .when(~F.col("action").isin("remove", "add"), "unsupported action")
    )
    guid = F.when((F.col("action") == "remove") & error.isNull(), F.col("_guid"))
    return joined.select("qid", "action", "property", "value", guid.alias("claim_guid"), error.alias("error"))


def apply_edit_operations(before: DataFrame, operations: DataFrame) -> DataFrame:
    """Claims without the removed ones, and with additions of normal rank that have no guid yet."""
    removed = operations.filter("action = 'remove'").select("qid", F.col("claim_guid").alias("guid"))
    added = operations.filter("action = 'add'").select("qid", F.lit(None).cast("string").alias("guid"), "property", "value", F.lit("normal").alias("rank"))
    return before.select("qid", "guid", "property", "value", "rank").join(removed, ["qid", "guid"], "left_anti").select("qid", "guid", "property", "value", "rank").unionByName(added)


def claims_match_proposal(after: DataFrame, proposed: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``qid, matches``: every proposed claim has exactly one counterpart and nothing is left over; a proposal without guid takes any claim that has one.

    ``records`` (``qid``) are judged too where they have no claim on either side, as those whose only claim is removed: they match.
    """
    known, new = proposed.filter("guid is not null"), proposed.filter("guid is null")
    keys = ["qid", "property", "value", "rank"]
    have = after.join(known.select("qid", "guid", F.lit(True).alias("_known")).distinct(), ["qid", "guid"], "left")
    exact = known.join(after.groupBy(*keys, "guid").agg(F.count("*").alias("_n")), [*keys, "guid"], "left").groupBy("qid").agg(F.bool_and(F.coalesce(F.col("_n") == 1, F.lit(False))).alias("exact"))
    rest = have.filter("_known is null").groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(present("guid").isNotNull()).alias("_with"))
    wanted = new.groupBy(*keys).agg(F.count("*").alias("_m"))
    # Without a guid a proposal must be the only one of its kind, and meet exactly one claim.
    fresh = rest.join(wanted, keys, "full").groupBy("qid").agg(F.bool_and((F.coalesce("_m", F.lit(0)) == 1) & (F.coalesce("_n", F.lit(0)) == 1) & (F.coalesce("_with", F.lit(0)) == 1)).alias("fresh"))
    ids = after.select("qid").union(proposed.select("qid"))
    ids = (ids if records is None else ids.union(records.select("qid"))).distinct()
    joined = ids.join(exact, "qid", "left").join(fresh, "qid", "left")
    return joined.select("qid", (F.coalesce("exact", F.lit(True)) & F.coalesce("fresh", F.lit(True))).alias("matches"))


# What a signal says in the rationale of a retained record.
OBSERVATIONS = {
    ("direct-part-of",): "the direct part-of relationship describes a nested or collection membership, and the item has no direct term/component marker",
    ("fragment-homepage",): "the fragment-style official URL is only a documentation locator",
    ("term-like-description", "term-like-label"): "term-like text is not a source identity assertion",
    ("camel-case-label",): "the camel-case label is a naming convention rather than eligibility evidence",
}
NO_OBSERVATION = "the reviewed source facts do not identify an individual term or component"
STANDALONE = "ontology, controlled vocabulary, taxonomy, knowledge graph, or ontology language"
CLAIM_LIST = "array<struct<property:string,value:string,guid:string,rank:string>>"


def retention_rationale(signals: Column, classes: Column) -> Column:
    """Why a record stays: an observation for each kind of signal."""
    said = F.array_compact(F.array(*(F.when(F.arrays_overlap(signals, F.array(*map(F.lit, kinds))), F.lit(text)) for kinds, text in OBSERVATIONS.items())))
    text = F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(F.lit(NO_OBSERVATION))
    return F.concat(F.lit("Retain after review against source class match(es) "), classes, F.lit(": "), text, F.lit(". No Wikidata claim change is proposed."))


def exclusion_rationale(classes: Column, review: str, whole: str) -> Column:
    """Why a confirmed exclusion stays local."""
    return F.concat(F.lit(f"Exclude locally after {review} against source class match(es) "), classes, F.lit(f". The reviewed record is not a standalone {whole}. No additional Wikidata claim change is proposed."))


def build_audit(signalled: DataFrame, claims: DataFrame, intent: DataFrame, operations: DataFrame, revisions: DataFrame | None = None, review: str = "source review", whole: str = STANDALONE) -> DataFrame:
    """A row for each record with a signal: decision, status, rationale, operations, evidence, claims before and as proposed, and the revision they are of.

    ``intent``: ``qid, decision, rationale, evidence_urls``; its records are planned edits.  Without an intent a confirmed exclusion stays local and everything
    else is retained.  Operations that do not resolve change no claim and are counted in ``edit_errors``.  What an edit leaves behind is null until ``record_edits``.
    """
    resolved = resolve_edit_operations(claims, operations)
    claim = lambda name: F.array_sort(F.collect_list(F.struct("property", "value", F.coalesce("guid", F.lit("")).alias("guid"), "rank"))).alias(name)
    before = claims.groupBy("qid").agg(claim("before_claims"))
    proposed = apply_edit_operations(claims, resolved.filter("error is null")).groupBy("qid").agg(claim("proposed_claims"))
    edits = resolved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("action", "property", "value", "claim_guid"))).alias("operations"), F.count("error").alias("edit_errors"))
    wanted = intent.select("qid", "decision", F.col("rationale").alias("_why"), F.col("evidence_urls").alias("_evidence"), F.lit(True).alias("_planned"))
    rows = signalled.filter(F.size("signals") > 0).join(wanted, "qid", "left")
    for part in (before, proposed, edits, *([revisions.select("qid", F.col("revision").alias("old_revision"))] if revisions is not None else [])):
        rows = rows.join(part, "qid", "left")
    excluded = F.array_contains("signals", F.lit("confirmed-exclusion"))
    none = F.array().cast("array<string>")
    classes = F.array_join(F.coalesce("matched_classes", none), ", ")
    evidence = F.concat(F.array(F.concat(F.lit("https://www.wikidata.org/wiki/"), "qid")), F.coalesce("websites", none), F.coalesce("_evidence", none))
    return rows.select(
        "qid", "label", "signals", F.coalesce("decision", F.when(excluded, "exclude-locally").otherwise("retain")).alias("decision"),
        F.when(F.col("_planned"), "planned").otherwise("no-edit").alias("status"),
        F.when(F.col("_planned"), F.col("_why")).when(excluded, exclusion_rationale(classes, review, whole)).otherwise(retention_rationale(F.col("signals"), classes)).alias("rationale"),
        "operations", F.coalesce("edit_errors", F.lit(0)).alias("edit_errors"), "before_claims", "proposed_claims", F.array_sort(F.array_distinct(evidence)).alias("evidence_urls"),
        (F.col("old_revision").cast("bigint") if revisions is not None else F.lit(None).cast("bigint")).alias("old_revision"),
        F.lit(None).cast(CLAIM_LIST).alias("after_claims"), F.lit(None).cast("bigint").alias("new_revision"), F.lit(None).cast("string").alias("diff_url"),
    )


def diff_url() -> Column:
    """Where the difference of a record's two revisions is shown."""
    return F.concat(F.lit("https://www.wikidata.org/w/index.php?title="), "qid", F.lit("&diff="), F.col("new_revision").cast("string"), F.lit("&oldid="), F.col("old_revision").cast("string"))


def record_edits(audit: DataFrame, edits: DataFrame) -> DataFrame:
    """Audit rows with the edits that were made: ``qid, claims, revision`` of the record afterwards."""
    made = edits.select("qid", F.col("claims").cast(CLAIM_LIST).alias("_claims"), F.col("revision").cast("bigint").alias("_revision"), F.lit(True).alias("_made"))
    rows = audit.join(made, "qid", "left").withColumns({
        "status": F.when(F.col("_made"), "executed").otherwise(F.col("status")), "after_claims": F.coalesce("_claims", "after_claims"), "new_revision": F.coalesce("_revision", "new_revision"),
    })
    return rows.withColumn("diff_url", F.when(F.col("_made"), diff_url()).otherwise(F.col("diff_url"))).select(*audit.columns)


def audit_mode(audit: DataFrame, intent: DataFrame) -> DataFrame:
    """One row ``mode``: review-first, partially-executed, executed."""
    done = audit.join(intent.select("qid"), "qid", "left_semi").agg(F.count_if(F.col("status") == "executed").alias("done"))
    total = intent.agg(F.count_distinct("qid").alias("total"))
    mode = F.when(F.col("done") == 0, "review-first").when(F.col("done") == F.col("total"), "executed").otherwise("partially-executed")
    return done.join(total).select(mode.alias("mode"))


def audit_checks(audit: DataFrame, signalled: DataFrame, intent: DataFrame) -> DataFrame:
    """``code, subject``: candidates missing or extra, repeated records, what differs from the intent or from the policy without one, unresolved edits,
    and states that do not go together: after-fields before an edit, changes without one, edits without evidence, a later revision or the proposed claims.
    The rows are made and written once, whatever the number of checks.
    """
    audit, intent = written(audit, "audit"), written(intent, "intent")  # every check reads them
    wanted = written(signalled.filter(F.size("signals") > 0).select("qid").distinct(), "wanted")
    code = lambda df, c: df.select(F.lit(c).alias("code"), F.col("qid").alias("subject"))
    both = audit.join(intent.select("qid", F.col("decision").alias("_d"), F.col("rationale").alias("_r"), F.col("evidence_urls").alias("_e")), "qid", "left")
    both = written(both.select("qid", "decision", "rationale", "evidence_urls", "status", "signals", "_d", "_r", "_e"), "intended")
    editable, planned, done = F.col("status").isin(*EDITABLE), F.col("status").isin("planned", "approved"), F.col("status") == "executed"
    policy = F.when(F.array_contains("signals", F.lit("confirmed-exclusion")), "exclude-locally").otherwise("retain")
    edits, none = F.coalesce(F.size("operations"), F.lit(0)), F.array().cast("array<string>")
    after = F.col("after_claims").isNotNull() | F.col("new_revision").isNotNull() | F.col("diff_url").isNotNull()
    proved = F.col("after_claims").isNotNull() & (F.coalesce("old_revision", F.lit(0)) > 0) & (F.coalesce("new_revision", F.lit(0)) > 0) & present("diff_url").isNotNull()
    removed = F.transform(F.filter(F.coalesce("operations", F.array().cast(audit.schema["operations"].dataType)), lambda o: o["action"] == "remove"), lambda o: o["claim_guid"])
    added = F.filter(F.coalesce("operations", F.array().cast(audit.schema["operations"].dataType)), lambda o: o["action"] == "add")
    new = F.transform(added, lambda o: F.struct(o["property"].alias("property"), o["value"].alias("value"), F.lit("").alias("guid"), F.lit("normal").alias("rank")))
    claims = lambda c: F.coalesce(F.col(c), F.array()).cast(CLAIM_LIST)
    left = F.filter(claims("before_claims"), lambda c: ~F.coalesce(F.array_contains(removed, c["guid"]), F.lit(False)))
    expected = F.array_sort(F.concat(left, new.cast(CLAIM_LIST)))
    flat = lambda c: audit.filter(done & F.col("after_claims").isNotNull()).select("qid", F.explode(claims(c)).alias("c")).select("qid", F.nullif("c.guid", F.lit("")).alias("guid"), "c.property", "c.value", "c.rank")
    parts = [
        code(wanted.join(audit, "qid", "left_anti"), "candidate-missing"), code(audit.join(wanted, "qid", "left_anti"), "candidate-extra"),
        code(audit.groupBy("qid").count().filter("count > 1"), "record-repeated"), code(intent.join(audit, "qid", "left_anti"), "intent-missing"),
        code(both.filter("_d is not null and not decision <=> _d"), "decision-differs"), code(both.filter(F.col("_d").isNull() & ~F.col("decision").eqNullSafe(policy)), "decision-differs"),
        code(both.filter("_d is not null and not rationale <=> _r"), "rationale-differs"), code(both.filter(F.size(F.array_except(F.coalesce("_e", none), F.coalesce("evidence_urls", none))) > 0), "evidence-missing"),
        code(both.filter(editable & F.col("_d").isNull()), "edit-unauthorized"), code(both.filter(~editable & F.col("_d").isNotNull()), "edit-missing"), code(audit.filter("edit_errors > 0"), "operation-unresolved"),
        code(audit.filter(planned & ((edits <= 0) | after)), "planned-state"), code(audit.filter((F.col("status") == "no-edit") & ((edits > 0) | (claims("before_claims") != claims("proposed_claims")))), "no-edit-state"),
        code(audit.filter("edit_errors = 0").filter(claims("proposed_claims") != expected), "proposal-differs"), code(audit.filter(done & ~proved), "revision-evidence-missing"),
        code(audit.filter(done & (F.col("new_revision") <= F.col("old_revision"))), "revision-not-advanced"), code(audit.filter(done & (F.col("diff_url") != diff_url())), "diff-url-differs"),
        code(claims_match_proposal(flat("after_claims"), flat("proposed_claims")).filter(~F.col("matches")), "after-claims-differ"),
    ]
    return reduce(DataFrame.unionByName, parts)


def classify_missing(items: DataFrame, vocab: DataFrame, label, batch: int = 25) -> DataFrame:
    """``qid, answer, accepted, error``: labels by a caller's function from a list of (id, text) to a mapping, in batches.

    Only ids of the batch and labels of the vocabulary count; an error fails its batch alone, and its rows carry its text.  Everything else comes back not accepted.
    """
    known = {r.label for r in bounded(vocab.select("label").distinct(), LABELS).collect()}
    shared = items.sparkSession.sparkContext.broadcast(known)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                error = None
                try:
                    said = label(list(zip(part["qid"], part["text"])))
                except Exception as failed:  # whatever a caller's function raises
                    said, error = {}, f"{type(failed).__name__}: {failed}"
                answers = [said.get(q) for q in part["qid"]]
                yield pd.DataFrame({"qid": part["qid"].tolist(), "answer": answers, "accepted": [a in shared.value for a in answers], "error": [error] * len(part)})

    return items.select("qid", "text").dropDuplicates(["qid"]).mapInPandas(run, "qid string, answer string, accepted boolean, error string")


#: Labels of a vocabulary, which go to all executors.
LABELS = 100_000
