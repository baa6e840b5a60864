"""Library health: validation findings and the aggregates of the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions import text as tx
from decisionlake.operators import alias as al
from decisionlake.operators import graph
from decisionlake.operators.freshness import staleness_counts
from decisionlake.operators.library import review_baseline
from decisionlake.operators.resolve import Library
from decisionlake.session import cut


def validate_records(library: Library, today: str, labels: list[str] | None = None,
                     statuses: list[str] | None = None) -> DataFrame:
    """findings (lib, subject, severity, code, detail). Subject is a record path, an id or an alias."""
    r = library.records
    labels = labels or config.LABELS
    statuses = statuses or config.STATUSES

    def finding(df, severity, code, detail, subject="path"):
        return df.select("lib", F.col(subject).alias("subject"), F.lit(severity).alias("severity"),
                         F.lit(code).alias("code"), detail.alias("detail"))

    # one pass over the records for all row-level rules
    pad = lambda c: F.coalesce(c, F.lit(""))
    base = review_baseline(r, today)
    ok_status = F.lit(False)
    for s in statuses:
        ok_status = ok_status | pad("status").startswith(s)
    stem = F.regexp_replace(tx.basename(F.col("path")), r"\.[^.]*$", "")
    rule = lambda cond, sev, code, detail: F.when(cond, F.struct(
        F.lit(sev).alias("severity"), F.lit(code).alias("code"), detail.alias("detail")))
    rules = [rule(~F.upper("label").isin(labels), "error", "unknown_label", F.col("label"))]
    for field in config.REQUIRED_FIELDS:
        rules.append(rule(pad(config.FIELD_COLUMNS[field]) == "", "error", "missing_field", F.lit(field)))
    rules.append(rule((pad("status") != "") & ~ok_status, "error", "bad_status", F.col("status")))
    rules.append(rule(pad("sources") == "", "warning", "no_sources", F.lit("")))
    rules.append(rule(F.col("review_problem").isNotNull(), "warning", "bad_review", F.col("review_problem")))
    rules.append(rule(~stem.rlike(r"^\d+-[a-z0-9][a-z0-9-]*$"), "warning", "file_name", stem))
    rows = base.select("lib", F.col("path").alias("subject"), F.explode(F.array_compact(F.array(*rules))).alias("f")).select(
        "lib", "subject", "f.severity", "f.code", "f.detail")

    # every record after the first one of its number, in library order
    shared = r.groupBy("lib", "type", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = cut(r.select("lib", "type", "number", "path").join(shared, ["lib", "type", "number"]))
    owners = same.groupBy("lib", "type", "number").agg(F.min("path").alias("owner"))
    twice = same.join(owners, ["lib", "type", "number"]).where("path <> owner")
    link = F.concat_ws(" ", pad("status"), pad("supersedes"), pad("related"))
    refs = r.where(F.lower(link).contains("supersed")).select(
        "lib", "path", "rec_id", F.explode(tx.id_refs(link, tx.strict_ref(labels))).alias("ref")).where("ref <> rec_id")
    unresolved = refs.join(r.select("lib", F.col("rec_id").alias("ref")), ["lib", "ref"], "left_anti")
    cycles = graph.supersede_cycles(graph.validation_edges(r, labels))
    clashes = al.alias_collisions(library.amap)
    out = rows
    for part in (
            finding(twice, "error", "duplicate_number", F.col("number").cast("string")),
            finding(unresolved, "error", "unresolved_reference", F.col("ref")),
            finding(cycles, "error", "supersede_cycle", F.lit(""), "rec_id"),
            finding(clashes, "error", "ambiguous_alias", F.col("targets").cast("string"), "alias"),
            finding(library.invalid, "error", "invalid_chain", F.col("reason"), "rec_id")):
        out = out.unionByName(part)
    return out


def status_distribution(records: DataFrame) -> DataFrame:
    """Per library: one count per status bucket, retired count and rate."""
    b = tx.status_bucket(F.col("status"))
    counts = [F.count_if(b == s).alias(s) for s in ("accepted", "proposed", "superseded", "deprecated", "rejected", "other")]
    out = records.groupBy("lib").agg(F.count(F.lit(1)).alias("records_total"), *counts)
    retired = F.col("superseded") + F.col("deprecated") + F.col("rejected")
    return out.withColumn("retired", retired).withColumn("retired_rate", F.round(retired / F.col("records_total"), 3))


def chain_depths(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("lib").agg(
        F.max("depth").alias("max_chain_depth"),
        F.round(F.avg(F.when(F.col("depth") >= 1, F.col("depth"))), 3).alias("mean_chain_depth"))


def anchoring_rate(records: DataFrame, anchored: DataFrame) -> DataFrame:
    """Accepted records anchored in code: counts, raw and rounded rate (NULL without Accepted)."""
    flags = records.join(anchored.withColumn("hit", F.lit(1)), ["lib", "rec_id"], "left")
    acc = tx.is_accepted(F.col("status"))
    out = flags.groupBy("lib").agg(
        F.count_if(acc & F.col("hit").isNotNull()).alias("accepted_anchored"), F.count_if(acc).alias("accepted_total"),
        F.count_if(F.col("hit").isNotNull()).alias("all_anchored"), F.count(F.lit(1)).alias("all_total"))
    raw = F.try_divide("accepted_anchored", "accepted_total")
    return out.withColumn("rate_raw", raw).withColumn("rate", F.round(raw, 3))


def unanchored(records: DataFrame, anchored: DataFrame) -> DataFrame:
    """The Accepted records behind the gap, long form: (lib, rec_id)."""
    return records.where(tx.is_accepted(F.col("status"))).select("lib", "rec_id").join(anchored, ["lib", "rec_id"], "left_anti")


def alias_coverage(records: DataFrame) -> DataFrame:
    acc = records.where(tx.is_accepted(F.col("status")))
    out = records.select("lib").distinct().join(acc.groupBy("lib").agg(
        F.count_if(F.size(tx.parse_aliases(F.col("aliases"))) > 0).alias("with_aliases"),
        F.count(F.lit(1)).alias("accepted_total")), "lib", "left").fillna(0)
    return out.withColumn("rate", F.round(F.try_divide("with_aliases", "accepted_total"), 3))


def references(records: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Resolved references in Status, Supersedes and Related, self excluded: (lib, rec_id, ref)."""
    link = F.concat_ws(" ", "status", "supersedes", "related")
    refs = records.select("lib", "rec_id", F.explode(tx.id_refs(link, tx.strict_ref(labels or config.LABELS))).alias("ref"))
    known = records.select("lib", F.col("rec_id").alias("ref")).distinct()
    return refs.where("ref <> rec_id").distinct().join(known, ["lib", "ref"], "left_semi")


def orphans(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Accepted records with no reference out and none in: (lib, rec_id)."""
    acc = records.where(tx.is_accepted(F.col("status"))).select("lib", "rec_id")
    linked = refs.select("lib", "rec_id").unionByName(refs.select("lib", F.col("ref").alias("rec_id"))).distinct()
    return acc.join(linked, ["lib", "rec_id"], "left_anti")


def library_health(library: Library, anchored: DataFrame, assessed: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """One row per library; every part is one row per library before it is joined."""
    r = library.records
    parts = [
        chain_depths(library.resolved),
        anchoring_rate(r, anchored).select("lib", "accepted_anchored", "accepted_total", F.col("rate").alias("anchoring_rate")),
        alias_coverage(r).select("lib", "with_aliases", F.col("rate").alias("alias_rate")),
        orphans(r, references(r)).groupBy("lib").agg(F.count(F.lit(1)).alias("orphans")),
        ambiguous.groupBy("lib").agg(F.count(F.lit(1)).alias("ambiguous_topics")),
        staleness_counts(assessed).select("lib", "stale", "unknown", "fresh")]
    out = status_distribution(r)
    for part in parts:
        out = out.join(part, "lib", "left")
    return out.fillna(0, ["orphans", "ambiguous_topics", "stale", "unknown", "fresh"])
