"""Do the cited sources exist, and did they move since the record was last confirmed?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions import text as tx
from decisionlake.functions.times import utc_day
from decisionlake.operators.library import extract_source_paths, review_baseline

ROOTS = ("", "decisions/")


def last_changes(file_changes: DataFrame) -> DataFrame:
    """Latest change day per path: only that one matters, so the history is reduced before any join."""
    at = F.col("commit_ts")
    day = utc_day(at) if dict(file_changes.dtypes)["commit_ts"] == "timestamp" else F.to_date(at)
    return file_changes.groupBy("lib", "path").agg(F.max(day).alias("last_change"))


def changed_after(paths: DataFrame, file_changes: DataFrame, root: str = "decisions/") -> DataFrame:
    """paths (lib, rec_id, source_path, baseline) + last_change, changed.

    The path is tried below the library root first, then as it stands; a path without history is NULL,
    and only a strictly later day counts as changed.
    """
    last = last_changes(file_changes)
    below = last.select("lib", F.col("path").alias("__below"), F.col("last_change").alias("__l1"))
    plain = last.select("lib", F.col("path").alias("source_path"), F.col("last_change").alias("__l2"))
    out = (paths.withColumn("__below", F.concat(F.lit(root), "source_path"))
           .join(below, ["lib", "__below"], "left").join(plain, ["lib", "source_path"], "left"))
    day = F.coalesce("__l1", "__l2").cast("string")
    return out.select("lib", "rec_id", "source_path", "baseline", day.alias("last_change"),
                      (day > F.col("baseline")).alias("changed"))


def assess_staleness(records: DataFrame, file_changes: DataFrame, today: str,
                     statuses: tuple[str, ...] = ("accepted",)) -> DataFrame:
    """Per record: stale (three-valued), effective, baseline, honoured, checked, stale_paths, reason."""
    status = F.lower("status")
    wanted = F.lit(not statuses)
    for s in statuses:
        wanted = wanted | status.startswith(s.lower())
    base = review_baseline(records, today).where(wanted)
    paths = extract_source_paths(base).join(base.select("lib", "rec_id", "baseline"), ["lib", "rec_id"]).where("baseline <> ''")
    known = changed_after(paths, file_changes).where("changed is not null")
    # lists are bounded by one record's own Sources text
    per = known.groupBy("lib", "rec_id").agg(
        F.array_join(F.array_sort(F.collect_list("source_path")), ",").alias("checked"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("changed"), F.col("source_path")))), ",").alias("stale_paths"),
        F.bool_or("changed").alias("stale"))
    cited = F.size(tx.extract_source_paths(F.col("sources"))) > 0
    since = F.when(F.col("honoured").isNotNull(), "the review").otherwise("the date")
    return base.join(per, ["lib", "rec_id"], "left").select(
        "lib", "rec_id", "title", "stale", "effective", "baseline", "honoured",
        F.coalesce("checked", F.lit("")).alias("checked"), F.coalesce("stale_paths", F.lit("")).alias("stale_paths"),
        F.when(F.col("baseline") == "", "no date").when(~cited, "no cited paths")
        .when(F.col("stale").isNull(), "paths not tracked")
        .when(F.col("stale"), F.concat(F.lit("changed after "), since))
        .otherwise(F.concat(F.lit("unchanged since "), since)).alias("reason"))


def staleness_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("lib").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("stale")).alias("stale"),
        F.count_if(F.col("stale").isNull()).alias("unknown"), F.count_if(~F.col("stale")).alias("fresh"))


def drift_report(libs: DataFrame, assessed: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Per library: status stale / fresh, or skip when the library has no history at all."""
    tracked = file_changes.select("lib").distinct().withColumn("tracked", F.lit(True))
    out = libs.select("lib").distinct().join(tracked, "lib", "left").join(staleness_counts(assessed), "lib", "left")
    on = F.col("tracked").isNotNull()
    zero = lambda c: F.when(on, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return out.select(
        "lib", F.when(~on, "skip").when(F.col("stale") > 0, "stale").otherwise("fresh").alias("status"),
        zero("stale"), zero("unknown"), zero("fresh"), F.when(~on, "no_history").alias("skip_reason"))


def existing_paths(repo_files: DataFrame) -> DataFrame:
    """Every listed path and every directory above it: (lib, path)."""
    return repo_files.select("lib", F.explode(tx.ancestor_prefixes(F.col("path"))).alias("path")).distinct()


def ghost_sources(records: DataFrame, repo_files: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """File-shaped citations that exist under no root and whose name is nowhere: (lib, rec_id, source_path)."""
    cited = extract_source_paths(records).where(tx.is_file_shaped(F.col("source_path"))).select("lib", "rec_id", "source_path")
    have = existing_paths(repo_files)
    rest = cited
    for root in roots:
        under = have.where(F.col("path").startswith(root)).select(
            "lib", F.substr("path", F.lit(len(root) + 1)).alias("source_path"))
        rest = rest.join(under, ["lib", "source_path"], "left_anti")
    names = repo_files.where("not is_dir").select("lib", tx.basename(F.col("path")).alias("base")).distinct()
    return (rest.withColumn("base", tx.basename(F.col("source_path"))).join(names, ["lib", "base"], "left_anti")
            .select("lib", "rec_id", "source_path"))


def dangling_refs(records: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Every LABEL N in the text that names no record, not itself, once per record: (lib, rec_id, ref)."""
    refs = records.select("lib", "rec_id", F.explode(
        tx.id_refs(F.col("body"), tx.strict_ref(labels or config.LABELS))).alias("ref")).where("ref <> rec_id").distinct()
    return refs.join(records.select("lib", F.col("rec_id").alias("ref")).distinct(), ["lib", "ref"], "left_anti").select(
        "lib", "rec_id", "ref")


def anchored(records: DataFrame, repo_files: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """Records that cite at least one path that exists exactly, file or directory: (lib, rec_id)."""
    tokens = records.select("lib", "rec_id", F.explode(tx.citation_tokens(F.col("sources"))).alias("token"))
    under = tokens.select("lib", "rec_id", F.explode(F.array(
        *[F.concat(F.lit(r), F.col("token")) for r in roots])).alias("path"))
    return under.join(existing_paths(repo_files), ["lib", "path"], "left_semi").select("lib", "rec_id").distinct()


def assess_integrity(records: DataFrame, repo_files: DataFrame) -> DataFrame:
    """(lib, rec_id, kind, detail) of dangling references and ghost citations; none means clean."""
    return dangling_refs(records).select("lib", "rec_id", F.lit("dangling_ref").alias("kind"), F.col("ref").alias("detail")).unionByName(
        ghost_sources(records, repo_files).select("lib", "rec_id", F.lit("ghost_source").alias("kind"), F.col("source_path").alias("detail")))
