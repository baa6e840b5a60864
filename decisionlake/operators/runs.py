"""Loop-run records: validation and folding of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake import config


def _with_diff(runs: DataFrame) -> DataFrame:
    want = F.array(*[F.lit(f) for f in config.RUN_FIELDS])
    have = F.map_keys("fields")
    return runs.withColumn("missing", F.array_join(F.array_except(want, have), ", ")).withColumn(
        "extra", F.array_join(F.array_except(have, want), ", "))


def field_set_diff(runs: DataFrame) -> DataFrame:
    """runs (path, fields) -> (path, missing, extra), both as comma lists in contract order."""
    return _with_diff(runs.where("fields is not null")).select("path", "missing", "extra")


def validate_runs(runs: DataFrame) -> DataFrame:
    """(path, error): every broken rule of every run; an unparsed run reports only its parse error."""
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    r = _with_diff(runs)
    good = F.col("error").isNull()
    checks = [
        F.col("error"),
        F.when(good & (F.col("missing") != ""), F.concat(F.lit("missing fields: "), "missing")),
        F.when(good & (F.col("extra") != ""), F.concat(F.lit("extra fields: "), "extra")),
        F.when(good & ~f("Status").isin(config.RUN_STATUSES), "invalid Status"),
        F.when(good & ~f("Trigger").isin(config.RUN_TRIGGERS), "invalid Trigger"),
        F.when(good & ~f("Outcome").isin(config.RUN_OUTCOMES), "invalid Outcome"),
        F.when(good & ~f("Checker result").isin(config.RUN_CHECKER_RESULTS), "invalid Checker result"),
        F.when(good & (f("Status") == "Closed") & (F.trim(f("Stop reason")) == ""), "closed run missing Stop reason"),
        F.when(good & (f("Sources") != F.concat(F.lit("loop-run:"), F.col("run_no"))), "invalid Sources")]
    return r.select("path", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def accepted_events(events: DataFrame) -> DataFrame:
    """Events that take effect: after the run's first open; appends only before its first close."""
    opened = events.where("event = 'open'").groupBy("run_id").agg(F.min("seq").alias("open_seq"))
    live = events.join(opened, "run_id").where("seq = open_seq or (seq > open_seq and event <> 'open')")
    closed = live.where("event = 'close'").groupBy("run_id").agg(F.min("seq").alias("close_seq"))
    return live.join(closed, "run_id", "left").where(
        "event <> 'append' or close_seq is null or seq < close_seq")


def fold_runs(events: DataFrame) -> DataFrame:
    """Run state from open / append / close events: the last value of each field, counts of notes and of
    distinct artifacts. All folds combine map-side."""
    ev = accepted_events(events)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    folded = ev.groupBy("run_id").agg(
        F.min("open_seq").alias("open_seq"), F.min("close_seq").alias("close_seq"),
        last("checker_result").alias("checker_result"), last("outcome").alias("outcome"),
        F.max_by("note", F.when(F.col("event") == "close", F.col("seq"))).alias("stop_reason"),
        F.count(F.lit(1)).alias("log_entries"))
    arts = run_artifacts(events, ev).groupBy("run_id").agg(F.count(F.lit(1)).alias("artifacts"))
    return folded.join(arts, "run_id", "left").select(
        "run_id", F.when(F.col("close_seq").isNull(), "Open").otherwise("Closed").alias("status"),
        F.coalesce("checker_result", F.lit("unknown")).alias("checker_result"), F.coalesce("outcome", F.lit("pending")).alias("outcome"),
        F.coalesce("stop_reason", F.lit("")).alias("stop_reason"), "log_entries", F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


def run_artifacts(events: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Distinct artifacts of each run in first-seen order, long form: (run_id, artifact, first_seq)."""
    ev = accepted if accepted is not None else accepted_events(events)
    return ev.where("artifact is not null and event <> 'close'").groupBy("run_id", "artifact").agg(F.min("seq").alias("first_seq"))
