"""Records as a library: baseline dates, citations, search, lookup, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions import text as tx
from decisionlake.functions.times import iso_day
from decisionlake.operators.contains import contains_join


def with_effective(records: DataFrame) -> DataFrame:
    return records.withColumn("effective", tx.effective_date(F.col("date"), F.col("decided_originally")))


def review_baseline(records: DataFrame, today: str) -> DataFrame:
    """Adds effective, baseline, honoured and review_problem.

    A review counts when it is a real ISO date, not after ``today`` and not before the effective date.
    """
    r = with_effective(records)
    raw = F.trim(F.coalesce("reviewed", F.lit("")))
    day = iso_day(raw)
    problem = (F.when(raw == "", F.lit(None).cast("string"))
               .when(~raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), "not a YYYY-MM-DD date")
               .when(day.isNull(), "not a real calendar date")
               .when(day > F.lit(today).cast("date"), "in the future"))
    valid = F.when(problem.isNull() & (raw != ""), raw)
    early = valid.isNotNull() & (F.col("effective") != "") & (valid < F.col("effective"))
    honoured = F.when(~early, valid)
    return (r.withColumn("honoured", honoured)
            .withColumn("baseline", F.coalesce("honoured", "effective"))
            .withColumn("review_problem", F.coalesce(problem, F.when(early, "before the effective date"))))


def extract_source_paths(records: DataFrame) -> DataFrame:
    """(lib, rec_id, pos, source_path) for every code path cited under Sources."""
    return records.select("lib", "rec_id", F.posexplode(tx.extract_source_paths(F.col("sources"))).alias("pos", "source_path"))


def search(records: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` matches of each query in library order (type, path), with the total.

    queries (lib, query_id, text[, type][, status]); text is looked up in the title with the field values, and in the raw body,
    each by itself: no match runs from one into the other.
    """
    named = F.concat_ws(" ", "title", *[F.nullif(c, F.lit("")) for c in config.FIELD_COLUMNS.values()])
    hay = records.select("lib", "rec_id", "path", "type", "status", "title", F.posexplode(F.array(F.lower(named), F.lower("body"))).alias("part", "hay"))
    needles = queries.select("lib", "query_id", F.lower(F.coalesce("text", F.lit(""))).alias("needle"))
    hits = contains_join(hay, needles, ["lib", "path", "part"], ["lib", "query_id"], text="hay", needle="needle", scope=["lib"]).drop("part").distinct()
    rows = hits.join(records.select("lib", "path", "rec_id", "type", "status", "title"), ["lib", "path"])
    filters = [c for c in ("type", "status") if c in queries.columns]
    if filters:
        rows = rows.join(queries.select("lib", "query_id", *[F.col(c).alias(f"want_{c}") for c in filters]), ["lib", "query_id"])
        if "type" in filters:
            rows = rows.where("want_type is null or lower(want_type) = type")
        if "status" in filters:
            rows = rows.where("want_status is null or startswith(lower(status), lower(want_status))")
    totals = rows.groupBy("lib", "query_id").agg(F.count(F.lit(1)).alias("total_matches"))
    w = Window.partitionBy("lib", "query_id").orderBy(tx.type_rank(F.col("type")), "path")
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return first.join(totals, ["lib", "query_id"]).select(
        "lib", "query_id", "rank", "rec_id", "type", "status", "title", "total_matches",
        (F.col("total_matches") > limit).alias("truncated"))


def parse_id(text: Column) -> tuple[Column, Column]:
    """Label (NULL when absent) and number of ``ADR 0002`` / ``adr2`` / ``2``."""
    pattern = r"^\s*([A-Za-z]+)?\s*0*(\d+)\s*$"
    label = F.nullif(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return label, F.regexp_extract(text, pattern, 2).try_cast("bigint")


def get_record(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Looks up (lib, ask_id, id_text[, type]): outcome one / none / ambiguous / bad_id, and the record."""
    label, number = parse_id(F.col("id_text"))
    asks = ids.withColumn("want_label", label).withColumn("number", number)
    rec = records.select("lib", "number", F.upper("label").alias("label"), F.col("type").alias("rec_type"), "rec_id", "title")
    hits = asks.join(rec, ["lib", "number"]).where("want_label is null or want_label = label")
    if "type" in ids.columns:
        hits = hits.where("type is null or type = rec_type")
    found = hits.groupBy("lib", "ask_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id"), F.min("title").alias("title"))
    return asks.join(found, ["lib", "ask_id"], "left").select(
        "lib", "ask_id", "id_text",
        F.when(F.col("number").isNull(), "bad_id").when(F.col("n").isNull(), "none")
        .when(F.col("n") > 1, "ambiguous").otherwise("one").alias("outcome"),
        F.when(F.col("n") == 1, F.col("rec_id")).alias("rec_id"), F.when(F.col("n") == 1, F.col("title")).alias("title"))


def timeline(records: DataFrame) -> DataFrame:
    """Records in the order of (effective date, type, number); a range-partitioned sort."""
    r = with_effective(records)
    return r.select("lib", "effective", "type", "number", "rec_id", "title", "status").orderBy(
        "effective", "type", "number", "lib")


def index_rows(records: DataFrame) -> DataFrame:
    r = with_effective(records)
    return r.select("lib", F.col("rec_id").alias("id"), "type", "number", "title", "status",
                    F.col("effective").alias("date"), "path")


def highest_numbers(records: DataFrame) -> DataFrame:
    return records.groupBy("lib", "type").agg(F.max("number").alias("last_number"))
