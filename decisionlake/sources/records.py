"""Markdown decision and run records to tables. Each document is parsed inside its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions import text as tx
from decisionlake.functions.content import once

H1 = r"^#\s+(\w+)\s+(\d+)\s*[—–-]+\s*(.+?)\s*$"
FRONT = r"^-\s+([A-Za-z][A-Za-z ]*?):\s*(.*)$"
RUN_H1 = r"^#\s+RUN\s+(\d{4})\s*[—–-]+\s*(.+?)\s*$"
RUN_FIELD = r"^-\s+([^:]+):\s*(.*)$"


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _last(pairs: Column, key) -> Column:
    """Value of the last pair with this key: repeated keys are last-wins."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]


def parse_records(raw_docs: DataFrame) -> DataFrame:
    """raw_docs (lib, type, path, text) -> the records table, plus ``parsed``.

    The first non-blank line must be a heading ``# LABEL N - title``; frontmatter is the ``- Key: value``
    lines from there to the first ``## `` section.
    """
    d = once(raw_docs, "lines", _lines(F.col("text")))
    d = d.withColumn("h1", F.get(F.filter("lines", lambda l: F.trim(l) != ""), F.lit(0)))
    d = d.withColumn("parsed", F.coalesce(F.col("h1").rlike(H1), F.lit(False)))
    d = d.withColumn("after", F.slice("lines", F.array_position("lines", F.col("h1")).cast("int") + 1, F.size("lines")))
    stops = F.filter(F.transform("after", lambda l, i: F.when(l.startswith("## "), i)), lambda i: i.isNotNull())
    d = once(d, "front", F.when(F.size(stops) > 0, F.slice("after", 1, F.get(stops, F.lit(0)))).otherwise(F.col("after")))
    pairs = F.transform(F.filter("front", lambda l: l.rlike(FRONT)), lambda l: F.struct(
        F.trim(F.regexp_extract(l, FRONT, 1)).alias("k"), F.trim(F.regexp_extract(l, FRONT, 2)).alias("v")))
    d = once(d, "pairs", pairs)
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    kept = F.filter(keys, lambda k: F.lower(k) != "aliases")
    field_text = F.array_join(F.transform(kept, lambda k: _last(F.col("pairs"), k)), " ")
    label = F.upper(F.regexp_extract("h1", H1, 1))
    number = F.regexp_extract("h1", H1, 2).try_cast("bigint")
    cols = [F.coalesce(_last(F.col("pairs"), key), F.lit("")).alias(col) for key, col in config.FIELD_COLUMNS.items()]
    return d.select("lib", "type", label.alias("label"), number.alias("number"), tx.record_id(label, number).alias("rec_id"),
                    F.trim(F.regexp_extract("h1", H1, 3)).alias("title"), *cols, "path", field_text.alias("field_text"),
                    F.col("text").alias("body"), F.map_from_entries(F.transform(keys, lambda k: F.struct(k, _last(F.col("pairs"), k)))).alias("fields"),
                    "parsed")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("not parsed").select("lib", "path")


def parse_run_records(raw_docs: DataFrame) -> DataFrame:
    """raw_docs (path, text) -> (path, run_no, title, fields, error). Strict: the heading is line 1 with
    exactly four digits, and any other line before the first section is an error."""
    d = once(raw_docs, "lines", _lines(F.col("text")))
    d = d.withColumn("h1", F.get("lines", F.lit(0)))
    ok = F.col("h1").rlike(RUN_H1)
    d = d.withColumn("after", F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda l: F.trim(l) != ""))
    stops = F.filter(F.transform("after", lambda l, i: F.when(l.startswith("## "), i)), lambda i: i.isNotNull())
    d = once(d, "front", F.when(F.size(stops) > 0, F.slice("after", 1, F.get(stops, F.lit(0)))).otherwise(F.col("after")))
    bad = F.get(F.filter("front", lambda l: ~l.rlike(RUN_FIELD)), F.lit(0))
    error = (F.when(F.col("text") == "", "missing_h1").when(~ok, "malformed_h1")
             .when(bad.isNotNull(), F.concat(F.lit("malformed_frontmatter_line:"), bad)))
    d = d.withColumn("error", error)
    pairs = F.transform("front", lambda l: F.struct(F.regexp_extract(l, RUN_FIELD, 1).alias("k"), F.regexp_extract(l, RUN_FIELD, 2).alias("v")))
    d = once(d, "pairs", pairs)
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    fields = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, _last(F.col("pairs"), k))))
    good = F.col("error").isNull()
    return d.select("path", F.when(good, F.regexp_extract("h1", RUN_H1, 1)).alias("run_no"),
                    F.when(good, F.regexp_extract("h1", RUN_H1, 2)).alias("title"), F.when(good, fields).alias("fields"), "error")
