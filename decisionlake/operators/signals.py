"""External items: product signals and decisions made elsewhere, to draft records.

items: (batch_id, idx, item) with the item as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions.content import kind, once
from decisionlake.functions.times import normalize_ts


def _parsed(items: DataFrame) -> DataFrame:
    return once(items, "v", F.try_parse_json("item"))


def _sub(key: str) -> Column:
    return F.try_variant_get("v", f"$.{key}", "variant")


def _str(key: str) -> Column:
    """Text of a field, NULL when it is absent, null or empty."""
    return F.nullif(F.try_variant_get("v", f"$.{key}", "string"), F.lit(""))


def classify_items(items: DataFrame, schema: str = "auto") -> DataFrame:
    """Adds kind: a signal has all eight discriminating keys; anything else is a decision."""
    if schema in ("signals", "decisions"):
        return items.withColumn("kind", F.lit(schema[:-1]))
    keys = F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>"))
    want = F.array(*[F.lit(k) for k in config.SIGNAL_DISCRIMINATORS])
    return items.withColumn("kind", F.when(F.size(F.array_except(want, keys)) == 0, "signal").otherwise("decision"))


def _errors(allow_sensitive: bool) -> Column:
    missing = lambda k: _sub(k).isNull() | F.is_variant_null(_sub(k)) | ((kind(_sub(k)) == "STRING") & _str(k).isNull())
    e = []
    for key in config.SIGNAL_REQUIRED:
        e.append(F.when(missing(key), f"missing:{key}"))
    present = lambda k: _sub(k).isNotNull() & ~F.is_variant_null(_sub(k))
    e.append(F.when(present("id") & ((kind(_sub("id")) != "STRING") | ~F.coalesce(
        F.try_variant_get("v", "$.id", "string"), F.lit("")).rlike("^[A-Za-z0-9._:-]+$")), "bad_id"))
    for key, allowed in config.SIGNAL_ENUMS.items():
        e.append(F.when(present(key) & ((kind(_sub(key)) != "STRING") | ~F.try_variant_get("v", f"$.{key}", "string").isin(allowed)), f"bad_value:{key}"))
    refs = F.try_variant_get("v", "$.raw_refs", "array<variant>")
    is_list = F.coalesce(kind(_sub("raw_refs")) == "ARRAY", F.lit(False))
    path = lambda r: F.try_variant_get(r, "$.url_or_path", "variant")
    bad_ref = lambda r: ~F.coalesce((kind(r) == "OBJECT") & (kind(path(r)) == "STRING") & (F.try_variant_get(r, "$.url_or_path", "string") != ""), F.lit(False))
    e.append(F.when(~is_list | (F.coalesce(F.size(refs), F.lit(0)) == 0), "bad_raw_refs"))
    e.append(F.when(is_list & F.coalesce(F.exists(refs, bad_ref), F.lit(False)), "bad_raw_ref_item"))
    made = F.try_variant_get("v", "$.created_at", "string")
    ok_time = (F.coalesce(kind(_sub("created_at")) == "STRING", F.lit(False)) & (F.length(made) >= 10)
               & made.rlike(r"^\d{4}-\d{2}-\d{2}") & normalize_ts(made).isNotNull())
    e.append(F.when(~F.coalesce(ok_time, F.lit(False)), "bad_created_at"))
    e.append(F.when(~F.lower(F.coalesce(_str("type"), F.lit("pdr"))).isin(list(config.RECORD_TYPES)), "unknown_type"))
    private = F.coalesce(_str("privacy_class").isin("pii", "sensitive"), F.lit(False))
    redacted = F.coalesce((kind(_sub("redacted")) == "BOOLEAN") & F.try_variant_get("v", "$.redacted", "boolean"), F.lit(False))
    if not allow_sensitive:
        e.append(F.when(private, "sensitive_not_allowed"))
    else:
        e.append(F.when(private & ~redacted, "not_redacted"))
    e.append(F.when(~private & _sub("redacted").isNotNull() & F.coalesce(kind(_sub("redacted")) != "BOOLEAN", F.lit(True)), "redacted_not_boolean"))
    return F.array_compact(F.array(*e))


def validate_signals(items: DataFrame, allow_sensitive: bool = False) -> DataFrame:
    """Signals with their error list: (batch_id, idx, item, errors). Good rows have none; the others are the
    quarantine."""
    return once(_parsed(items), "errors", _errors(allow_sensitive)).drop("v")


def signal_errors(validated: DataFrame) -> DataFrame:
    return validated.select("batch_id", "idx", F.explode("errors").alias("error"))


def accepted_signals(validated: DataFrame, strict: bool = True) -> DataFrame:
    """Rows to ingest. Strict mode drops the whole batch of any bad row, else only the row itself."""
    good = validated.where(F.size("errors") == 0)
    if strict:
        bad = validated.where(F.size("errors") > 0).select("batch_id").distinct()
        good = good.join(bad, "batch_id", "left_anti")
    return good


def signals_to_drafts(signals: DataFrame) -> DataFrame:
    """(batch_id, idx, type, title, date, decider, sources, summary, status). Private signals are redacted."""
    s = _parsed(signals)
    private = _str("privacy_class").isin("pii", "sensitive")
    summary = F.when(private, F.concat(F.lit("[redacted: "), _str("privacy_class"), F.lit(" signal]"))).otherwise(_str("content_summary"))
    head = F.when(private, F.concat(_str("privacy_class"), F.lit(" signal"))).otherwise(_str("content_summary"))
    refs = F.transform(F.try_variant_get("v", "$.raw_refs", "array<variant>"),
                       lambda r: F.concat(F.lit("`"), F.try_variant_get(r, "$.url_or_path", "string"), F.lit("`")))
    own = F.concat(F.lit("`signal:"), _str("id"), F.lit("`"))
    return s.select(
        "batch_id", "idx", F.lower(F.coalesce(_str("type"), F.lit("pdr"))).alias("type"),
        F.concat(F.lit("Signal ["), _str("source"), F.lit("/"), _str("product_area"), F.lit("]: "), F.left(head, F.lit(72))).alias("title"),
        F.left(_str("created_at"), F.lit(10)).alias("date"), F.coalesce(_str("suggested_owner"), F.lit("unknown")).alias("decider"),
        F.when(private, own).otherwise(F.array_join(F.concat(F.array(own), refs), "; ")).alias("sources"),
        summary.alias("summary"), F.lit("Proposed").alias("status"))


def decisions_to_drafts(items: DataFrame, today: str) -> DataFrame:
    """External decisions to Proposed rows: outcome draft, skipped (no title) or error (unknown type)."""
    d = _parsed(items)
    typ = F.lower(F.coalesce(_str("type"), F.lit("adr")))
    no_title = _str("title").isNull()
    date = F.coalesce(_str("date"), F.lit(today))
    source = F.coalesce(F.concat(F.lit("`"), _str("source"), F.lit("` (external; **unconfirmed** — pending human review)")),
                        F.lit("(external source; **unconfirmed** — pending human review)"))
    return d.select(
        "batch_id", "idx", F.when(no_title, "skipped").when(~typ.isin(list(config.RECORD_TYPES)), "error").otherwise("draft").alias("outcome"),
        typ.alias("type"), _str("title").alias("title"), date.alias("date"), F.coalesce(_str("decider"), F.lit("unknown")).alias("decider"),
        source.alias("sources"), F.lit("Proposed").alias("status"))
