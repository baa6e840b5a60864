"""Timestamp helpers. Everything is UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_KEYS = ("timestamp", "ts", "created_at", "time")


# fixed value: the ISO 8601 forms that are times: calendar and week dates, extended or basic, with an optional time of day and zone
_ISO = (r"^(\d{4})(-?)(?:(\d{2})\2(\d{2})|W(\d{2})(?:\2(\d))?)"
        r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(?:(Z)|([+-]\d{2})(?::?(\d{2}))?)?)?$")


def _iso(s: Column) -> Column:
    """The ISO forms -> timestamp; without a zone it is UTC."""
    g = lambda i: F.regexp_extract(s, _ISO, i)
    some = lambda i, other: F.coalesce(F.nullif(g(i), F.lit("")), F.lit(other))
    week, day = g(5).try_cast("int"), some(6, "1").try_cast("int")
    monday = F.date_trunc("week", F.concat(g(1), F.lit("-01-04")).try_cast("timestamp_ntz")).cast("date")
    of_week = F.date_add(monday, (week - 1) * 7 + day - 1)
    of_week = F.when(day.between(1, 7) & (F.extract(F.lit("YEAROFWEEK"), of_week) == g(1).try_cast("int")) & (week > 0), of_week)
    date = F.when(g(5) != "", of_week.cast("string")).otherwise(F.concat_ws("-", g(1), g(3), g(4)))
    zone = F.when(g(12) == "", "Z").otherwise(F.concat(g(12), F.lit(":"), some(13, "00")))
    whole = F.concat(date, F.lit("T"), some(7, "00"), F.lit(":"), some(8, "00"), F.lit(":"), some(9, "00"), F.lit("."), F.left(F.rpad(some(10, "0"), 6, "0"), F.lit(6)), zone)
    return F.when(s.rlike(_ISO), whole.try_cast("timestamp"))


def normalize_ts(value: Column) -> Column:
    """ISO text, decimal number, epoch seconds or epoch milliseconds (above 1e12) -> timestamp; exponents are no times."""
    s = F.trim(value)
    number = F.when(s.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), s.try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000.0).otherwise(number)
    from_number = F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint"))
    return F.when(number.isNotNull(), from_number).otherwise(_iso(s))


def first_ts(obj: Column) -> Column:
    """First parseable of the known keys of a variant object, then the same inside ``payload``, however deep."""
    def here(v: Column) -> Column:
        texts = F.array_compact(F.array(*[F.try_variant_get(v, f"$.{key}", "string") for key in TS_KEYS]))
        return F.get(F.filter(F.transform(texts, normalize_ts), lambda t: t.isNotNull()), F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        inner = F.try_variant_get(acc["v"], "$.payload", "variant")
        return F.struct(inner.alias("v"), F.coalesce(acc["t"], here(inner)).alias("t"))

    nested = F.try_variant_get(obj, "$.payload", "variant").isNotNull()      # few rows have one, so few are written as text
    levels = F.when(nested, F.regexp_count(F.to_json(obj), F.lit('"payload"'))).otherwise(0)
    deep = F.aggregate(F.sequence(F.lit(1), levels), F.struct(obj.alias("v"), F.lit(None).cast("timestamp").alias("t")), step, lambda acc: acc["t"])
    return F.coalesce(here(obj), F.when(levels > 0, deep))


def iso_day(value: Column) -> Column:
    """Strict YYYY-MM-DD text -> date, NULL for any other text."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def utc_day(ts: Column) -> Column:
    """The day of a timestamp in UTC, whatever the session time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts.cast("timestamp")) / 86_400_000_000).cast("int"))
