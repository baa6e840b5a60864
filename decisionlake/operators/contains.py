"""Substring join without a nested loop over all pairs.

Texts are cut into pieces at a separator. If a text holds a needle of several pieces, then each inner piece of the needle is a
whole piece of the text, its first piece ends one and its last piece starts one; a needle of one piece lies inside one, and so does
every gram of it. These are the needle's keys, each with a role.

The needles come first: the keys that any of them asks for set bits in a map, which the scan of the texts reads by a scalar subquery:
as a constant it would be written out in every description of the plan that the driver keeps.
Texts are reduced to distinct pieces and their counts before keys are taken from them, and a key that no needle asks for is dropped
there. From the counts each needle picks its rarest key. Only the pieces that hold a picked key set bits in a second map; by one look
at it a piece of text is kept or dropped, and what is kept meets the needles in an equi-join. The maps grow with what they hold up to a
bound; one that is too full lets pieces through, each once a text, which the join drops. Every candidate is verified, on the piece
where the needle is one piece, else on the full text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.functions.content import once
from decisionlake.session import cut_unpacked as cut

GRAMS = (8, 3, 2, 1)   # sizes of grams; a needle of one piece is looked up by the longest that fits
KEY = 64               # longest key; a longer piece is looked up by its end
BYTES = 1 << 17        # of the smallest map
MOST = 1 << 23         # of the largest


def _grams(text: Column, size: int) -> Column:
    n = F.length(text) - (size - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(n >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _key(role: str, key: Column) -> Column:
    return F.struct(F.lit(role).alias("__role"), key.alias("__key"))


def _needle_keys(pieces: Column) -> Column:
    """(role, key) of every non-empty piece: exact, suffix, prefix, or the grams of a lone piece."""
    n = F.size(pieces)
    ends = F.transform(pieces, lambda p, i: F.when(i == 0, _key("suffix", F.right(p, F.lit(KEY))))
                       .when(i == n - 1, _key("prefix", F.left(p, F.lit(KEY)))).otherwise(_key("exact", p)))
    lone = F.get(pieces, F.lit(0))
    grams = F.array().cast("array<string>")
    for size in reversed(GRAMS):
        grams = F.when(F.length(lone) >= size, _grams(lone, size)).otherwise(grams)
    inside = F.transform(grams, lambda g: _key("inside", g))
    return F.array_distinct(F.filter(F.when(n == 1, inside).otherwise(ends), lambda k: k["__key"] != ""))


def _piece_keys(tok: Column, lengths: dict[str, list[int]]) -> Column:
    """The keys a piece of text may be asked by: only of the roles and lengths that some needle has."""
    def ends(role: str, end) -> Column:
        fits = F.filter(F.array(*[F.lit(k) for k in lengths[role]]), lambda k: k <= F.length(tok))
        return F.transform(fits, lambda k: _key(role, end(tok, k)))

    keys = [F.array(_key("exact", tok))] if "exact" in lengths else []
    keys += [ends(role, end) for role, end in (("suffix", F.right), ("prefix", F.left)) if role in lengths]
    keys += [F.transform(_grams(tok, size), lambda g: _key("inside", g)) for size in lengths.get("inside", [])]
    return F.concat(*keys) if keys else F.array().cast("array<struct<__role:string,__key:string>>")


def _bit(keys: list, size: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(8 * size))


def _map_of(rows: DataFrame, keys: list) -> bytes:
    """The map of these rows, about a bit in ten set while it may still grow; the driver sees a row for eight bytes of it at most."""
    n, size = rows.count(), BYTES
    while size < MOST and 10 * n > 7 * size:
        size *= 2
    bit = _bit(keys, size)
    bits = rows.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    known = np.zeros(-(-size // 8), "<i8")
    known[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return known.tobytes()[:size]


def _perhaps_in(spark: SparkSession, known: bytes, keys: list) -> Column:
    bit = _bit(keys, len(known))
    words = pa.array([np.frombuffer(known.ljust(-(-len(known) // 8) * 8, b"\0"), "<i8")], pa.list_(pa.int64()))
    word = F.get(spark.createDataFrame(pa.table({"words": words})).scalar(), F.floor(bit / 64).cast("int"))
    return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def contains_join(texts: DataFrame, needles: DataFrame, text_keys: list[str], needle_keys: list[str],
                  text: str = "text", needle: str = "needle", scope: list[str] | None = None,
                  sep: str = r"\s+") -> DataFrame:
    """Pairs (scope, text_keys, needle_keys) where the text holds the needle.

    ``scope`` columns are on both sides and must be equal; an empty needle matches every text of its scope.
    """
    spark, scope = texts.sparkSession, scope or []
    tk = [c for c in text_keys if c not in scope]
    nk = [c for c in needle_keys if c not in scope]
    t = texts.select(*scope, *tk, F.col(text).alias("__text"))
    n = needles.select(*scope, *nk, F.col(needle).alias("__needle"))

    parts = cut(once(n, "__keys", _needle_keys(F.split("__needle", sep))))
    options = parts.select(*scope, *nk, "__needle", F.explode("__keys").alias("__k")).select(*scope, *nk, "__needle", "__k.__role", "__k.__key")
    asked = cut(options.select(*scope, "__role", "__key").distinct())
    lengths: dict[str, list[int]] = {}                       # at most KEY numbers a role
    for r in asked.select("__role", F.when(F.col("__role") != "exact", F.length("__key")).alias("n")).distinct().collect():
        lengths.setdefault(r["__role"], []).append(r["n"])

    # empty or separator-only needles: nothing to look up, the scope itself is the candidate set
    bare = parts.where(F.size("__keys") == 0).select(*scope, *nk, "__needle")
    every = None
    if not bare.isEmpty():                                   # then every text of the scope may be part of the answer
        left, right, on = t, bare, scope
        if not scope:
            left, right, on = t.withColumn("__one", F.lit(1)), bare.withColumn("__one", F.lit(1)), ["__one"]
        every = left.join(right, on).where(F.contains("__text", "__needle")).select(*scope, *tk, *nk)
    if not lengths and every is not None:
        return every

    pieces = t.select(*scope, *tk, F.explode(F.array_distinct(F.filter(F.split("__text", sep), lambda p: p != ""))).alias("__tok"))
    known = _map_of(asked, [*scope, "__role", "__key"])
    counted = pieces.groupBy(*scope, "__tok").agg(F.count(F.lit(1)).alias("__n"))
    listed = counted.select(*scope, "__tok", "__n", F.explode(_piece_keys(F.col("__tok"), lengths)).alias("__k")).select(
        *scope, "__tok", "__n", "__k.__role", "__k.__key").where(_perhaps_in(spark, known, [*scope, "__role", "__key"]))
    matched = cut(listed.join(asked, [*scope, "__role", "__key"]))
    cost = matched.groupBy(*scope, "__role", "__key").agg(F.sum("__n").alias("__cost"))
    # a key that is in no text has cost 0 and no hits: its needle matches nothing
    chosen = options.join(cost, [*scope, "__role", "__key"], "left").groupBy(*scope, *nk).agg(
        F.min_by(F.struct("__role", "__key"), F.coalesce("__cost", F.lit(0))).alias("__k"), F.first("__needle").alias("__needle"))
    probes = cut(chosen.select(*scope, *nk, "__needle", "__k.__role", "__k.__key"))

    wanted = cut(matched.join(probes, [*scope, "__role", "__key"], "left_semi").select(*scope, "__tok", "__role", "__key"))
    held = _map_of(wanted.select(*scope, "__tok").distinct(), [*scope, "__tok"])
    hits = cut(pieces.where(_perhaps_in(spark, held, [*scope, "__tok"])).join(wanted, [*scope, "__tok"]).select(*scope, *tk, "__tok", "__role", "__key"))
    pairs = hits.join(probes, [*scope, "__role", "__key"])
    lone = pairs.where((F.col("__role") == "inside") & F.contains("__tok", "__needle")).select(*scope, *tk, *nk).distinct()
    several = pairs.where("__role <> 'inside'").select(*scope, *tk, *nk, "__needle").distinct()
    verified = several.join(t, [*scope, *tk]).where(F.contains("__text", "__needle")).select(*scope, *tk, *nk)
    found = lone.unionByName(verified)
    return found if every is None else found.unionByName(every)
