"""Codenames: alias map, glossary, phrase matching in queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions import text as tx
from decisionlake.session import cut


def declared_aliases(records: DataFrame) -> DataFrame:
    """(lib, alias, rec_id)."""
    return records.select("lib", F.explode(tx.parse_aliases(F.col("aliases"))).alias("alias"), "rec_id").distinct()


def alias_map(records: DataFrame, resolved: DataFrame, invalid: DataFrame) -> DataFrame:
    """alias -> current Accepted endpoints, long form: (lib, alias, target_id). Aliases of records with a
    broken chain contribute nothing."""
    live = records.where(F.lower("status").startswith("accepted")).select("lib", F.col("rec_id").alias("endpoint"))
    ends = resolved.select("lib", "rec_id", "endpoint").join(live.distinct(), ["lib", "endpoint"], "left_semi")
    return (declared_aliases(records)
            .join(invalid.select("lib", "rec_id"), ["lib", "rec_id"], "left_anti")
            .join(ends, ["lib", "rec_id"])
            .select("lib", "alias", F.col("endpoint").alias("target_id")).distinct())


def alias_collisions(amap: DataFrame) -> DataFrame:
    """Aliases with several current decisions: (lib, alias, targets)."""
    return amap.groupBy("lib", "alias").agg(F.count(F.lit(1)).alias("targets")).where("targets > 1")


def invalid_aliases(records: DataFrame, invalid: DataFrame) -> DataFrame:
    """(lib, alias, rec_id) dropped because the declaring record's chain is broken."""
    return declared_aliases(records).join(invalid.select("lib", "rec_id"), ["lib", "rec_id"], "left_semi")


def glossary(records: DataFrame, amap: DataFrame) -> DataFrame:
    """(lib, alias, target_id, title, status, ambiguous)."""
    info = records.groupBy("lib", F.col("rec_id").alias("target_id")).agg(
        F.min("title").alias("title"), F.min("status").alias("status"))
    clash = cut(alias_collisions(amap).select("lib", "alias", F.lit(True).alias("clash")))      # an alias of very many targets can be split in the join
    return (amap.join(clash, ["lib", "alias"], "left").join(info, ["lib", "target_id"])
            .select("lib", "alias", "target_id", "title", "status",
                    F.coalesce("clash", F.lit(False)).alias("ambiguous")))


def match_aliases(queries: DataFrame, aliases: DataFrame, stoplist: list[str] | None = None) -> DataFrame:
    """Alias phrases present in each query text: (lib, query_id, alias).

    Whole-token phrases, the longest at each position, left to right without overlap. A position is looked up by its token
    first; only the lengths of aliases that begin with it are tried there, so a long alias costs nothing
    where its first token is not, and positions no alias begins at are dropped before they are joined again. Only
    the choice among a single query's own candidates is folded.
    """
    stop = [" ".join(s.lower().split()) for s in (config.ALIAS_STOPLIST if stoplist is None else stoplist)]
    known = aliases.select("lib", "alias").distinct().where(~F.col("alias").isin(stop))
    words = F.split("alias", " ")
    begins = known.select("lib", F.get(words, F.lit(0)).alias("tok"), F.size(words).alias("len")).distinct().groupBy("lib", "tok").agg(
        F.collect_set("len").alias("lengths"), F.max("len").alias("longest"))      # as many lengths as differ
    q = queries.select("lib", "query_id", F.split(tx.normalize_alias(F.col("text")), " ").alias("toks"))
    q = q.select("lib", "query_id", "toks", F.posexplode("toks").alias("at", "tok")).join(begins, ["lib", "tok"])
    fits = F.filter("lengths", lambda n: F.col("at") + n <= F.size("toks"))
    q = q.select("lib", "query_id", (F.col("at") + 1).alias("start"), F.slice("toks", F.col("at") + 1, F.col("longest")).alias("ahead"), F.explode(fits).alias("len"))
    grams = q.select("lib", "query_id", "start", "len", F.array_join(F.slice("ahead", F.lit(1), F.col("len")), " ").alias("alias"))
    hits = grams.join(known, ["lib", "alias"])
    cands = hits.groupBy("lib", "query_id").agg(F.array_sort(F.collect_list(
        F.struct("start", (-F.col("len")).alias("neg"), "alias"))).alias("c"))
    folded = F.aggregate(
        "c", F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(x["start"] > acc["end"], F.struct(
            (x["start"] - x["neg"] - 1).cast("int").alias("end"),
            F.array_append(acc["out"], x["alias"]).alias("out"))).otherwise(acc),
        lambda acc: F.array_distinct(acc["out"]))
    return cands.select("lib", "query_id", F.explode(folded).alias("alias"))
