"""Which decision is current for a query: literal matches, chain ends, aliases, conflicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.functions import text as tx
from decisionlake.operators import alias as al
from decisionlake.operators import graph
from decisionlake.operators.contains import contains_join
from decisionlake.session import cut


@dataclass
class Library:
    """Everything about a set of libraries that does not depend on the queries, computed once."""

    records: DataFrame
    resolved: DataFrame
    invalid: DataFrame
    amap: DataFrame

    @classmethod
    def of(cls, records: DataFrame) -> "Library":
        ids = cut(graph.nodes(records))
        resolved = cut(graph.resolve_current(records, ids))
        invalid = cut(graph.invalid_chains(records, resolved, ids))
        return cls(records, resolved, invalid, cut(al.alias_map(records, resolved, invalid)))


def haystacks(records: DataFrame) -> DataFrame:
    return records.select("lib", "rec_id", "type", tx.literal_haystack(
        F.col("title"), F.col("field_text"), F.col("body")).alias("hay"))


def literal_matches(records: DataFrame, queries: DataFrame) -> DataFrame:
    """(lib, query_id, rec_id) where the record's text holds the lower-cased query."""
    needles = queries.select("lib", "query_id", F.lower(F.coalesce("text", F.lit(""))).alias("needle"))
    hits = contains_join(haystacks(records), needles, ["lib", "rec_id"], ["lib", "query_id"],
                         text="hay", needle="needle", scope=["lib"])
    if "type" in queries.columns:
        hits = (hits.join(queries.select("lib", "query_id", F.col("type").alias("want")), ["lib", "query_id"])
                .join(records.select("lib", "rec_id", "type").distinct(), ["lib", "rec_id"])
                .where("want is null or want = type").select("lib", "query_id", "rec_id"))
    return hits


@dataclass
class Resolution:
    summary: DataFrame     # one row per query
    endpoints: DataFrame   # (lib, query_id, endpoint, via, alias)
    ambiguous: DataFrame   # (lib, query_id, alias, candidate)
    matches: DataFrame     # (lib, query_id, rec_id)


def resolve(library: Library, queries: DataFrame, use_aliases: bool = True) -> Resolution:
    records = library.records
    matches = cut(literal_matches(records, queries))
    accepted = records.where(F.lower("status").startswith("accepted")).select("lib", "rec_id", "type").distinct()
    literal = (matches.join(library.resolved.select("lib", "rec_id", "endpoint"), ["lib", "rec_id"])
               .join(accepted.select("lib", F.col("rec_id").alias("endpoint")).distinct(), ["lib", "endpoint"], "left_semi")
               .select("lib", "query_id", "endpoint").distinct())
    literal = cut(literal)

    asked = queries.where("coalesce(text, '') <> ''")
    if not use_aliases:
        asked = asked.where(F.lit(False))
    named = al.match_aliases(asked, library.amap)
    # an alias is counted once, not once a query that names it
    ways = [F.count(F.lit(1)).alias("ways"), F.min("target_id").alias("only_id")]
    goals = library.amap
    if "type" in queries.columns:
        goals = goals.join(accepted.withColumnRenamed("rec_id", "target_id"), ["lib", "target_id"])
        wants = queries.select("lib", "query_id", F.col("type").alias("want"))
        named = named.join(wants, ["lib", "query_id"])
        sizes = goals.groupBy("lib", "alias").agg(*ways).withColumn("want", F.lit(None).cast("string")).unionByName(
            goals.groupBy("lib", "alias", F.col("type").alias("want")).agg(*ways).where("want is not null"))
        sizes = sizes.select(F.col("lib").alias("at"), F.col("alias").alias("called"), F.col("want").alias("of"), "ways", "only_id")
        found = named.join(sizes, (F.col("lib") == F.col("at")) & (F.col("alias") == F.col("called")) & F.col("want").eqNullSafe(F.col("of")))
    else:
        found = named.join(goals.groupBy("lib", "alias").agg(*ways), ["lib", "alias"])
    counted = found.groupBy("lib", "query_id", "alias").agg(F.sum("ways").alias("n"), F.min("only_id").alias("only_id"))
    single = counted.where("n = 1").select("lib", "query_id", F.col("only_id").alias("endpoint"), "alias")
    via = single.join(literal, ["lib", "query_id", "endpoint"], "left_anti")
    clash = counted.where("n > 1").select("lib", "query_id", "alias")
    targets = named.join(goals, ["lib", "alias"])
    if "type" in queries.columns:
        targets = targets.where("want is null or want = type").drop("want", "type")
    ambiguous = clash.join(targets, ["lib", "query_id", "alias"]).select(
        "lib", "query_id", "alias", F.col("target_id").alias("candidate"))
    broken = al.match_aliases(asked, al.invalid_aliases(records, library.invalid))

    key = ["lib", "query_id"]
    n_match = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("matched_records"))
    n_lit = literal.groupBy(*key).agg(F.count(F.lit(1)).alias("literal_endpoints"))
    n_via = via.groupBy(*key).agg(F.count_distinct("endpoint").alias("alias_endpoints"))
    n_clash = clash.groupBy(*key).agg(F.count(F.lit(1)).alias("alias_conflicts"))
    n_bad = broken.groupBy(*key).agg(F.count(F.lit(1)).alias("invalid_aliases"))
    out = queries.select(*key, "text")
    for part in (n_match, n_lit, n_via, n_clash, n_bad):
        out = out.join(part, key, "left")
    out = out.fillna(0, ["matched_records", "literal_endpoints", "alias_endpoints", "alias_conflicts", "invalid_aliases"])
    note = F.array_join(F.array_compact(F.array(
        F.when(F.col("literal_endpoints") > 1, "conflict")
        .when((F.col("literal_endpoints") == 0) & (F.col("alias_endpoints") == 0), "no current record"),
        F.when(F.col("alias_conflicts") > 0, "ambiguous codename"),
        F.when(F.col("invalid_aliases") > 0, "invalid supersession chain"))), "; ")
    summary = out.select(
        *key, "text", "matched_records", "literal_endpoints", "alias_endpoints", "alias_conflicts", "invalid_aliases",
        (F.col("literal_endpoints") > 1).alias("conflict"),
        ((F.col("literal_endpoints") + F.col("alias_endpoints") == 1) & (F.col("alias_conflicts") == 0)
         & (F.col("invalid_aliases") == 0)).alias("resolved_unique"),
        note.alias("note"))
    endpoints = literal.select(*key, "endpoint", F.lit("literal").alias("via"), F.lit("").alias("alias")).unionByName(
        via.select(*key, "endpoint", F.lit("alias").alias("via"), "alias"))
    return Resolution(summary, endpoints, ambiguous, matches)


def resolve_query(library: Library, queries: DataFrame, use_aliases: bool = True) -> DataFrame:
    """One row per (query, endpoint) with the endpoint's own data, what it replaced and the query's flags;
    a query without an endpoint keeps one row."""
    res = resolve(library, queries, use_aliases)
    ends = cut(res.endpoints)
    # only what is an endpoint is told; a record's columns are not carried through the aggregate for the others
    named = ends.select("lib", F.col("endpoint").alias("rec_id")).distinct()
    info = library.records.join(named, ["lib", "rec_id"], "left_semi").groupBy("lib", F.col("rec_id").alias("endpoint")).agg(
        F.min("title").alias("title"), F.min(tx.effective_date(F.col("date"), F.col("decided_originally"))).alias("date"),
        *[F.min(c).alias(c) for c in ("status", "path", "aliases")])
    replaced = graph.immediately_replaced(
        library.records, ends.where("via = 'literal'").select("lib", F.col("endpoint").alias("rec_id")))
    rows = (ends.join(info, ["lib", "endpoint"])
            .join(replaced.select("lib", F.col("rec_id").alias("endpoint"), "replaced_id", F.lit("literal").alias("via")),
                  ["lib", "endpoint", "via"], "left"))
    return res.summary.join(rows, ["lib", "query_id"], "left").select(
        "lib", "query_id", "matched_records", "conflict", "resolved_unique", "note",
        "endpoint", "via", "alias", "title", "date", "status", "path", "aliases", "replaced_id")


def resolve_trail(library: Library, res: Resolution) -> DataFrame:
    """The superseded ids each literal endpoint was reached from: (lib, query_id, endpoint, superseded_id).

    What lies between a match and its endpoint is marked by doubling: in round k every marked record marks the one 2^k steps on.
    A query holds each record once, however many of its matches lead over it, so rounds and rows follow the output, never the
    number of matches times the length of their chains.
    """
    lit = res.endpoints.where("via = 'literal'").select("lib", "query_id", "endpoint")
    origins = cut(res.matches.join(library.resolved.where("depth > 0").select("lib", "rec_id", "endpoint", "depth"), ["lib", "rec_id"])
                  .join(lit, ["lib", "query_id", "endpoint"], "left_semi"))
    top = origins.agg(F.max("depth")).first()[0] or 0
    marked = origins.select("lib", "query_id", "endpoint", F.col("rec_id").alias("at")).distinct()
    jump = graph.successors(library.records)
    reach = 1
    while reach < top:                                      # the endpoint itself need not be reached
        marked = cut(marked.unionByName(marked.join(jump, ["lib", "at"]).select("lib", "query_id", "endpoint", F.col("to").alias("at"))).distinct())
        reach *= 2
        if reach < top:
            jump = cut(jump.join(jump.select("lib", F.col("at").alias("to"), F.col("to").alias("to2")), ["lib", "to"]).select("lib", "at", F.col("to2").alias("to")))
    return marked.where("at <> endpoint").select("lib", "query_id", "endpoint", F.col("at").alias("superseded_id"))


def ambiguous_topics(library: Library) -> DataFrame:
    """Accepted records whose own title does not resolve to exactly themselves.

    (lib, rec_id, title, collisions). Titles are resolved once each, so equal titles never pair up; the
    ids behind ``collisions`` are the endpoints and alias candidates of that title.
    """
    acc = library.records.where(tx.is_accepted(F.col("status"))).select("lib", "rec_id", "title").distinct()
    topics = acc.select("lib", F.col("title").alias("query_id"), F.col("title").alias("text")).distinct()
    res = resolve(library, topics)
    ends = res.endpoints.select("lib", "query_id", "endpoint").distinct()
    cand = ends.unionByName(res.ambiguous.select("lib", "query_id", F.col("candidate").alias("endpoint"))).distinct()
    sizes = cand.groupBy("lib", "query_id").agg(F.count(F.lit(1)).alias("n_cand"))
    mine = acc.withColumnRenamed("title", "query_id")
    own_end = ends.withColumnRenamed("endpoint", "rec_id").withColumn("own_end", F.lit(1))
    own_cand = cand.withColumnRenamed("endpoint", "rec_id").withColumn("own_cand", F.lit(1))
    rows = (mine.join(res.summary.select("lib", "query_id", "resolved_unique"), ["lib", "query_id"])
            .join(sizes, ["lib", "query_id"], "left")
            .join(own_end, ["lib", "query_id", "rec_id"], "left").join(own_cand, ["lib", "query_id", "rec_id"], "left"))
    return rows.where(~(F.col("resolved_unique") & F.col("own_end").isNotNull())).select(
        "lib", "rec_id", F.col("query_id").alias("title"),
        (F.coalesce("n_cand", F.lit(0)) - F.coalesce("own_cand", F.lit(0))).cast("bigint").alias("collisions"))
