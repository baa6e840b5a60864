"""Cycles and trails on shapes where rounds or rows could follow the length of a chain."""
import random

import pytest
from pyspark.sql import functions as F

from decisionlake.operators import graph, resolve
from decisionlake.operators.alias import match_aliases

EDGE = "lib string, src_id string, dst_id string"


def on_cycles(edges):
    """Nodes of components that hold a cycle, by Kosaraju's two walks."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)

    def walk(start, ways, seen):
        order, stack = [], [(start, iter(ways.get(start, [])))]
        seen.add(start)
        while stack:
            n, rest = stack[-1]
            for m in rest:
                if m not in seen:
                    seen.add(m)
                    stack.append((m, iter(ways.get(m, []))))
                    break
            else:
                order.append(stack.pop()[0])
        return order
    seen, order = set(), []
    for n in [*out, *back]:
        if n not in seen:
            order += walk(n, out, seen)
    seen, found = set(), {}
    for n in reversed(order):
        if n not in seen:
            part = walk(n, back, seen)
            if len(part) > 1 or (n, n) in edges:
                found.update(dict.fromkeys(part, min(part)))
    return found


def check(spark, edges):
    got = {r.rec_id: r.cycle_id for r in graph.supersede_cycles(spark.createDataFrame([("l", a, b) for a, b in edges], EDGE)).collect()}
    want = on_cycles(edges)
    assert got.keys() == want.keys()
    same = {}
    for n, c in got.items():
        same.setdefault(c, set()).add(want[n])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


@pytest.mark.parametrize("seed, ways", [(1, [0, 1, 1, 2]), (2, [1, 1, 2, 3]), (3, [2, 2, 3])])
def test_general_cycles(spark, seed, ways):
    rng = random.Random(seed)
    n = 40
    check(spark, {(f"{i:03d}", f"{rng.randrange(n):03d}") for i in range(n) for _ in range(rng.choice(ways))})


def counted(monkeypatch):
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    return rounds


def test_a_long_cycle_of_forks_takes_few_rounds(spark, monkeypatch):
    rounds, n = counted(monkeypatch), 20_000
    name = lambda i: F.lpad(i.cast("string"), 6, "0")
    i = F.col("id")
    ring = spark.range(n).select(F.lit("l").alias("lib"), name(i).alias("src_id"), name((i + 1) % n).alias("dst_id"))
    dead = spark.range(n).select(F.lit("l").alias("lib"), name(i).alias("src_id"), F.concat(F.lit("x"), i.cast("string")).alias("dst_id"))
    tail = spark.range(n).select(F.lit("l").alias("lib"), F.concat(F.lit("t"), i.cast("string")).alias("src_id"), F.when(i + 1 < n, F.concat(F.lit("t"), (i + 1).cast("string"))).otherwise("000000").alias("dst_id"))
    found = graph.supersede_cycles(ring.unionByName(dead).unionByName(tail))
    assert found.agg(F.count("rec_id"), F.count_distinct("cycle_id")).first() == (n, 1) and len(rounds) <= 60


def test_a_trail_follows_its_output(spark, monkeypatch):
    rounds, n = counted(monkeypatch), 20_000
    i = F.col("id")
    rec = lambda k: F.concat(F.lit("ADR "), F.when(k < 10_000, F.lpad(k.cast("string"), 4, "0")).otherwise(k.cast("string")))
    records = spark.range(n).select(F.lit("l").alias("lib"), rec(i).alias("rec_id"), F.when(i + 1 < n, F.concat(F.lit("Superseded by "), rec(i + 1))).otherwise("Accepted").alias("status"))
    library = resolve.Library(records, graph.resolve_current(records), None, None)
    end = f"ADR {n - 1:05d}"
    matches = records.select("lib", F.lit(1).alias("query_id"), "rec_id").unionByName(spark.range(n - 10, n).select(F.lit("l").alias("lib"), F.lit(2).alias("query_id"), rec(i).alias("rec_id")))
    ends = spark.createDataFrame([("l", q, end, "literal", "") for q in (1, 2)], "lib string, query_id int, endpoint string, via string, alias string")
    trail = resolve.resolve_trail(library, resolve.Resolution(None, ends, None, matches))
    assert {tuple(r) for r in trail.groupBy("query_id").count().collect()} == {(1, n - 1), (2, 9)} and len(rounds) <= 60


def test_a_long_alias_costs_only_where_it_begins(spark):
    long = " ".join(["zulu"] + [f"t{i}" for i in range(999)])
    aliases = spark.createDataFrame([("l", long), ("l", "alpha"), ("l", "alpha beta"), ("l", "api"), ("m", "beta")], "lib string, alias string")
    queries = spark.createDataFrame([("l", 1, "Alpha beta alpha"), ("l", 2, f"see {long} now"), ("l", 3, "zulu t0"), ("m", 4, "alpha beta"), ("l", 5, "the api"), ("l", 6, None)],
                                    "lib string, query_id int, text string")
    got = {(r.query_id, r.alias) for r in match_aliases(queries, aliases).collect()}
    assert got == {(1, "alpha beta"), (1, "alpha"), (2, long), (4, "beta")}
