"""Steps whose work must follow the input: maps of asked pieces, aliases with many targets, gate counts, scores by document."""
import pytest

from decisionlake.operators import contains, gates, resolve
from decisionlake.operators import retrieval as rt


@pytest.mark.parametrize("size", [4, 1 << 17])
def test_substrings_with_full_and_wide_maps(spark, monkeypatch, size):
    monkeypatch.setattr(contains, "BYTES", size)
    monkeypatch.setattr(contains, "MOST", 2 * size)
    texts = [("p", i, f"entity {i} urgent: v{i % 7} of code{i} code{i}") for i in range(60)] + [("q", 1, "entity 7 urgent: v7"), ("q", 2, None), (None, 3, "entity 7")]
    needles = [("p", i, n) for i, n in enumerate(["entity 7 ", "7 urgent: v", "code1", "de5 ", "absent", "y 1", "urgent: v3 of code3", "entity", "7 urgent: v"])] + [("q", 50, "7 URGENT".lower())]
    got = contains.contains_join(spark.createDataFrame(texts, "g string, i long, text string"), spark.createDataFrame(needles, "g string, j long, needle string"),
                                 ["g", "i"], ["g", "j"], scope=["g"])
    want = sorted((g, i, j) for g, i, t in texts for h, j, n in needles if g == h and t is not None and n in t)
    assert sorted((r["g"], r["i"], r["j"]) for r in got.collect()) == want


def test_the_map_grows_with_its_keys(spark):
    assert len(contains._map_of(spark.range(10), ["id"])) == contains.BYTES
    assert len(contains._map_of(spark.range(300000), ["id"])) == 4 * contains.BYTES


def library(spark):
    ids = [("L", f"ADR {i}", "adr", "Accepted") for i in range(4)] + [("L", "PDR 1", "pdr", "Accepted"), ("L", "PDR 1", "adr", "Accepted")]
    records = spark.createDataFrame([(*r, r[1], "", "", "", "") for r in ids],
                                    "lib string, rec_id string, type string, status string, title string, field_text string, body string, aliases string, prose string")
    resolved = records.selectExpr("lib", "rec_id", "rec_id endpoint", "0L depth", "'live' terminal").distinct()
    amap = [("L", "many", f"ADR {i}") for i in range(4)] + [("L", "one", "ADR 2"), ("L", "mixed", "PDR 1"), ("L", "mixed", "ADR 3")]
    return resolve.Library(records, resolved, spark.createDataFrame([], "lib string, rec_id string, reason string"),
                           spark.createDataFrame(amap, "lib string, alias string, target_id string"))


def test_alias_counts(spark):
    asks = [(1, "the many one", None), (2, "mixed", None), (3, "mixed", "pdr"), (4, "mixed one", "adr"), (4, "mixed one", "adr"), (5, "many", "pdr"), (6, "one one", "bdr")]
    q = spark.createDataFrame([("L", *a) for a in asks], "lib string, query_id long, text string, type string")
    lib = library(spark)
    targets = {"many": [f"ADR {i}" for i in range(4)], "one": ["ADR 2"], "mixed": ["PDR 1", "ADR 3"]}
    kinds = {"PDR 1": ["adr", "pdr"]}
    for typed in (False, True):
        want = {}
        for query, text, kind in asks:
            rows = want.setdefault(query, {})
            for word in set(text.split()) & set(targets):
                every = [t for t in targets[word] for k in (kinds.get(t, ["adr"]) if typed else [None]) if not typed or kind in (None, k)]
                rows.setdefault(word, []).extend(every)
        if not typed:                                       # a query that is there twice counts once where no type is looked up
            want = {k: {w: targets[w] for w in v} for k, v in want.items()}
        res = resolve.resolve(lib, q if typed else q.drop("type"))
        ends = {(r["query_id"], r["endpoint"], r["alias"]) for r in res.endpoints.where("via = 'alias'").collect()}
        assert ends == {(k, t[0], w) for k, v in want.items() for w, t in v.items() if len(t) == 1}
        clash = {(r["query_id"], r["alias"], r["candidate"]) for r in res.ambiguous.collect()}
        assert clash == {(k, w, x) for k, v in want.items() for w, t in v.items() if len(t) > 1 for x in t}


def test_an_alias_with_many_targets_is_not_spread_over_its_queries(spark):
    plan = resolve.resolve(library(spark), spark.createDataFrame([("L", 1, "many")], "lib string, query_id long, text string")).summary
    assert "ways" in plan._jdf.queryExecution().executedPlan().toString()


def test_gate_counts_are_the_rows_of_gated_paths(spark):
    records = spark.createDataFrame([("L", f"ADR {i % 5}", "adr", "Accepted", p) for i, p in enumerate(["src/*.py; web/**", "src/*.py", "src/*.py; src/a.py", "", None, "src/*.py; src/*.py"])],
                                    "lib string, rec_id string, type string, status string, gated_paths string")
    changed = spark.createDataFrame([("L", "c1", "src/a.py"), ("L", "c1", "src/a.py"), ("L", "c1", "src/b.py"), ("L", "c2", "web/x/y.ts"), ("L", "c3", "no"), ("M", "c1", "src/a.py")],
                                    "lib string, change_key string, path string")
    rows = gates.gated_paths(records, changed)
    assert len(rows.collect()) > 5
    assert sorted(map(tuple, gates.gated_counts(records, changed).collect())) == sorted(map(tuple, rows.groupBy("lib", "change_key").count().collect()))


def test_scores_are_not_shuffled_by_query_and_document(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(30)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b1"), (2, "b2 b2 c5")], "query_id long, text string")
    plan = rt.top_k_bm25(docs, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "hashpartitioning(query_id" in line and "doc_id" in line]
    assert "hashpartitioning(doc_id" in plan
