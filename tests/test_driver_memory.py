"""What the driver holds must not follow the tables: no plan carries a map, no table is broadcast by the size of its packed files."""
from pyspark.sql import functions as F

from decisionlake.operators import contains, graph, resolve
from decisionlake.operators import retrieval as rt
from decisionlake.session import cut, cut_unpacked, listing, unpacked

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
FACTOR = "spark.sql.sources.fileCompressionFactor"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_map_is_not_written_into_plans(spark, monkeypatch):
    plans, real = [], contains.cut
    monkeypatch.setattr(contains, "cut", lambda df: plans.append(plan_of(df)) or real(df))
    texts = spark.createDataFrame([(i, f"a text of w{i} and more") for i in range(50)], "i long, text string")
    needles = spark.createDataFrame([(j, f"of w{j} and") for j in range(5)] + [(9, "nowhere")], "j long, needle string")
    assert {tuple(r) for r in contains.contains_join(texts, needles, ["i"], ["j"]).collect()} == {(j, j) for j in range(5)}
    assert max(map(len, plans)) < contains.BYTES and any("Subquery" in p for p in plans)


def test_files_count_for_what_they_unpack_to(spark):
    old = spark.conf.get(FACTOR), spark.conf.get(THRESHOLD)
    big = cut(spark.range(20_000).select("id", F.lit("the same text " * 20).alias("text")))
    size = int(str(big._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    try:
        spark.conf.set(THRESHOLD, str(2 * size))
        join = lambda: spark.range(20_000).withColumn("x", F.col("id") * 2).join(big, "id")
        assert "BroadcastHashJoin" in plan_of(join())
        with unpacked(spark):
            assert "BroadcastHashJoin" not in plan_of(join())
        assert spark.conf.get(FACTOR) == old[0] and cut_unpacked(join()).count() == 20_000
    finally:
        spark.conf.set(THRESHOLD, old[1])


def test_pairs_of_an_entrys_tokens_are_not_broadcast(spark, monkeypatch):
    plans, real = [], rt.cut
    monkeypatch.setattr(rt, "cut", lambda df: plans.append(plan_of(df)) or real(df))
    queries = spark.createDataFrame([(1, "who owns cx1")], "query_id long, text string")
    glossary = spark.createDataFrame([("cx1", "Svc Grp1"), ("cx2", "Svd Grp1")], "term string, meaning string")
    assert {r.term for r in rt.expand_query(queries, glossary).collect()} == {"who owns cx1", "cx1", "Svc Grp1", "cx2", "Svd Grp1"}
    steps = [p for p in plans if p.count("Generate explode(toks") >= 2]
    assert steps and all("SortMergeJoin" in p for p in steps)


def test_a_walk_reads_no_more_than_the_statuses(spark):
    r = spark.createDataFrame([("L", "ADR 0001", "Superseded by ADR 2"), ("L", "ADR 0002", "Accepted")], "lib string, rec_id string, status string")
    assert {(x.rec_id, x.endpoint, x.depth) for x in graph.resolve_current(r).collect()} == {("ADR 0001", "ADR 0002", 1), ("ADR 0002", "ADR 0002", 0)}
    assert [tuple(x) for x in graph.successors(r).collect()] == [("L", "ADR 0001", "ADR 0002")]


def test_listed_files_are_not_kept(spark):
    key = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = spark.conf.get(key)
    with listing(spark):
        assert spark.conf.get(key) == "0"
    assert spark.conf.get(key) == before


def test_only_endpoints_are_told(spark):
    rows = [("L", f"ADR {i:04}", "adr", f"t{i}", "Accepted", "2020-01-01", "", f"p{i}", "", "", f"word{i}", "") for i in range(4)]
    names = "lib rec_id type title status date decided_originally path aliases supersedes field_text body"
    lib = resolve.Library.of(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names.split())))
    out = resolve.resolve_query(lib, spark.createDataFrame([("L", 1, "word2"), ("L", 2, "none such")], "lib string, query_id long, text string"))
    assert {(r.query_id, r.endpoint, r.title) for r in out.collect()} == {(1, "ADR 0002", "t2"), (2, None, None)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
