"""Steps of the library and of the collection whose tasks, columns or shuffles must follow the input."""
from decisionlake.operators import alias as al
from decisionlake.operators import graph
from decisionlake.plans import q_freshness, q_library
from decisionlake.session import listing

SF = "/root/testdata/sf0.001"
KIND = "lib string, rec_id string, status string, supersedes string, aliases string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edges_are_spread_by_the_number_of_records(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 5)
    rows = [("L", f"ADR {i:04}", f"Superseded by ADR {i + 1}", f"ADR {i - 1}", "") for i in range(1, 100)]
    rows += [rows[0], ("L", "ADR 0100", "Accepted", None, ""), ("M", "ADR 0001", "Superseded by ADR 2", "", ""), (None, "ADR 0001", "Superseded by ADR 2", "", ""), ("L", None, "", "ADR 1", "")]
    edges = graph.supersede_edges(spark.createDataFrame(rows, KIND))
    assert "hashpartitioning(lib#" in (plan := edges._jdf.queryExecution().executedPlan().toString()) and ", 21)" in plan
    status = [("L", f"ADR {i:04}", f"ADR {i + 1:04}", "status") for i in range(1, 100)]
    field = [("L", f"ADR {i - 1:04}", f"ADR {i:04}", "supersedes") for i in range(2, 100)]
    assert rows_of(edges) == sorted(status + field)


def test_invalid_chains_take_the_ids_told_apart_once(spark):
    rows = [("L", f"ADR {i:04}", f"Superseded by ADR {i + 1}" if i < 9 else "Superseded by ADR 77", f"ADR {i - 1}" if i > 1 else "", f"a{i}") for i in range(1, 10)]
    rows += [("L", "PDR 0001", "Superseded by PDR 2", "PDR 2", "p"), ("L", "PDR 0002", "Superseded by PDR 1", "PDR 1", ""), ("L", "BDR 0001", "Superseded by BDR 2", "", "b"),
             ("L", "BDR 0002", "Accepted", "BDR 9", "c"), ("L", "BDR 0003", "Accepted", "", "d"), ("L", "BDR 0003", "Accepted", "", "d")]
    r = spark.createDataFrame(rows, KIND)
    ids = graph.nodes(r)
    got = {tuple(x) for x in graph.invalid_chains(r, graph.resolve_current(r, ids), ids).collect()}
    assert got == {("L", f"ADR {i:04}", "names missing superseder ADR 0077") for i in range(1, 10)} | {
        ("L", "PDR 0001", "supersede cycle"), ("L", "BDR 0001", "not listed back by BDR 0002")}


def test_glossary_joins_a_finished_table_of_clashes(spark):
    records = spark.createDataFrame([("L", f"ADR {i}", f"t{i}", "Accepted") for i in range(4)], "lib string, rec_id string, title string, status string")
    amap = spark.createDataFrame([("L", "many", f"ADR {i}") for i in range(3)] + [("L", "one", "ADR 3")], "lib string, alias string, target_id string")
    out = al.glossary(records, amap)
    assert "targets" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(out) == [("L", "many", f"ADR {i}", f"t{i}", "Accepted", True) for i in range(3)] + [("L", "one", "ADR 3", "t3", "Accepted", False)]


def test_library_queries_cut_the_columns_they_read(spark):
    whole = q_library.records(spark, SF)
    for columns in (q_library.LINKS, q_library.ALIASED, q_freshness.CHECKED):
        some = q_library.records(spark, SF, columns)
        assert some.columns == columns and "body" not in columns
        assert rows_of(some) == rows_of(whole.select(*columns))


def test_folders_are_listed_by_few_tasks(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with listing(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
