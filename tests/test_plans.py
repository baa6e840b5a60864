"""Plan shapes that must hold at scale."""
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["assemble_chains", "assess_staleness", "ghost_sources", "gated_paths", "attribute_cwd", "attribute_encoded",
         "incremental_delta", "top_k_bm25", "expand_query", "reconcile_claims", "recall_stats", "run_cost", "selfcheck_apply",
         "get_record", "fold_runs", "price_lookup", "evidence", "search", "attribute_mention", "match_aliases"]


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "top_k_bm25")


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "fold_runs")
    assert "value:double" not in text
