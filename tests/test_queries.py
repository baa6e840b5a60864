"""Registered queries against their SQL twins. DL_QUERIES=all runs every one (several minutes)."""
import os

import pytest

import __spark_entry__ as entry
from decisionlake.plans import registry
from decisionlake.sources.fixtures import TABLES
from tests.compare import run

SF = os.environ.get("DL_SF_DIR", "/root/testdata/sf0.001")
QUICK = ["assemble_chains", "assign_numbers", "resolve_current", "supersede_edges", "get_record", "review_baseline",
         "assess_staleness", "ghost_sources", "dangling_refs", "orphans", "changed_paths", "gated_paths", "gate_evidence",
         "norm_turns", "norm_document", "norm_seeded", "norm_message_dir", "norm_history", "norm_markdown_chat", "norm_table_chat",
         "coverage", "project_index", "attribute_cwd", "attribute_mention", "parse_records", "validate_runs", "ledger_upsert",
         "stream_sessions", "fold_runs", "top_k_bm25", "pack_chunks_overlap", "expand_query", "reconcile_claims",
         "validate_signals", "run_cost", "value_lenses", "calibration_verdict", "recall_stats", "score_verdict", "selfcheck_apply",
         "collect", "search", "resolve_trail", "match_aliases", "supersede_cycles", "fold_runs_stream"]
NAMES = list(registry.QUERIES) if os.environ.get("DL_QUERIES") == "all" else QUICK


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, text, _ = run(name, spark, con, SF, entry.queries(), entry.oracle_sql())
    assert ok, text


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.TWINS)
