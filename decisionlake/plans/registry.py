"""The registered queries: name -> callable, name -> SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn
    return add


def load() -> None:
    from decisionlake.plans import (q_evals, q_freshness, q_incremental, q_library, q_retrieval,  # noqa: F401
                                    q_signals, q_transcripts)
