import re

import pytest

from decisionlake.llm.common import known_to_workers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

# nulls in every column, empty and blank texts, repeated rows, equal ids, a long text, and columns that clash with inner names
EDGES = [(1, "a b c d e f g", "en", "x"), (1, "a b c d e f g", "en", "x"), (2, "", None, None), (3, None, "en", "y"), (4, " \n\t", "de", "z"),
         (5, "one line\none line\n\nanother", "en", "x"), (None, "no id here", "fr", None), (6, "wörd " * 3000, "de", "z"), (7, "a b c d e f g", "en", "x"),
         (7, "other text under one id", "en", "x")]
EDGE_SCHEMA = "doc_id long, text string, lang string, d string"


@pytest.fixture(autouse=True)
def workers(spark):
    known_to_workers(spark)


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA).repartition(3)


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def sample():
    import duckdb
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
