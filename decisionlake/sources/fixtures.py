"""Projections of the driver tables into the shapes the jobs read.

One portable SQL text per projection, the same for Spark and for the SQL twins. Table names are written
``{orders}``; every projection may use the others by name. All of them read whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

TODAY = "2030-01-01"


def _pad(n: str) -> str:
    return f"CASE WHEN length(CAST({n} AS STRING)) >= 4 THEN CAST({n} AS STRING) ELSE lpad(CAST({n} AS STRING), 4, '0') END"


def _rid(n: str) -> str:
    return f"label || ' ' || {_pad(n)}"


PROJECTIONS: dict[str, str] = {}

PROJECTIONS["f_extractions"] = """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'entity ' || CAST(o_custkey AS STRING)
            WHEN 1 THEN ' Entity  ' || CAST(o_custkey AS STRING) || ' '
            ELSE 'ENTITY ' || CAST(o_custkey AS STRING) END AS entity,
       CASE WHEN o_orderkey % 17 = 0 THEN 'other' WHEN o_orderpriority < '3' THEN ' Urgent' ELSE 'routine' END AS dimension,
       'v' || CAST(o_orderkey % 11 AS STRING) AS value,
       CAST(o_orderdate AS DATE) AS d
FROM {orders}
"""

PROJECTIONS["f_links"] = """
SELECT o_custkey AS entity, CASE WHEN o_orderpriority < '3' THEN 'urgent' ELSE 'routine' END AS dimension,
       'v' || CAST(o_orderkey % 11 AS STRING) AS value, MIN(CAST(o_orderdate AS DATE)) AS d
FROM {orders} GROUP BY 1, 2, 3
"""

# numbers are unique by arithmetic: 16 slots per chain, at most 11 used
PROJECTIONS["f_numbered"] = """
SELECT entity, dimension, value, d,
       CASE WHEN dimension = 'urgent' THEN 'ADR' ELSE 'PDR' END AS label,
       ROW_NUMBER() OVER (PARTITION BY entity, dimension ORDER BY d, value) AS pos,
       COUNT(*) OVER (PARTITION BY entity, dimension) AS n,
       (entity * 2 + CASE WHEN dimension = 'urgent' THEN 1 ELSE 0 END) * 16 AS base
FROM f_links
"""

PROJECTIONS["f_pieces"] = f"""
SELECT 'lib' || CAST(entity % 4 AS STRING) AS lib, lower(label) AS type, label, base + pos AS number,
       {_rid('(base + pos)')} AS rec_id,
       'entity ' || CAST(entity AS STRING) || ' ' || dimension || ': ' || value AS title,
       CASE WHEN pos < n THEN 'Superseded by ' || {_rid('(base + pos + 1)')}
            WHEN entity % 41 = 7 AND n >= 2 THEN 'Superseded by ' || {_rid('(base + 1)')}
            WHEN entity % 43 = 9 THEN 'Superseded by ' || {_rid('(base + 15)')}
            WHEN (base + pos) % 29 = 0 THEN 'Deprecated'
            WHEN (base + pos) % 31 = 0 THEN 'Proposed'
            WHEN (base + pos) % 37 = 0 THEN 'Weird'
            ELSE 'Accepted' END AS status,
       CAST(d AS STRING) AS date,
       CASE WHEN (base + pos) % 9 = 0 THEN CAST(CAST(d - INTERVAL '10' DAY AS DATE) AS STRING) ELSE '' END AS decided_originally,
       CASE WHEN (base + pos) % 35 = 5 THEN 'soon' WHEN (base + pos) % 55 = 10 THEN '2999-01-01'
            WHEN (base + pos) % 65 = 15 THEN '1990-01-01' WHEN (base + pos) % 70 = 20 THEN '1999-02-31'
            WHEN (base + pos) % 5 = 0 THEN CAST(CAST(d + INTERVAL '60' DAY AS DATE) AS STRING) ELSE '' END AS reviewed,
       CASE WHEN (base + pos) % 53 = 0 THEN '' ELSE 'team ' || CAST(entity % 10 AS STRING) END AS decider,
       CASE (base + pos) % 6 WHEN 0 THEN ''
            WHEN 1 THEN '`alpha · s' || CAST(entity AS STRING) || ' · 2026-01-02`'
            WHEN 2 THEN 'src/o' || CAST(((base + pos) * 7) % 20000 AS STRING) || '.py, README.md'
            WHEN 3 THEN '`src/o' || CAST(((base + pos) * 7) % 20000 AS STRING) || '.py` and lib/util' || CAST(entity % 50 AS STRING) || '/'
            WHEN 4 THEN 'src/o' || CAST(((base + pos) * 7) % 20000 AS STRING) || '.py; https://example.org/x/' || CAST(entity AS STRING)
            ELSE 'docs, src/o' || CAST(((base + pos) * 11) % 20000 AS STRING) || '.py' END AS sources,
       CASE WHEN pos = 1 AND entity % 3 = 0 THEN 'see ' || {_rid('(base + 2)')} ELSE '' END AS related,
       CASE WHEN pos >= 2 AND entity % 47 = 11 AND pos = 3 THEN {_rid('(base + 1)')}
            WHEN pos >= 2 AND entity % 5 <> 4 THEN {_rid('(base + pos - 1)')} ELSE '' END AS supersedes,
       CASE WHEN (base + pos) % 4 = 0 THEN 'Code_' || CAST(entity AS STRING) || '; api'
            WHEN (base + pos) % 4 = 1 THEN 'Project-' || CAST(entity % 1100 AS STRING) || ' ' || dimension ELSE '' END AS aliases,
       CASE WHEN (base + pos) % 101 = 0 THEN 'src/o' || CAST((base + pos) % 10 AS STRING) || '*.py; web/*/index.ts' ELSE '' END AS gated_paths,
       CASE WHEN (base + pos) % 23 = 0 THEN 'c' || CAST((base + pos) % 3000 AS STRING) ELSE '' END AS approval_for,
       CASE WHEN (base + pos) % 11 = 0 THEN 'c' || CAST((base + pos) % 3000 AS STRING) ELSE '' END AS evidence_for,
       CASE WHEN (base + pos) % 11 = 0 THEN 'screenshot: src/o' || CAST((base + pos) % 20000 AS STRING)
            || '.py; video:../x.mp4' ELSE '' END AS evidence_artifacts,
       'See ' || {_rid('((base + pos) * 3 + 1)')} || ' for entity ' || CAST(entity AS STRING) || '.'
       || CASE WHEN (base + pos) % 17 = 0 THEN ' Compare entity ' || CAST(entity AS STRING)
            || CASE WHEN dimension = 'urgent' THEN ' routine: v' ELSE ' urgent: v' END || CAST(entity % 11 AS STRING) || '.' ELSE '' END AS prose,
       entity, dimension, value, pos, n
FROM f_numbered
"""


def _line(key: str, col: str) -> str:
    return f"CASE WHEN {col} = '' THEN '' ELSE '- {key}: ' || {col} || chr(10) END"


_FIELDS = [("Status", "status"), ("Date", "date"), ("Decided originally", "decided_originally"),
           ("Reviewed", "reviewed"), ("Decider", "decider"), ("Sources", "sources"), ("Related", "related"),
           ("Supersedes", "supersedes"), ("Aliases", "aliases"), ("Human gated paths", "gated_paths"),
           ("Human approval for", "approval_for"), ("Evidence for", "evidence_for"),
           ("Evidence artifacts", "evidence_artifacts")]

_FIELD_TEXT = " || ".join(
    f"CASE WHEN {c} = '' THEN '' ELSE ' ' || {c} END" for _, c in _FIELDS if c != "aliases")

PROJECTIONS["f_records"] = f"""
SELECT lib, type, label, number, rec_id, title, status, date, decided_originally, reviewed, decider, sources,
       related, supersedes, aliases, gated_paths, approval_for, evidence_for, evidence_artifacts,
       type || '/' || {_pad('number')} || CASE WHEN number % 59 = 0 THEN '_Bad Name' ELSE '-entity-' || CAST(entity AS STRING) END || '.md' AS path,
       substr({_FIELD_TEXT}, 2) AS field_text,
       '# ' || label || ' ' || {_pad('number')} || ' — ' || title || chr(10) || chr(10)
       || {" || ".join(_line(k, c) for k, c in _FIELDS)}
       || chr(10) || '## Decision' || chr(10) || chr(10) || prose || chr(10) AS body,
       entity, dimension, value, pos, n
FROM f_pieces
"""

PROJECTIONS["f_haystack"] = r"""
SELECT lib, rec_id, type, lower(title || ' ' || field_text || ' '
       || replace(body, CASE WHEN aliases = '' THEN '@@none@@' ELSE '- Aliases: ' || aliases END, '')) AS hay
FROM f_records
"""

PROJECTIONS["f_repo_files"] = """
SELECT DISTINCT 'lib' || CAST(l_orderkey % 4 AS STRING) AS lib,
       CASE WHEN l_orderkey % 50 = 0 THEN 'docs'
            WHEN l_orderkey % 50 = 1 THEN 'lib/util' || CAST(l_suppkey % 50 AS STRING)
            WHEN l_orderkey % 7 = 0 THEN 'old/o' || CAST(l_orderkey % 20000 AS STRING) || '.py'
            ELSE 'src/o' || CAST(l_orderkey % 20000 AS STRING) || '.py' END AS path,
       l_orderkey % 50 < 2 AS is_dir
FROM {lineitem}
"""

PROJECTIONS["f_file_changes"] = """
SELECT 'lib' || CAST(l_orderkey % 4 AS STRING) AS lib,
       CASE WHEN l_orderkey % 13 = 0 THEN 'decisions/' ELSE '' END || 'src/o' || CAST(l_orderkey % 20000 AS STRING) || '.py' AS path,
       l_shipdate AS commit_ts, l_orderkey AS sha
FROM {lineitem}
"""

PROJECTIONS["f_queries"] = """
SELECT 'lib' || CAST(c_custkey % 4 AS STRING) AS lib, c_custkey AS query_id,
       CASE c_custkey % 6 WHEN 0 THEN 'Entity ' || CAST(c_custkey AS STRING) || ' URGENT'
            WHEN 1 THEN 'entity ' || CAST(c_custkey AS STRING) || ' '
            WHEN 2 THEN 'what is code-' || CAST(c_custkey AS STRING) || ' now, and the api?'
            WHEN 3 THEN 'project ' || CAST(c_custkey % 1100 AS STRING) || ' routine or project ' || CAST(c_custkey % 1100 AS STRING) || ' urgent'
            WHEN 4 THEN 'for entity ' || CAST(c_custkey AS STRING) || '.'
            ELSE CAST(c_custkey AS STRING) || ' routine: v' || CAST(c_custkey % 11 AS STRING) END AS text
FROM {customer}
"""

PROJECTIONS["f_changes"] = """
SELECT 'lib' || CAST(l_orderkey % 4 AS STRING) AS lib, 'c' || CAST(l_orderkey % 3000 AS STRING) AS change_id,
       CASE WHEN l_linenumber = 1 THEN 'web/o' || CAST(l_partkey AS STRING) || '/index.ts'
            ELSE 'src/o' || CAST(l_orderkey % 20000 AS STRING) || '.py' END AS path
FROM {lineitem} GROUP BY 1, 2, 3
"""

PROJECTIONS["f_change_list"] = """
SELECT lib, change_id AS change_key, CASE WHEN CAST(substr(change_id, 2) AS BIGINT) % 7 = 0 THEN NULL ELSE change_id END AS change_id
FROM (SELECT DISTINCT lib, change_id FROM f_changes) x
UNION ALL SELECT 'lib' || CAST(s_suppkey % 4 AS STRING), 'e' || CAST(s_suppkey AS STRING), 'e' || CAST(s_suppkey AS STRING) FROM {supplier}
"""

PROJECTIONS["f_diffs"] = """
SELECT 'lib' || CAST(l_orderkey % 4 AS STRING) AS lib, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS change_key,
       CASE (l_orderkey + l_linenumber) % 3
         WHEN 0 THEN 'diff --git a/src/o' || CAST(l_partkey AS STRING) || '.py b/src/o' || CAST(l_partkey AS STRING) || '.py' || chr(10)
              || '--- /dev/null' || chr(10) || '+++ b/src/o' || CAST(l_partkey AS STRING) || '.py' || chr(9) || '2026' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+x'
         WHEN 1 THEN 'src/./o' || CAST(l_partkey AS STRING) || '.py' || chr(10) || '"web/a b.ts"' || chr(10) || 'src//o' || CAST(l_partkey AS STRING) || '.py' || chr(10)
         ELSE '/etc/o' || CAST(l_suppkey AS STRING) || chr(10) || 'b/../up.py' END AS diff
FROM {lineitem}
"""

# transcripts
PROJECTIONS["f_messages"] = """
SELECT conv_id AS unit_id,
       CASE conv_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS agent,
       turn AS pos, role, text,
       CASE WHEN conv_id % 13 <> 0 THEN 1767225600 + conv_id * 3600 + turn * 60 END AS ts_s,
       CASE WHEN conv_id % 11 <> 0 THEN '/home/u/p' || CAST(conv_id % 7 AS STRING)
         || CASE WHEN conv_id % 3 = 0 THEN '/sub' ELSE '' END END AS cwd
FROM {conversations}
"""

PROJECTIONS["f_kept"] = """
SELECT unit_id, agent, pos, role, trim(BOTH ' ' || chr(9) || chr(10) || chr(13) FROM text) AS text, ts_s, cwd FROM f_messages
WHERE role IN ('user', 'assistant') AND trim(BOTH ' ' || chr(9) || chr(10) || chr(13) FROM text) <> ''
"""

PROJECTIONS["f_sessions"] = """
SELECT m.agent, m.unit_id, m.cwd, m.kept, m.skipped, m.first_s, m.last_s FROM (
  SELECT agent, unit_id, MAX(cwd) AS cwd,
         SUM(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) AS kept,
         SUM(CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE 1 END) AS skipped,
         MIN(CASE WHEN role IN ('user', 'assistant') THEN ts_s END) AS first_s,
         MAX(CASE WHEN role IN ('user', 'assistant') THEN ts_s END) AS last_s
  FROM f_messages GROUP BY agent, unit_id) m
"""

PROJECTIONS["f_run_events"] = """
SELECT user_id AS run_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'append' END AS event,
       'note ' || CAST(event_id AS STRING) AS note,
       CASE WHEN event_type = 'click' THEN 'pass' WHEN event_type = 'error' THEN 'fail' END AS checker_result,
       CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failure' END END AS outcome,
       'k' || CAST(event_id % 9 AS STRING) AS artifact
FROM {events}
"""

PROJECTIONS["f_eval"] = """
SELECT run_id, scenario, status, checks, tok_in, tok_out, judge, provenance, drift_size, anti_pattern FROM (
  SELECT event_id % 6 AS run_id, user_id AS scenario,
         CASE WHEN event_type = 'error' AND (event_id % 6) * 7 < event_id % 40 THEN 'fail' WHEN event_type = 'view' THEN 'skipped' ELSE 'pass' END AS status,
         event_id % 3 AS checks, CAST(FLOOR(value * 100) AS BIGINT) AS tok_in,
         CAST(FLOOR(value * 10) AS BIGINT) AS tok_out,
         CASE WHEN event_id % 7 = 0 THEN 'pass' END AS judge,
         CASE WHEN event_id % 10 = 0 THEN 'Read-Verified by hand' WHEN event_id % 10 = 1 THEN 'manual' ELSE '' END AS provenance,
         CASE WHEN user_id % 5 > 0 THEN (user_id % 5) * 25 END AS drift_size,
         CASE WHEN user_id % 4 > 0 THEN 'ap' || CAST(user_id % 4 AS STRING) END AS anti_pattern,
         ROW_NUMBER() OVER (PARTITION BY event_id % 6, user_id ORDER BY event_id DESC) AS rn
  FROM {events}) e WHERE rn = 1
"""

PROJECTIONS["f_eval_runs"] = """
SELECT DISTINCT event_id % 6 AS run_id,
       CASE WHEN event_id % 6 = 5 THEN 'A' ELSE 'B' END AS tier,
       CASE event_id % 6 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet-notools' WHEN 2 THEN 'haiku' WHEN 3 THEN 'sonnet'
            WHEN 4 THEN 'haiku-x-2' ELSE 'unpriced' END AS model,
       CASE event_id % 6 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'haiku' WHEN 3 THEN 'sonnet' WHEN 4 THEN 'haiku' ELSE '' END AS model_tier,
       CASE WHEN event_id % 6 IN (0, 3) THEN 'baseline' ELSE 'guided' END AS condition,
       CASE WHEN event_id % 6 < 4 THEN 'hard' ELSE 'easy' END AS scenario_set,
       event_id % 6 <> 3 AS has_split
FROM {events}
"""

PROJECTIONS["f_prices"] = """
SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet' ELSE 'haiku' END AS model,
       CASE event_id % 3 WHEN 0 THEN 15.0 WHEN 1 THEN 3.0 ELSE 1.0 END AS price_in,
       CASE event_id % 3 WHEN 0 THEN 75.0 WHEN 1 THEN 15.0 ELSE 5.0 END AS price_out,
       CASE event_id % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 6.0 ELSE 2.0 END AS blended
FROM {events}
"""

# gold: the last link of each chain is current, the one before was replaced
PROJECTIONS["f_gold"] = """
SELECT entity * 2 + CASE WHEN dimension = 'urgent' THEN 1 ELSE 0 END AS probe_id,
       'lib' || CAST(entity % 4 AS STRING) AS lib, entity, dimension,
       MAX(CASE WHEN pos = n THEN value END) AS current_value,
       MAX(CASE WHEN pos = n - 1 THEN value END) AS replaced_value
FROM f_numbered GROUP BY 1, 2, 3, 4
"""

# every order is one answer to the probe of its chain; probes without an answer stay unanswered
PROJECTIONS["f_answers"] = """
SELECT a.arm, a.tier, a.sample, a.probe_id,
       CASE WHEN a.h % a.q = 0 THEN 'V' || CAST(a.h % 11 AS STRING) WHEN a.h % 19 = 1 THEN '' ELSE 'uses ' || g.current_value || ' today' END AS current_value,
       CASE WHEN a.h % 3 = 0 THEN 'none' ELSE 'was ' || COALESCE(g.replaced_value, 'v0') END AS replaced_value, a.h
FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'flat' WHEN 2 THEN 'retrieval' ELSE 'resolve' END AS arm,
             CASE WHEN o_orderkey % 8 < 4 THEN 'small' ELSE 'mid' END AS tier, CAST(FLOOR((o_orderkey % 24) / 8) AS BIGINT) AS sample,
             o_custkey * 2 + CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS probe_id, o_orderkey % 4 + 3 AS q, MAX(o_orderkey) AS h
      FROM {orders} GROUP BY 1, 2, 3, 4, 5) a JOIN f_gold g ON g.probe_id = a.probe_id
"""


def _needs(name: str, seen: list[str]) -> None:
    for other in re.findall(r"\bf_[a-z_]+\b", PROJECTIONS[name]):
        if other in PROJECTIONS and other != name and other not in seen:
            _needs(other, seen)
    if name not in seen:
        seen.append(name)


def needed(sql: str) -> list[str]:
    """Projections a SQL text uses, in dependency order."""
    seen: list[str] = []
    for name in re.findall(r"\bf_[a-z_]+\b", sql):
        if name in PROJECTIONS:
            _needs(name, seen)
    return seen


def with_clause(sql: str) -> str:
    return ",\n".join(f"{n} AS ({PROJECTIONS[n].strip()})" for n in needed(sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame over ``sf_dir``."""
    body = f"SELECT * FROM {name}"
    text = f"WITH {with_clause(body)} {body}"
    for t in TABLES:
        text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def duckdb_sql(body: str, extra: str = "", recursive: bool = False) -> str:
    """A SQL twin: the projections it needs, its own CTEs and its final SELECT."""
    ctes = [c for c in (with_clause(extra + body), extra.strip().rstrip(",")) if c]
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else ""
    text = head + body
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
