"""Registered queries: records from markdown, ledger, streams, runs, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.operators import chains, incremental as inc, library as li, runs
from decisionlake.plans import q_transcripts as qt
from decisionlake.plans.q_library import records
from decisionlake.plans.registry import query
from decisionlake.plans.twins import BLOCKS, twin
from decisionlake.session import staging_path
from decisionlake.sources import records as rec
from decisionlake.sources import transcripts as tr
from decisionlake.sources.fixtures import PROJECTIONS
from decisionlake.sources.fixtures import projection as P
from decisionlake.streaming import sessions as st

_REC_COLS = ["lib", "type", "label", "number", "rec_id", "title", *config.FIELD_COLUMNS.values(), "path", "field_text"]


@query("parse_records", twin(f"SELECT {', '.join(_REC_COLS)}, true AS parsed FROM f_records"))
def parse_records(spark, d):
    docs = P(spark, d, "f_records").select("lib", "type", "path", F.col("body").alias("text"))
    return rec.parse_records(docs).select(*_REC_COLS, "parsed")


@query("write_index", twin("SELECT lib, rec_id AS id, type, number, title, status, CASE WHEN decided_originally <> '' THEN decided_originally ELSE date END AS date, path FROM f_records"))
def write_index(spark, d):
    path = staging_path(spark, "index")
    rows = li.index_rows(records(spark, d))
    tr.write_index(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("highest_numbers", twin("SELECT lib, type, MAX(number) AS last_number FROM f_records GROUP BY 1, 2"))
def highest_numbers(spark, d):
    return li.highest_numbers(records(spark, d))


_N4 = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
PROJECTIONS["f_run_docs"] = f"""
SELECT 'runs/' || CAST(c_custkey AS STRING) || '.md' AS path, c_custkey AS k,
       CASE WHEN c_custkey % 7 = 6 THEN '' ELSE
       '# RUN ' || CASE WHEN c_custkey % 7 = 1 THEN '12' ELSE {_N4} END || ' — nightly ' || CAST(c_custkey AS STRING) || chr(10) || chr(10)
       || '- Status: ' || CASE WHEN c_custkey % 7 = 4 THEN 'Closed' ELSE 'Open' END || chr(10) || '- Date: 2026-01-01' || chr(10) || '- Runner: r' || chr(10)
       || '- Trigger: ' || CASE WHEN c_custkey % 7 = 4 THEN 'cron' ELSE 'ci' END || chr(10) || '- Scope: s' || chr(10)
       || CASE WHEN c_custkey % 7 = 3 THEN '- Mood: fine' ELSE '- Budget: ' END || chr(10) || '- Outcome: pending' || chr(10)
       || CASE WHEN c_custkey % 7 = 2 THEN 'garbage ' || CAST(c_custkey AS STRING) || chr(10) ELSE '' END
       || '- Stop reason: ' || chr(10) || '- Artifacts: a; b' || chr(10) || '- Checker result: unknown' || chr(10) || '- Harness improvement: ' || chr(10)
       || '- Sources: loop-run:' || CASE WHEN c_custkey % 7 = 5 THEN '0000x' ELSE {_N4} END || chr(10) || chr(10) || '## Log' || chr(10) || chr(10) || 'free text' END AS text
FROM {{customer}}
"""


def run_docs(spark, d):
    return rec.parse_run_records(P(spark, d, "f_run_docs"))


@query("parse_run_records", twin(f"""
SELECT path, CASE WHEN k % 7 IN (0, 3, 4, 5) THEN lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS run_no, CASE WHEN k % 7 IN (0, 3, 4, 5) THEN 'nightly ' || CAST(k AS VARCHAR) END AS title,
       CASE WHEN k % 7 IN (0, 3, 4, 5) THEN 12 END AS n_fields,
       CASE k % 7 WHEN 6 THEN 'missing_h1' WHEN 1 THEN 'malformed_h1' WHEN 2 THEN 'malformed_frontmatter_line:garbage ' || CAST(k AS VARCHAR) END AS error FROM f_run_docs
"""))
def parse_run_records(spark, d):
    return run_docs(spark, d).select("path", "run_no", "title", F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"), "error")


@query("field_set_diff", twin("""
SELECT path, CASE WHEN k % 7 = 3 THEN 'Budget' ELSE '' END AS missing, CASE WHEN k % 7 = 3 THEN 'Mood' ELSE '' END AS extra FROM f_run_docs WHERE k % 7 IN (0, 3, 4, 5)
"""))
def field_set_diff(spark, d):
    return runs.field_set_diff(run_docs(spark, d))


@query("validate_runs", twin("""
SELECT path, error FROM (
  SELECT path, CASE k % 7 WHEN 6 THEN 'missing_h1' WHEN 1 THEN 'malformed_h1' WHEN 2 THEN 'malformed_frontmatter_line:garbage ' || CAST(k AS VARCHAR)
         WHEN 3 THEN 'missing fields: Budget' WHEN 4 THEN 'invalid Trigger' WHEN 5 THEN 'invalid Sources' END AS error FROM f_run_docs
  UNION ALL SELECT path, 'extra fields: Mood' FROM f_run_docs WHERE k % 7 = 3
  UNION ALL SELECT path, 'closed run missing Stop reason' FROM f_run_docs WHERE k % 7 = 4) x WHERE error IS NOT NULL
"""))
def validate_runs(spark, d):
    return runs.validate_runs(run_docs(spark, d))


def _ts(df):
    return df.withColumn("first_ts", F.timestamp_seconds("first_s")).withColumn("last_ts", F.timestamp_seconds("last_s"))


def _sessions(spark, d):
    return _ts(P(spark, d, "f_sessions"))


BLOCKS["o_delta"] = """
SELECT s.agent, s.unit_id, s.first_s, s.last_s FROM f_sessions s LEFT JOIN o_ledger l ON l.agent = s.agent AND l.unit_id = s.unit_id
WHERE l.unit_id IS NULL OR (s.last_s IS NOT NULL AND (l.last_s IS NULL OR s.last_s > l.last_s))
"""


@query("incremental_delta", twin("SELECT agent, unit_id, last_s FROM o_delta"))
def incremental_delta(spark, d):
    return inc.incremental_delta(_sessions(spark, d), qt.ledger(spark, d)).select("agent", "unit_id", "last_s")


@query("ledger_upsert", twin("""
SELECT agent, unit_id, last_s, src, processed_at FROM (SELECT agent, unit_id, last_s, 'new' AS src, 200 AS processed_at FROM o_delta
  UNION ALL SELECT l.agent, l.unit_id, l.last_s, l.src, l.processed_at FROM o_ledger l WHERE NOT EXISTS (SELECT 1 FROM o_delta d WHERE d.agent = l.agent AND d.unit_id = l.unit_id)) x
"""))
def ledger_upsert(spark, d):
    led = qt.ledger(spark, d)
    delta = inc.incremental_delta(_sessions(spark, d), led).withColumn("src", F.lit("new")).withColumn("processed_at", F.lit(200))
    base = staging_path(spark, "ledger")
    inc.publish_ledger(led, base, "first")
    inc.publish_ledger(delta, base, "second")
    inc.publish_ledger(delta.withColumn("processed_at", F.lit(300)), base, "second")       # known, changes nothing
    return inc.read_ledger(spark, base).select("agent", "unit_id", F.unix_seconds("last_ts").alias("last_s"), "src", "processed_at")


@query("stream_sessions", twin("SELECT agent, unit_id, COUNT(*) AS kept, MIN(ts_s) AS first_s, MAX(ts_s) AS last_s FROM f_kept GROUP BY 1, 2"))
def stream_sessions(spark, d):
    inbox, base, chk = (staging_path(spark, n) for n in ("inbox", "stream", "progress"))
    m = P(spark, d, "f_kept").select("agent", "unit_id", "pos", F.timestamp_seconds("ts_s").alias("ts"))
    m.repartition(6, "pos").write.parquet(inbox)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 3).parquet(inbox)
    st.stream_sessions(stream, base, chk).awaitTermination()
    out = st.latest_sessions(spark, base)
    return out.select("agent", "unit_id", "kept", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"))


BLOCKS["o_live"] = """
SELECT e.*, o.open_seq, c.close_seq FROM f_run_events e JOIN (SELECT run_id, MIN(seq) AS open_seq FROM f_run_events WHERE event = 'open' GROUP BY 1) o ON o.run_id = e.run_id
LEFT JOIN (SELECT x.run_id, MIN(x.seq) AS close_seq FROM f_run_events x JOIN (SELECT run_id, MIN(seq) AS open_seq FROM f_run_events WHERE event = 'open' GROUP BY 1) y
  ON y.run_id = x.run_id WHERE x.event = 'close' AND x.seq > y.open_seq GROUP BY 1) c ON c.run_id = e.run_id
WHERE e.seq = o.open_seq OR (e.seq > o.open_seq AND (e.event = 'close' OR (e.event = 'append' AND (c.close_seq IS NULL OR e.seq < c.close_seq))))
"""
_FOLD = """
SELECT run_id, CASE WHEN MIN(close_seq) IS NULL THEN 'Open' ELSE 'Closed' END AS status,
       COALESCE(arg_max(checker_result, CASE WHEN checker_result IS NOT NULL THEN seq END), 'unknown') AS checker_result,
       COALESCE(arg_max(outcome, CASE WHEN outcome IS NOT NULL THEN seq END), 'pending') AS outcome,
       COALESCE(arg_max(note, CASE WHEN event = 'close' THEN seq END), '') AS stop_reason, COUNT(*) AS log_entries,
       COUNT(DISTINCT CASE WHEN event <> 'close' THEN artifact END) AS artifacts
FROM o_live GROUP BY run_id
"""


@query("fold_runs", twin(_FOLD))
def fold_runs(spark, d):
    return runs.fold_runs(P(spark, d, "f_run_events"))


@query("fold_runs_stream", twin(_FOLD))
def fold_runs_stream(spark, d):
    inbox, base, chk = (staging_path(spark, n) for n in ("inbox", "events", "progress"))
    ev = P(spark, d, "f_run_events")
    ev.repartition(4, "seq").write.parquet(inbox)
    st.stream_runs(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(inbox), base, chk).awaitTermination()
    return st.streamed_runs(spark, base)


@query("run_artifacts", twin("SELECT run_id, artifact, MIN(seq) AS first_seq FROM o_live WHERE event <> 'close' GROUP BY 1, 2"))
def run_artifacts(spark, d):
    return runs.run_artifacts(P(spark, d, "f_run_events"))


@query("chunk_checkpoint", twin("SELECT source AS chunk_id, COUNT(*) AS n_rows FROM {documents} WHERE source NOT LIKE 'src1%' OR source = 'src11' GROUP BY 1"))
def chunk_checkpoint(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("chunk_id"), F.lit("m1|0").alias("params"), F.col("text").alias("row_text"))
    # chunk src11 was worked on other rows, the other src1* chunks on the same ones
    before = docs.where("chunk_id like 'src1%'").withColumn(
        "row_text", F.when(F.col("chunk_id") == "src11", F.concat("row_text", F.lit("!"))).otherwise(F.col("row_text")))
    return chains.chunk_checkpoint(docs, chains.chunk_hashes(before)).select("chunk_id", "n_rows")


_COLS = """'e' || CAST(l_partkey AS STRING) AS entity, CASE WHEN l_suppkey % 2 = 0 THEN 'Urgent' ELSE 'routine' END AS dimension,
       'v' || CAST(l_linenumber AS STRING) AS value, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d, l_orderkey AS ok FROM {lineitem}"""
_ROWS = f"""
SELECT CAST(0 AS BIGINT) AS chunk, {_COLS} UNION ALL SELECT CAST(1 AS BIGINT) AS chunk, {_COLS} WHERE l_orderkey % 3 = 0
"""
PROJECTIONS["f_ex_rows"] = _ROWS
# chunk 0 drops some rows, chunk 1 drops half of the copies it also holds; other rows get a corrected value; some were missed
PROJECTIONS["f_fixes"] = """
SELECT chunk, entity, dimension, value, d, bool_or(CASE WHEN chunk = 0 THEN ok % 5 = 0 ELSE ok % 10 = 0 END) AS "drop", false AS missing,
       MAX(CASE WHEN ok % 7 = 0 THEN 'fixed ' || value END) AS corrected_value, CAST(NULL AS STRING) AS corrected_d, MAX(ok) AS seq
FROM f_ex_rows WHERE ok % 5 = 0 OR ok % 7 = 0 GROUP BY chunk, entity, dimension, value, d
UNION ALL SELECT 0, 'new' || CAST(s_suppkey % 40 AS STRING), 'urgent', 'v9', '2026-01-01', false, true, NULL, NULL, s_suppkey FROM {supplier}
"""
PROJECTIONS["f_fixes"] = PROJECTIONS["f_fixes"].replace('"drop"', "drop_it")


@query("selfcheck_apply", twin("""
SELECT entity, dimension, value, d FROM (
  SELECT r.entity, r.dimension, CASE WHEN NOT COALESCE(f.drop_it, false) AND f.corrected_value IS NOT NULL THEN f.corrected_value ELSE r.value END AS value, r.d
  FROM f_ex_rows r LEFT JOIN f_fixes f ON NOT f.missing AND f.chunk = r.chunk AND f.entity = r.entity AND lower(f.dimension) = lower(r.dimension) AND f.value = r.value AND f.d = r.d
  LEFT JOIN (SELECT c.entity, lower(c.dimension) AS dim, c.value, c.d, SUM(c.n) AS copies, SUM(c.dropped) AS drops FROM (
      SELECT r.chunk, r.entity, r.dimension, r.value, r.d, COUNT(*) AS n, MAX(CASE WHEN f.drop_it THEN 1 ELSE 0 END) AS dropped
      FROM f_ex_rows r LEFT JOIN f_fixes f ON NOT f.missing AND f.chunk = r.chunk AND f.entity = r.entity AND f.dimension = r.dimension AND f.value = r.value AND f.d = r.d
      GROUP BY 1, 2, 3, 4, 5) c GROUP BY 1, 2, 3, 4) v ON v.entity = r.entity AND v.dim = lower(r.dimension) AND v.value = r.value AND v.d = r.d
  WHERE NOT (COALESCE(f.drop_it, false) AND v.drops >= v.copies)
  UNION ALL SELECT DISTINCT entity, lower(dimension), value, d FROM f_fixes WHERE missing) x
"""))
def selfcheck_apply(spark, d):
    fixes = P(spark, d, "f_fixes").withColumnRenamed("drop_it", "drop")
    return chains.selfcheck_apply(P(spark, d, "f_ex_rows").drop("ok"), fixes, ["urgent", "routine"])
