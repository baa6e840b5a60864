"""Registered queries: signals and external decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.operators import chains
from decisionlake.operators import signals as sg
from decisionlake.plans.registry import query
from decisionlake.plans.twins import BLOCKS, twin
from decisionlake.sources.fixtures import PROJECTIONS
from decisionlake.sources.fixtures import projection as P

E = "CAST(event_id AS STRING)"
PROJECTIONS["f_items"] = f"""
SELECT user_id * 100 + event_id % 100 AS batch_id, event_id AS idx, CASE WHEN event_id % 6 = 5 THEN
  '{{"decider":"d' || CAST(user_id AS STRING) || '"' || CASE WHEN event_id % 12 = 11 THEN '' ELSE ',"title":"Use ' || event_type || ' ' || {E} || '"' END
  || CASE event_id % 5 WHEN 0 THEN ',"type":"BDR"' WHEN 1 THEN ',"type":"zzz"' ELSE '' END || CASE WHEN event_id % 4 = 1 THEN ',"source":"call ' || {E} || '"' ELSE '' END
  || CASE WHEN event_id % 8 = 1 THEN ',"date":"2024-02-03"' ELSE '' END || '}}'
ELSE
  '{{"id":"' || CASE WHEN event_id % 11 = 0 THEN 'bad id' ELSE 's:' || {E} END || '","source":"' || CASE WHEN event_id % 13 = 0 THEN 'rumor' ELSE 'support' END
  || '","product_area":"social","platform":"ios","app_version":"' || CASE WHEN event_id % 29 = 0 THEN '' ELSE '1.2' END || '","device_os":"17","content_summary":"' || event_type || ' happened to user '
  || CAST(user_id AS STRING) || ' while the client was busy with some very long running background work ' || {E} || '","raw_refs":'
  || CASE WHEN event_id % 17 = 0 THEN '[]' WHEN event_id % 19 = 0 THEN '[{{"url":"x"}}]' ELSE '[{{"url_or_path":"t/' || {E} || '"}},{{"url_or_path":"log"}}]' END
  || ',"customer_impact":"high","actionability":"unknown","privacy_class":"' || CASE event_id % 5 WHEN 0 THEN 'pii' WHEN 1 THEN 'public' ELSE 'internal' END
  || '","suggested_owner":"team' || CAST(user_id % 9 AS STRING) || '","created_at":"' || CASE WHEN event_id % 23 = 0 THEN 'yesterday!!' ELSE '2024-05-0' || CAST(event_id % 9 + 1 AS STRING) || 'T10:00:00Z' END || '"'
  || CASE WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN ',"redacted":true' WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN ',"redacted":"true"' WHEN event_id % 5 = 1 AND event_id % 7 = 3 THEN ',"redacted":"no"' ELSE '' END
  || CASE WHEN event_id % 31 = 0 THEN ',"type":"xyz"' WHEN event_id % 37 = 0 THEN ',"type":"ADR"' ELSE '' END || '}}' END AS item
FROM {{events}}
"""
BLOCKS["o_sig"] = "SELECT batch_id, idx, idx % 5 = 0 AS private FROM f_items WHERE idx % 6 <> 5"
BLOCKS["o_err"] = """
SELECT batch_id, idx, 'missing:raw_refs' AS error FROM o_sig WHERE false
UNION ALL SELECT batch_id, idx, 'bad_id' FROM o_sig WHERE idx % 11 = 0
UNION ALL SELECT batch_id, idx, 'bad_value:source' FROM o_sig WHERE idx % 13 = 0
UNION ALL SELECT batch_id, idx, 'missing:app_version' FROM o_sig WHERE idx % 29 = 0
UNION ALL SELECT batch_id, idx, 'bad_raw_refs' FROM o_sig WHERE idx % 17 = 0
UNION ALL SELECT batch_id, idx, 'bad_raw_ref_item' FROM o_sig WHERE idx % 19 = 0 AND idx % 17 <> 0
UNION ALL SELECT batch_id, idx, 'bad_created_at' FROM o_sig WHERE idx % 23 = 0
UNION ALL SELECT batch_id, idx, 'unknown_type' FROM o_sig WHERE idx % 31 = 0
UNION ALL SELECT batch_id, idx, 'not_redacted' FROM o_sig WHERE private AND idx % 2 <> 0
UNION ALL SELECT batch_id, idx, 'redacted_not_boolean' FROM o_sig WHERE idx % 5 = 1 AND idx % 7 = 3
"""


def items(spark, d):
    return P(spark, d, "f_items")


def validated(spark, d):
    sig = sg.classify_items(items(spark, d)).where("kind = 'signal'").drop("kind")
    return sg.validate_signals(sig, allow_sensitive=True)


@query("classify_items", twin("SELECT batch_id, idx, CASE WHEN idx % 6 = 5 THEN 'decision' ELSE 'signal' END AS kind FROM f_items"))
def classify_items(spark, d):
    return sg.classify_items(items(spark, d)).select("batch_id", "idx", "kind")


@query("validate_signals", twin("SELECT batch_id, idx, error FROM o_err"))
def validate_signals(spark, d):
    return sg.signal_errors(validated(spark, d))


def _drafts(where: str) -> str:
    return f"""
SELECT s.batch_id, s.idx, CASE WHEN s.idx % 37 = 0 THEN 'adr' ELSE 'pdr' END AS type,
       'Signal [support/social]: ' || CASE WHEN s.private THEN 'pii signal' ELSE left(split_part(split_part(i.item, '"content_summary":"', 2), '"', 1), 72) END AS title,
       '2024-05-0' || CAST(s.idx % 9 + 1 AS VARCHAR) AS date, split_part(split_part(i.item, '"suggested_owner":"', 2), '"', 1) AS decider,
       '`signal:s:' || CAST(s.idx AS VARCHAR) || '`' || CASE WHEN s.private THEN '' ELSE '; `t/' || CAST(s.idx AS VARCHAR) || '`; `log`' END AS sources,
       CASE WHEN s.private THEN '[redacted: pii signal]' ELSE split_part(split_part(i.item, '"content_summary":"', 2), '"', 1) END AS summary, 'Proposed' AS status
FROM o_sig s JOIN f_items i ON i.idx = s.idx WHERE {where}
"""


@query("signals_to_drafts", twin(_drafts("NOT EXISTS (SELECT 1 FROM o_err e WHERE e.batch_id = s.batch_id)")))
def signals_to_drafts(spark, d):
    return sg.signals_to_drafts(sg.accepted_signals(validated(spark, d), strict=True))


@query("signals_to_drafts_quarantine", twin(_drafts("NOT EXISTS (SELECT 1 FROM o_err e WHERE e.idx = s.idx)")))
def signals_to_drafts_quarantine(spark, d):
    return sg.signals_to_drafts(sg.accepted_signals(validated(spark, d), strict=False))


@query("numbered_drafts", twin("""
SELECT idx, type, ROW_NUMBER() OVER (PARTITION BY type ORDER BY idx) AS number FROM (SELECT s.idx, CASE WHEN s.idx % 37 = 0 THEN 'adr' ELSE 'pdr' END AS type
  FROM o_sig s WHERE NOT EXISTS (SELECT 1 FROM o_err e WHERE e.idx = s.idx)) x
"""))
def numbered_drafts(spark, d):
    drafts = sg.signals_to_drafts(sg.accepted_signals(validated(spark, d), strict=False)).select("idx", "type")
    none = drafts.where(F.lit(False)).select("type", F.lit(0).alias("last_number"))
    return chains.assign_numbers(drafts, none, "type", "idx", spread=1000).select("idx", "type", F.col("number").cast("bigint").alias("number"))


@query("decisions_to_drafts", twin("""
SELECT batch_id, idx, CASE WHEN idx % 12 = 11 THEN 'skipped' WHEN idx % 5 = 1 THEN 'error' ELSE 'draft' END AS outcome,
       CASE idx % 5 WHEN 0 THEN 'bdr' WHEN 1 THEN 'zzz' ELSE 'adr' END AS type, CASE WHEN idx % 12 <> 11 THEN split_part(split_part(item, '"title":"', 2), '"', 1) END AS title,
       CASE WHEN idx % 8 = 1 THEN '2024-02-03' ELSE '2030-01-01' END AS date, split_part(split_part(item, '"decider":"', 2), '"', 1) AS decider,
       CASE WHEN idx % 4 = 1 THEN '`call ' || CAST(idx AS VARCHAR) || '` (external; **unconfirmed** — pending human review)' ELSE '(external source; **unconfirmed** — pending human review)' END AS sources, 'Proposed' AS status
FROM f_items WHERE idx % 6 = 5
"""))
def decisions_to_drafts(spark, d):
    dec = sg.classify_items(items(spark, d)).where("kind = 'decision'").drop("kind")
    return sg.decisions_to_drafts(dec, "2030-01-01")
