"""Registered queries: freshness, integrity, validation, health, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.operators import freshness as fr
from decisionlake.operators import gates as gt
from decisionlake.operators import health as he
from decisionlake.operators import library as li
from decisionlake.operators import resolve as rs
from decisionlake.operators.library import review_baseline
from decisionlake.plans.q_library import _Q, _TITLES, ALIASED, SHOWN, records
from decisionlake.plans.registry import query
from decisionlake.plans.twins import BLOCKS, over_queries, twin
from decisionlake.session import cut
from decisionlake.sources.fixtures import TODAY
from decisionlake.sources.fixtures import projection as P

MIN_COVERAGE = 0.4

BLOCKS["o_paths"] = """
SELECT lib, rec_id, CASE number % 6 WHEN 5 THEN 'src/o' || CAST((number * 11) % 20000 AS VARCHAR) || '.py'
       ELSE 'src/o' || CAST((number * 7) % 20000 AS VARCHAR) || '.py' END AS source_path FROM f_records WHERE number % 6 >= 2
UNION ALL SELECT lib, rec_id, 'README.md' FROM f_records WHERE number % 6 = 2
UNION ALL SELECT lib, rec_id, 'lib/util' || CAST(entity % 50 AS VARCHAR) FROM f_records WHERE number % 6 = 3
"""
BLOCKS["o_base"] = """
SELECT *, COALESCE(honoured, effective) AS baseline FROM (
  SELECT *, CASE WHEN try_cast(reviewed AS DATE) IS NOT NULL AND reviewed <= '2030-01-01' AND reviewed >= effective THEN reviewed END AS honoured
  FROM (SELECT *, CASE WHEN decided_originally <> '' THEN decided_originally ELSE date END AS effective FROM f_records) r) x
"""
BLOCKS["o_last"] = "SELECT lib, path, CAST(MAX(CAST(commit_ts AS DATE)) AS VARCHAR) AS last_day FROM f_file_changes GROUP BY 1, 2"
BLOCKS["o_changed"] = """
SELECT p.lib, p.rec_id, p.source_path, b.baseline, COALESCE(u.last_day, v.last_day) AS last_change,
       COALESCE(u.last_day, v.last_day) > b.baseline AS changed
FROM o_paths p JOIN o_base b ON b.lib = p.lib AND b.rec_id = p.rec_id
LEFT JOIN o_last u ON u.lib = p.lib AND u.path = 'decisions/' || p.source_path
LEFT JOIN o_last v ON v.lib = p.lib AND v.path = p.source_path
"""
BLOCKS["o_stale"] = """
SELECT b.lib, b.rec_id, b.title, c.stale, b.effective, b.baseline, b.honoured, COALESCE(c.checked, '') AS checked,
       COALESCE(c.stale_paths, '') AS stale_paths,
       CASE WHEN b.number % 6 < 2 THEN 'no cited paths' WHEN c.stale IS NULL THEN 'paths not tracked'
            ELSE CASE WHEN c.stale THEN 'changed after ' ELSE 'unchanged since ' END || CASE WHEN b.honoured IS NOT NULL THEN 'the review' ELSE 'the date' END END AS reason
FROM o_base b LEFT JOIN (
  SELECT lib, rec_id, string_agg(source_path, ',' ORDER BY source_path) AS checked,
         COALESCE(string_agg(CASE WHEN changed THEN source_path END, ',' ORDER BY source_path), '') AS stale_paths, bool_or(changed) AS stale
  FROM o_changed WHERE changed IS NOT NULL GROUP BY 1, 2) c ON c.lib = b.lib AND c.rec_id = b.rec_id
WHERE lower(b.status) LIKE 'accepted%'
"""
BLOCKS["o_exist"] = """
SELECT lib, path FROM f_repo_files UNION SELECT lib, regexp_replace(path, '/[^/]*$', '') FROM f_repo_files WHERE contains(path, '/')
"""
BLOCKS["o_ghost"] = r"""
SELECT DISTINCT p.lib, p.rec_id, p.source_path FROM o_paths p
WHERE regexp_matches(p.source_path, '\.[A-Za-z0-9]{1,5}$')
  AND NOT EXISTS (SELECT 1 FROM o_exist e WHERE e.lib = p.lib AND e.path = p.source_path)
  AND NOT EXISTS (SELECT 1 FROM f_repo_files e WHERE e.lib = p.lib AND NOT e.is_dir
                  AND regexp_replace(e.path, '^.*/', '') = regexp_replace(p.source_path, '^.*/', ''))
"""
BLOCKS["o_refs"] = r"""
SELECT DISTINCT x.lib, x.rec_id, x.ref FROM (
  SELECT lib, rec_id, unnest(regexp_extract_all(body, '\b(?:ADR|BDR|PDR)\s+\d+\b')) AS ref FROM f_records) x WHERE x.ref <> x.rec_id
"""
BLOCKS["o_dangling"] = """
SELECT x.lib, x.rec_id, x.ref FROM o_refs x WHERE NOT EXISTS (SELECT 1 FROM f_records r WHERE r.lib = x.lib AND r.rec_id = x.ref)
"""
BLOCKS["o_anchored"] = """
SELECT DISTINCT t.lib, t.rec_id FROM (SELECT lib, rec_id, source_path FROM o_paths
  UNION ALL SELECT lib, rec_id, 'docs' FROM f_records WHERE number % 6 = 5) t
JOIN o_exist e ON e.lib = t.lib AND e.path = t.source_path
"""
BLOCKS["o_links"] = r"""
SELECT DISTINCT x.lib, x.rec_id, x.ref FROM (
  SELECT lib, rec_id, unnest(regexp_extract_all(status || ' ' || supersedes || ' ' || related, '\b(?:ADR|BDR|PDR)\s+\d+\b')) AS ref FROM f_records) x
JOIN f_records r ON r.lib = x.lib AND r.rec_id = x.ref WHERE x.ref <> x.rec_id
"""
BLOCKS["o_findings"] = r"""
SELECT lib, path AS subject, 'error' AS severity, 'missing_field' AS code, 'Decider' AS detail FROM f_records WHERE decider = ''
UNION ALL SELECT lib, path, 'error', 'bad_status', status FROM f_records
  WHERE NOT regexp_matches(status, '^(Proposed|Accepted|Superseded|Deprecated|Rejected)')
UNION ALL SELECT lib, path, 'warning', 'no_sources', '' FROM f_records WHERE sources = ''
UNION ALL SELECT lib, path, 'warning', 'bad_review',
  CASE WHEN reviewed = 'soon' THEN 'not a YYYY-MM-DD date' WHEN try_cast(reviewed AS DATE) IS NULL THEN 'not a real calendar date'
       WHEN reviewed = '2999-01-01' THEN 'in the future' ELSE 'before the effective date' END FROM o_base WHERE reviewed <> '' AND honoured IS NULL
UNION ALL SELECT lib, path, 'warning', 'file_name', replace(regexp_replace(path, '^.*/', ''), '.md', '') FROM f_records WHERE number % 59 = 0
UNION ALL SELECT x.lib, x.path, 'error', 'unresolved_reference', x.ref FROM (
  SELECT DISTINCT lib, rec_id, path, unnest(regexp_extract_all(status || ' ' || supersedes || ' ' || related, '\b(?:ADR|BDR|PDR)\s+\d+\b')) AS ref
  FROM f_records WHERE contains(lower(status || ' ' || supersedes || ' ' || related), 'supersed')) x
  WHERE x.ref <> x.rec_id AND NOT EXISTS (SELECT 1 FROM f_records r WHERE r.lib = x.lib AND r.rec_id = x.ref)
UNION ALL SELECT DISTINCT lib, a, 'error', 'supersede_cycle', '' FROM o_reach WHERE a = b
UNION ALL SELECT lib, alias, 'error', 'ambiguous_alias', CAST(COUNT(*) AS VARCHAR) FROM o_amap GROUP BY lib, alias HAVING COUNT(*) > 1
UNION ALL SELECT lib, rec_id, 'error', 'invalid_chain', reason FROM o_invalid
"""
BLOCKS["o_dist"] = """
SELECT lib, COUNT(*) AS records_total,
       SUM(CASE WHEN lower(status) LIKE 'accepted%' THEN 1 ELSE 0 END) AS accepted, SUM(CASE WHEN lower(status) LIKE 'proposed%' THEN 1 ELSE 0 END) AS proposed,
       SUM(CASE WHEN lower(status) LIKE 'superseded%' THEN 1 ELSE 0 END) AS superseded, SUM(CASE WHEN lower(status) LIKE 'deprecated%' THEN 1 ELSE 0 END) AS deprecated,
       SUM(CASE WHEN lower(status) LIKE 'rejected%' THEN 1 ELSE 0 END) AS rejected,
       SUM(CASE WHEN regexp_matches(lower(status), '^(accepted|proposed|superseded|deprecated|rejected)') THEN 0 ELSE 1 END) AS other
FROM f_records GROUP BY lib
"""
BLOCKS["o_rate"] = """
SELECT r.lib, SUM(CASE WHEN lower(status) LIKE 'accepted%' AND a.rec_id IS NOT NULL THEN 1 ELSE 0 END) AS accepted_anchored,
       SUM(CASE WHEN lower(status) LIKE 'accepted%' THEN 1 ELSE 0 END) AS accepted_total,
       SUM(CASE WHEN a.rec_id IS NOT NULL THEN 1 ELSE 0 END) AS all_anchored, COUNT(*) AS all_total
FROM f_records r LEFT JOIN o_anchored a ON a.lib = r.lib AND a.rec_id = r.rec_id GROUP BY r.lib
"""
BLOCKS["o_acov"] = """
SELECT lib, SUM(CASE WHEN aliases <> '' THEN 1 ELSE 0 END) AS with_aliases, COUNT(*) AS accepted_total
FROM f_records WHERE lower(status) LIKE 'accepted%' GROUP BY lib
"""
BLOCKS["o_orphans"] = """
SELECT r.lib, r.rec_id FROM f_records r WHERE lower(r.status) LIKE 'accepted%'
 AND NOT EXISTS (SELECT 1 FROM o_links l WHERE l.lib = r.lib AND l.rec_id = r.rec_id)
 AND NOT EXISTS (SELECT 1 FROM o_links l WHERE l.lib = r.lib AND l.ref = r.rec_id)
"""
BLOCKS["o_scount"] = """
SELECT lib, COUNT(*) AS checked, SUM(CASE WHEN stale THEN 1 ELSE 0 END) AS stale, SUM(CASE WHEN stale IS NULL THEN 1 ELSE 0 END) AS unknown,
       SUM(CASE WHEN NOT stale THEN 1 ELSE 0 END) AS fresh FROM o_stale GROUP BY lib
"""
BLOCKS["o_depths"] = """
SELECT lib, MAX(depth) AS max_chain_depth, round(AVG(CASE WHEN depth >= 1 THEN depth END), 3) AS mean_chain_depth FROM o_res GROUP BY lib
"""


CHECKED = [*ALIASED, "type", "label", "number", "path", "date", "decided_originally", "reviewed", "decider", "sources", "related"]


def library_of(spark, d):
    return rs.Library.of(records(spark, d))


def changes(spark, d):
    return cut(P(spark, d, "f_change_list"))


def changed(spark, d):
    return cut(P(spark, d, "f_changes").select("lib", F.col("change_id").alias("change_key"), "path"))


def repo(spark, d):
    return cut(P(spark, d, "f_repo_files"))


def assessed(spark, d, r=None):
    return fr.assess_staleness(records(spark, d) if r is None else r, P(spark, d, "f_file_changes"), TODAY)


@query("changed_after", twin("SELECT lib, rec_id, source_path, baseline, last_change, changed FROM o_changed"))
def changed_after(spark, d):
    base = review_baseline(records(spark, d), TODAY)
    paths = li.extract_source_paths(base).join(base.select("lib", "rec_id", "baseline"), ["lib", "rec_id"])
    return fr.changed_after(paths, P(spark, d, "f_file_changes"))


@query("assess_staleness", twin(
    "SELECT lib, rec_id, title, stale, effective, baseline, honoured, checked, stale_paths, reason FROM o_stale"))
def assess_staleness(spark, d):
    return assessed(spark, d)


@query("staleness_counts", twin("SELECT lib, checked, stale, unknown, fresh FROM o_scount"))
def staleness_counts(spark, d):
    return fr.staleness_counts(assessed(spark, d))


_DRIFT = """
SELECT l.lib, CASE WHEN s.stale > 0 THEN 'stale' ELSE 'fresh' END AS status, s.stale, s.unknown, s.fresh, CAST(NULL AS VARCHAR) AS skip_reason
FROM o_scount s JOIN (SELECT DISTINCT lib FROM f_records) l ON l.lib = s.lib
UNION ALL SELECT 'lib9', 'skip', 0, 0, 0, 'no_history'
"""


def _drift(spark, d, r):
    libs = r.select("lib").distinct().unionByName(spark.sql("SELECT 'lib9' AS lib"))
    return fr.drift_report(libs, assessed(spark, d, r), P(spark, d, "f_file_changes"))


@query("drift_report", twin(_DRIFT))
def drift_report(spark, d):
    return _drift(spark, d, records(spark, d))


@query("ghost_sources", twin("SELECT lib, rec_id, source_path FROM o_ghost"))
def ghost_sources(spark, d):
    return fr.ghost_sources(records(spark, d), repo(spark, d))


@query("dangling_refs", twin("SELECT lib, rec_id, ref FROM o_dangling"))
def dangling_refs(spark, d):
    return fr.dangling_refs(records(spark, d))


@query("anchored", twin("SELECT lib, rec_id FROM o_anchored"))
def anchored(spark, d):
    return fr.anchored(records(spark, d), repo(spark, d))


@query("assess_integrity", twin("""
SELECT lib, rec_id, 'dangling_ref' AS kind, ref AS detail FROM o_dangling UNION ALL SELECT lib, rec_id, 'ghost_source', source_path FROM o_ghost
"""))
def assess_integrity(spark, d):
    return fr.assess_integrity(records(spark, d), repo(spark, d))


@query("validate_records", twin("SELECT lib, subject, severity, code, detail FROM o_findings"))
def validate_records(spark, d):
    return he.validate_records(rs.Library.of(records(spark, d, CHECKED)), TODAY)


@query("status_distribution", twin("""
SELECT lib, records_total, accepted, proposed, superseded, deprecated, rejected, other,
       superseded + deprecated + rejected AS retired, round((superseded + deprecated + rejected) * 1.0 / records_total, 3) AS retired_rate FROM o_dist
"""))
def status_distribution(spark, d):
    return he.status_distribution(records(spark, d))


@query("chain_depths", twin("SELECT lib, max_chain_depth, mean_chain_depth FROM o_depths"))
def chain_depths(spark, d):
    from decisionlake.operators import graph
    return he.chain_depths(graph.resolve_current(records(spark, d)))


@query("anchoring_rate", twin("""
SELECT lib, accepted_anchored, accepted_total, all_anchored, all_total, round(accepted_anchored * 1.0 / accepted_total, 6) AS rate_raw,
       round(accepted_anchored * 1.0 / accepted_total, 3) AS rate FROM o_rate
"""))
def anchoring_rate(spark, d):
    r = records(spark, d)
    return he.anchoring_rate(r, fr.anchored(r, repo(spark, d))).withColumn("rate_raw", F.round("rate_raw", 6))


@query("unanchored", twin("""
SELECT r.lib, r.rec_id FROM f_records r WHERE lower(r.status) LIKE 'accepted%'
AND NOT EXISTS (SELECT 1 FROM o_anchored a WHERE a.lib = r.lib AND a.rec_id = r.rec_id)
"""))
def unanchored(spark, d):
    r = records(spark, d)
    return he.unanchored(r, fr.anchored(r, repo(spark, d)))


@query("alias_coverage", twin("SELECT lib, with_aliases, accepted_total, round(with_aliases * 1.0 / accepted_total, 3) AS rate FROM o_acov"))
def alias_coverage(spark, d):
    return he.alias_coverage(records(spark, d))


@query("orphans", twin("SELECT lib, rec_id FROM o_orphans"))
def orphans(spark, d):
    r = records(spark, d)
    return he.orphans(r, he.references(r))


BLOCKS["o_ambiguous"] = """
SELECT a.lib, a.rec_id FROM f_records a JOIN o_summary s ON s.lib = a.lib AND s.query_id = a.title
WHERE lower(a.status) LIKE 'accepted%' AND NOT (s.resolved_unique AND EXISTS (
  SELECT 1 FROM o_ends e WHERE e.lib = a.lib AND e.query_id = a.title AND e.endpoint = a.rec_id))
"""


@query("library_health", over_queries(_TITLES, """
SELECT d.lib, d.records_total, d.accepted, d.proposed, d.superseded, d.deprecated, d.rejected, d.other,
       d.superseded + d.deprecated + d.rejected AS retired, round((d.superseded + d.deprecated + d.rejected) * 1.0 / d.records_total, 3) AS retired_rate,
       h.max_chain_depth, h.mean_chain_depth, r.accepted_anchored, r.accepted_total, round(r.accepted_anchored * 1.0 / r.accepted_total, 3) AS anchoring_rate,
       c.with_aliases, round(c.with_aliases * 1.0 / c.accepted_total, 3) AS alias_rate,
       (SELECT COUNT(*) FROM o_orphans o WHERE o.lib = d.lib) AS orphans, (SELECT COUNT(*) FROM o_ambiguous o WHERE o.lib = d.lib) AS ambiguous_topics,
       s.stale, s.unknown, s.fresh
FROM o_dist d JOIN o_depths h ON h.lib = d.lib JOIN o_rate r ON r.lib = d.lib JOIN o_acov c ON c.lib = d.lib JOIN o_scount s ON s.lib = d.lib
"""))
def library_health(spark, d):
    lib = library_of(spark, d)
    return he.library_health(lib, fr.anchored(lib.records, repo(spark, d)), assessed(spark, d, lib.records), rs.ambiguous_topics(lib))


# --- gates -----------------------------------------------------------------------------------
@query("changed_paths", twin("""
SELECT DISTINCT lib, change_key, path, error FROM (
  SELECT lib, change_key, split_part(split_part(diff, ' b/', 2), chr(10), 1) AS path, false AS error FROM f_diffs WHERE diff LIKE 'diff%'
  UNION ALL SELECT lib, change_key, replace(split_part(diff, chr(10), 1), './', ''), false FROM f_diffs WHERE diff LIKE 'src%'
  UNION ALL SELECT lib, change_key, 'web/a b.ts', false FROM f_diffs WHERE diff LIKE 'src%'
  UNION ALL SELECT lib, change_key, split_part(diff, chr(10), 1), true FROM f_diffs WHERE diff LIKE '/etc%'
  UNION ALL SELECT lib, change_key, '../up.py', true FROM f_diffs WHERE diff LIKE '/etc%') x
"""))
def changed_paths(spark, d):
    return gt.parse_changes(P(spark, d, "f_diffs"))


BLOCKS["o_gated"] = """
SELECT DISTINCT c.lib, c.change_id AS change_key, c.path, p.pattern, p.rec_id FROM f_changes c JOIN (
  SELECT lib, rec_id, 'src/o' || CAST(number % 10 AS VARCHAR) || '*.py' AS pattern, 'src/o' || CAST(number % 10 AS VARCHAR) || '%.py' AS pat FROM f_records WHERE gated_paths <> '' AND lower(status) LIKE 'accepted%'
  UNION ALL SELECT lib, rec_id, 'web/*/index.ts', 'web/%/index.ts' FROM f_records WHERE gated_paths <> '' AND lower(status) LIKE 'accepted%') p
ON p.lib = c.lib AND c.path LIKE p.pat
"""
BLOCKS["o_approvals"] = """
SELECT DISTINCT c.lib, c.change_key, r.rec_id FROM f_change_list c JOIN f_records r ON r.lib = c.lib AND r.approval_for = c.change_id
WHERE lower(r.status) LIKE 'accepted%' AND r.sources <> '' AND r.decider <> ''
"""
BLOCKS["o_evidence"] = """
SELECT c.lib, c.change_key, r.rec_id, a.artifact, COALESCE(e.path IS NOT NULL, false) AS present
FROM f_change_list c JOIN f_records r ON r.lib = c.lib AND r.evidence_for = c.change_id AND lower(r.status) LIKE 'accepted%'
JOIN (SELECT lib, rec_id, 'screenshot: src/o' || CAST(number % 20000 AS VARCHAR) || '.py' AS artifact, 'src/o' || CAST(number % 20000 AS VARCHAR) || '.py' AS p FROM f_records WHERE evidence_artifacts <> ''
      UNION ALL SELECT lib, rec_id, 'video:../x.mp4', NULL FROM f_records WHERE evidence_artifacts <> '') a ON a.lib = r.lib AND a.rec_id = r.rec_id
LEFT JOIN o_exist e ON e.lib = c.lib AND e.path = a.p
"""
BLOCKS["o_pcount"] = """
SELECT l.lib, l.change_key, l.change_id, COALESCE(n.n, 0) AS n_paths, COALESCE(n.u, 0) AS n_ui FROM f_change_list l LEFT JOIN (
  SELECT lib, change_id AS change_key, COUNT(*) AS n, SUM(CASE WHEN path LIKE '%.ts' THEN 1 ELSE 0 END) AS u FROM f_changes GROUP BY 1, 2) n
ON n.lib = l.lib AND n.change_key = l.change_key
"""
BLOCKS["o_libs"] = "SELECT DISTINCT lib FROM f_records"
BLOCKS["o_g_validation"] = """
SELECT l.lib, 'validation' AS gate, CASE WHEN f.e + f.w > 0 THEN 'fail' ELSE 'pass' END AS status,
       CAST(f.e AS VARCHAR) || ' errors, ' || CAST(f.w AS VARCHAR) || ' warnings' AS reason, CAST(f.e + f.w AS BIGINT) AS evidence
FROM o_libs l JOIN (SELECT lib, CAST(SUM(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS e, CAST(SUM(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS w FROM o_findings GROUP BY lib) f ON f.lib = l.lib
"""
BLOCKS["o_g_integrity"] = """
SELECT l.lib, 'integrity' AS gate, 'fail' AS status, CAST(COUNT(*) AS VARCHAR) || ' integrity issue(s)' AS reason, COUNT(*) AS evidence
FROM o_libs l JOIN (SELECT lib FROM o_dangling UNION ALL SELECT lib FROM o_ghost) f ON f.lib = l.lib GROUP BY l.lib
"""
BLOCKS["o_g_staleness"] = """
SELECT lib, 'staleness' AS gate, CASE WHEN stale > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(CAST(stale AS BIGINT) AS VARCHAR) || ' stale record(s)' AS reason, CAST(stale AS BIGINT) AS evidence
FROM o_scount
"""
BLOCKS["o_g_anchoring"] = """
SELECT lib, 'anchoring' AS gate, CASE WHEN accepted_anchored * 1.0 / accepted_total < 0.4 THEN 'fail' ELSE 'pass' END AS status,
       'coverage ' || printf('%.3f', CAST(accepted_anchored AS DOUBLE) / accepted_total) || CASE WHEN accepted_anchored * 1.0 / accepted_total < 0.4 THEN ' below' ELSE ' meets' END || ' minimum 0.400' AS reason,
       CAST(1 AS BIGINT) AS evidence FROM o_rate
"""
BLOCKS["o_g_denylist"] = """
SELECT p.lib, p.change_key, 'denylist' AS gate,
       CASE WHEN n_paths = 0 THEN 'skip' WHEN COALESCE(h.n, 0) = 0 THEN 'pass' WHEN p.change_id IS NULL THEN 'fail' WHEN a.n > 0 THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN n_paths = 0 THEN 'no_changed_paths' WHEN COALESCE(h.n, 0) = 0 THEN 'no_human_gated_paths_touched' WHEN p.change_id IS NULL THEN 'change_id_required_for_human_gated_paths'
            WHEN a.n > 0 THEN 'human_approval_found' ELSE 'missing_human_approval' END AS reason, COALESCE(h.n, 0) AS evidence
FROM o_pcount p LEFT JOIN (SELECT lib, change_key, COUNT(*) AS n FROM o_gated GROUP BY 1, 2) h ON h.lib = p.lib AND h.change_key = p.change_key
LEFT JOIN (SELECT lib, change_key, COUNT(*) AS n FROM o_approvals GROUP BY 1, 2) a ON a.lib = p.lib AND a.change_key = p.change_key
"""
BLOCKS["o_g_evidence"] = """
SELECT p.lib, p.change_key, 'evidence_presence' AS gate,
       CASE WHEN n_paths = 0 THEN 'skip' WHEN n_ui = 0 THEN 'pass' WHEN p.change_id IS NULL THEN 'fail' WHEN e.n > 0 THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN n_paths = 0 THEN 'no_changed_paths' WHEN n_ui = 0 THEN 'no_ui_paths_touched' WHEN p.change_id IS NULL THEN 'change_id_required_for_ui_evidence'
            WHEN e.n > 0 THEN 'existing_evidence_artifact_found' ELSE 'missing_existing_evidence_artifact' END AS reason, CAST(n_ui AS BIGINT) AS evidence
FROM o_pcount p LEFT JOIN (SELECT lib, change_key, SUM(CASE WHEN present THEN 1 ELSE 0 END) AS n FROM o_evidence GROUP BY 1, 2) e ON e.lib = p.lib AND e.change_key = p.change_key
"""
_G = "lib, gate, status, reason, evidence"


@query("gated_paths", twin("SELECT lib, change_key, path, pattern, rec_id FROM o_gated"))
def gated_paths(spark, d):
    return gt.gated_paths(records(spark, d), changed(spark, d))


@query("approvals", twin("SELECT lib, change_key, rec_id FROM o_approvals"))
def approvals(spark, d):
    return gt.approvals(records(spark, d), changes(spark, d))


@query("evidence", twin("SELECT lib, change_key, rec_id, artifact, present FROM o_evidence"))
def evidence(spark, d):
    return gt.evidence(records(spark, d), changes(spark, d), fr.existing_paths(repo(spark, d)))


@query("gate_validation", twin(f"SELECT {_G} FROM o_g_validation"))
def gate_validation(spark, d):
    lib = rs.Library.of(records(spark, d, CHECKED))
    return gt.gate_validation(lib.records, he.validate_records(lib, TODAY))


@query("gate_integrity", twin(f"SELECT {_G} FROM o_g_integrity"))
def gate_integrity(spark, d):
    r = records(spark, d)
    return gt.gate_integrity(r, fr.assess_integrity(r, repo(spark, d)))


@query("gate_staleness", twin(f"SELECT {_G} FROM o_g_staleness UNION ALL SELECT 'lib9', 'staleness', 'skip', 'not_tracked', 0"))
def gate_staleness(spark, d):
    return gt.gate_staleness(_drift(spark, d, records(spark, d)))


@query("gate_anchoring", twin(f"SELECT {_G} FROM o_g_anchoring"))
def gate_anchoring(spark, d):
    r = records(spark, d)
    return gt.gate_anchoring(he.anchoring_rate(r, fr.anchored(r, repo(spark, d))), MIN_COVERAGE)


@query("gate_denylist", twin("SELECT lib, change_key, gate, status, reason, evidence FROM o_g_denylist"))
def gate_denylist(spark, d):
    return gt.gate_denylist(records(spark, d), changes(spark, d), changed(spark, d))


@query("gate_evidence", twin("SELECT lib, change_key, gate, status, reason, evidence FROM o_g_evidence"))
def gate_evidence(spark, d):
    return gt.gate_evidence(records(spark, d), changes(spark, d), changed(spark, d), fr.existing_paths(repo(spark, d)))


BLOCKS["o_gates"] = """
SELECT c.lib, c.change_key, v.status AS validation, i.status AS integrity, s.status AS staleness, a.status AS anchoring, n.status AS denylist, e.status AS evidence_presence,
       NOT ('fail' IN (v.status, i.status, s.status, a.status, n.status, e.status)) AS ok
FROM f_change_list c JOIN o_g_validation v ON v.lib = c.lib JOIN o_g_integrity i ON i.lib = c.lib JOIN o_g_staleness s ON s.lib = c.lib JOIN o_g_anchoring a ON a.lib = c.lib
JOIN o_g_denylist n ON n.lib = c.lib AND n.change_key = c.change_key JOIN o_g_evidence e ON e.lib = c.lib AND e.change_key = c.change_key
"""


def gates(spark, d, lib, stale):
    r, ch, cp, rf = lib.records, changes(spark, d), changed(spark, d), repo(spark, d)
    per_lib = gt.gate_validation(r, he.validate_records(lib, TODAY)).unionByName(
        gt.gate_integrity(r, fr.assess_integrity(r, rf))).unionByName(
        gt.gate_staleness(fr.drift_report(r, stale, P(spark, d, "f_file_changes")))).unionByName(
        gt.gate_anchoring(he.anchoring_rate(r, fr.anchored(r, rf)), MIN_COVERAGE))
    per_change = gt.gate_denylist(r, ch, cp).unionByName(gt.gate_evidence(r, ch, cp, fr.existing_paths(rf)))
    return gt.gates_report(ch, per_lib, per_change)


@query("gates_report", twin("""
SELECT lib, change_key, validation, integrity, staleness, anchoring, denylist, evidence_presence, ok FROM o_gates
"""))
def gates_report(spark, d):
    lib = library_of(spark, d)
    return gates(spark, d, lib, cut(assessed(spark, d, lib.records)))


BLOCKS["o_state"] = """
SELECT lib, query_id, CASE WHEN reason <> '' THEN 'fail' WHEN live = 0 THEN 'skip' ELSE 'pass' END AS status,
       CASE WHEN reason <> '' THEN reason WHEN live = 0 THEN 'no_current_decision' ELSE 'decision_state_resolved' END AS reason
FROM (SELECT s.lib, s.query_id, s.literal_endpoints + s.alias_endpoints AS live, concat_ws(',', CASE WHEN s.conflict THEN 'conflict' END,
             CASE WHEN s.alias_conflicts > 0 THEN 'alias_conflict' END, CASE WHEN s.invalid_aliases > 0 THEN 'invalid_alias_note' END,
             CASE WHEN k.query_id IS NOT NULL THEN 'stale_current' END, CASE WHEN NOT s.resolved_unique AND s.matched_records > 0 THEN 'not_resolved_unique' END) AS reason
      FROM o_summary s LEFT JOIN (SELECT DISTINCT l.lib, l.query_id FROM o_literal l JOIN o_stale t ON t.lib = l.lib AND t.rec_id = l.endpoint WHERE t.stale) k
        ON k.lib = s.lib AND k.query_id = s.query_id) x
"""


@query("decision_state", over_queries(_Q, "SELECT lib, query_id, status, reason FROM o_state"))
def decision_state(spark, d):
    lib = rs.Library.of(records(spark, d, [*SHOWN, "reviewed", "sources"]))
    res = rs.resolve(lib, P(spark, d, "f_queries"))
    return gt.decision_state(res.summary, res.endpoints, assessed(spark, d, lib.records))


@query("preflight_report", over_queries(_Q, """
SELECT q.lib, q.query_id AS preflight_id, q.query_id, 'c' || CAST(q.query_id % 3000 AS VARCHAR) AS change_key, s.status AS decision_state, s.reason AS state_reason,
       CASE WHEN g.ok THEN 'pass' WHEN NOT g.ok THEN 'fail' END AS gates, COALESCE(s.status, 'skip') <> 'fail' AND COALESCE(g.ok, true) AS ok
FROM f_queries q LEFT JOIN o_state s ON s.lib = q.lib AND s.query_id = q.query_id
LEFT JOIN o_gates g ON g.lib = q.lib AND g.change_key = 'c' || CAST(q.query_id % 3000 AS VARCHAR)
"""))
def preflight_report(spark, d):
    lib = library_of(spark, d)
    q = P(spark, d, "f_queries")
    stale = cut(assessed(spark, d, lib.records))
    res = rs.resolve(lib, q)
    state = gt.decision_state(res.summary, res.endpoints, stale)
    asks = q.select("lib", F.col("query_id").alias("preflight_id"), "query_id",
                    F.concat(F.lit("c"), (F.col("query_id") % 3000).cast("string")).alias("change_key"))
    return gt.preflight_report(asks, state, gates(spark, d, lib, stale))
