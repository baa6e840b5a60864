"""SQL twins: named building blocks for the DuckDB side of each registered query."""

from __future__ import annotations

import re

from decisionlake.sources import fixtures as fx

BLOCKS: dict[str, str] = {}


def _needs(text: str, seen: list[str]) -> None:
    for name in re.findall(r"\b[of]_[a-z0-9_]+\b", text):
        body = BLOCKS.get(name) or fx.PROJECTIONS.get(name)
        if body is None or name in seen:
            continue
        _needs(body.replace(name, "self"), seen)
        if name not in seen:
            seen.append(name)


def twin(body: str) -> str:
    """The full statement: every block and projection the body uses, then the body."""
    seen: list[str] = []
    _needs(body, seen)
    parts = []
    for name in seen:
        text = (BLOCKS.get(name) or fx.PROJECTIONS[name]).strip()
        head = name
        if text.startswith("("):      # recursive blocks carry their column list: "(a, b) AS ..."
            cols, text = text.split("::", 1)
            head = f"{name}{cols.strip()}"
        parts.append(f"{head} AS ({text.strip()})")
    text = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
    for t in fx.TABLES:
        text = text.replace("{" + t + "}", t)
    return text


BLOCKS["o_next"] = """
SELECT lib, rec_id, CASE WHEN status LIKE 'Superseded by %' THEN substr(status, 15) END AS nxt FROM f_records
"""
BLOCKS["o_ptr"] = """
SELECT a.lib, a.rec_id, b.rec_id AS next_id,
       CASE WHEN a.nxt IS NULL THEN 'live' WHEN b.rec_id IS NULL THEN 'missing' END AS terminal
FROM o_next a LEFT JOIN o_next b ON a.lib = b.lib AND a.nxt = b.rec_id
"""
BLOCKS["o_walk"] = """(lib, rec_id, hop, at_id, path, rev) ::
SELECT lib, rec_id, 0, rec_id, [rec_id], false FROM o_ptr
UNION ALL
SELECT w.lib, w.rec_id, w.hop + 1, p.next_id, list_append(w.path, p.next_id), list_contains(w.path, p.next_id)
FROM o_walk w JOIN o_ptr p ON w.lib = p.lib AND w.at_id = p.rec_id
WHERE p.next_id IS NOT NULL AND NOT w.rev
"""
BLOCKS["o_res"] = """
SELECT x.lib, x.rec_id, x.endpoint, x.depth, CASE WHEN x.looped THEN 'cycle' ELSE p.terminal END AS terminal
FROM (SELECT lib, rec_id, arg_max(at_id, hop) AS endpoint, CAST(MAX(hop) AS BIGINT) AS depth, bool_or(rev) AS looped
      FROM o_walk GROUP BY lib, rec_id) x JOIN o_ptr p ON p.lib = x.lib AND p.rec_id = x.endpoint
"""
BLOCKS["o_trail"] = """
SELECT w.lib, w.rec_id, CAST(w.hop AS BIGINT) AS hop, w.at_id AS walked_id
FROM o_walk w JOIN o_res r ON r.lib = w.lib AND r.rec_id = w.rec_id WHERE w.hop < r.depth
"""
BLOCKS["o_edges"] = """
SELECT DISTINCT e.lib, e.src_id, e.dst_id, e.via FROM (
  SELECT lib, rec_id AS src_id, nxt AS dst_id, 'status' AS via FROM o_next WHERE nxt IS NOT NULL
  UNION ALL SELECT lib, supersedes, rec_id, 'supersedes' FROM f_records WHERE supersedes <> '') e
JOIN f_records a ON a.lib = e.lib AND a.rec_id = e.src_id JOIN f_records b ON b.lib = e.lib AND b.rec_id = e.dst_id
"""
BLOCKS["o_vedges"] = """
SELECT DISTINCT lib, src_id, dst_id FROM (
  SELECT lib, rec_id AS src_id, nxt AS dst_id FROM o_next WHERE nxt IS NOT NULL
  UNION ALL SELECT lib, supersedes, rec_id FROM f_records WHERE supersedes <> '') e
"""
BLOCKS["o_reach"] = """(lib, a, b) ::
SELECT lib, src_id, dst_id FROM o_vedges
UNION
SELECT r.lib, r.a, e.dst_id FROM o_reach r JOIN o_vedges e ON e.lib = r.lib AND e.src_id = r.b
"""
BLOCKS["o_reasons"] = """
SELECT p.lib, p.rec_id,
       CASE WHEN k.ways >= 2 THEN 'forked: ' || CAST(k.ways AS VARCHAR) || ' superseders'
            WHEN n.nxt IS NULL THEN NULL
            WHEN b.rec_id IS NULL THEN 'names missing superseder ' || n.nxt
            WHEN b.supersedes <> '' AND b.supersedes <> n.rec_id THEN 'not listed back by ' || n.nxt END AS reason
FROM o_ptr p JOIN o_next n ON n.lib = p.lib AND n.rec_id = p.rec_id
LEFT JOIN f_records b ON b.lib = n.lib AND b.rec_id = n.nxt
LEFT JOIN (SELECT lib, src_id, COUNT(DISTINCT dst_id) AS ways FROM o_edges GROUP BY 1, 2) k
  ON k.lib = p.lib AND k.src_id = p.rec_id
"""
BLOCKS["o_invalid"] = """
SELECT r.lib, r.rec_id, COALESCE(x.reason, CASE WHEN r.terminal = 'cycle' THEN 'supersede cycle' END) AS reason
FROM o_res r JOIN f_records f ON f.lib = r.lib AND f.rec_id = r.rec_id AND f.aliases <> ''
LEFT JOIN (SELECT w.lib, w.rec_id, arg_min(q.reason, w.hop) AS reason FROM o_walk w
           JOIN o_reasons q ON q.lib = w.lib AND q.rec_id = w.at_id WHERE q.reason IS NOT NULL GROUP BY 1, 2) x
  ON x.lib = r.lib AND x.rec_id = r.rec_id
WHERE x.reason IS NOT NULL OR r.terminal = 'cycle'
"""
BLOCKS["o_aliases"] = r"""
SELECT DISTINCT lib, rec_id, trim(regexp_replace(lower(a), '[\s\-_/\\]+', ' ', 'g')) AS alias
FROM (SELECT lib, rec_id, unnest(string_split(aliases, ';')) AS a FROM f_records WHERE aliases <> '') x
WHERE trim(regexp_replace(lower(a), '[\s\-_/\\]+', ' ', 'g')) <> ''
"""
BLOCKS["o_amap"] = """
SELECT DISTINCT a.lib, a.alias, r.endpoint AS target_id FROM o_aliases a
JOIN o_res r ON r.lib = a.lib AND r.rec_id = a.rec_id
JOIN f_records e ON e.lib = r.lib AND e.rec_id = r.endpoint AND lower(e.status) LIKE 'accepted%'
WHERE NOT EXISTS (SELECT 1 FROM o_invalid i WHERE i.lib = a.lib AND i.rec_id = a.rec_id)
"""
BLOCKS["o_inv_alias"] = """
SELECT DISTINCT a.lib, a.alias FROM o_aliases a JOIN o_invalid i ON i.lib = a.lib AND i.rec_id = a.rec_id
"""
STOP = "('api', 'app', 'web', 'auth', 'prod', 'test', 'db', 'data', 'core', 'service')"
BLOCKS["o_q_tokens"] = r"""
SELECT lib, query_id, string_split(trim(regexp_replace(lower(text), '[\s\-_/\\]+', ' ', 'g')), ' ') AS toks FROM o_q
"""


def alias_blocks(tag: str, source: str) -> None:
    """Greedy longest-leftmost matching of the aliases in ``source`` against ``o_q``."""
    BLOCKS[f"o_cand_{tag}"] = f"""
SELECT g.lib, g.query_id, g.s, MAX(g.l) AS l FROM (
  SELECT lib, query_id, s, l, array_to_string(list_slice(toks, s, s + l - 1), ' ') AS gram FROM (
    SELECT lib, query_id, toks, s, unnest(range(1, 7)) AS l FROM (
      SELECT lib, query_id, toks, unnest(range(1, len(toks) + 1)) AS s FROM o_q_tokens) a) b
  WHERE s + l - 1 <= len(toks)) g
JOIN (SELECT DISTINCT lib, alias FROM {source}) k ON k.lib = g.lib AND k.alias = g.gram AND k.alias NOT IN {STOP}
GROUP BY g.lib, g.query_id, g.s
"""
    BLOCKS[f"o_scan_{tag}"] = f"""(lib, query_id, s, l) ::
SELECT lib, query_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM o_q_tokens
UNION ALL
SELECT p.lib, p.query_id, p.s + CASE WHEN p.l > 0 THEN p.l WHEN p.l = 0 THEN 0 ELSE 1 END, COALESCE(c.l, -1)
FROM o_scan_{tag} p JOIN o_q_tokens t ON t.lib = p.lib AND t.query_id = p.query_id
LEFT JOIN o_cand_{tag} c ON c.lib = p.lib AND c.query_id = p.query_id
  AND c.s = p.s + CASE WHEN p.l > 0 THEN p.l WHEN p.l = 0 THEN 0 ELSE 1 END
WHERE p.s + CASE WHEN p.l > 0 THEN p.l WHEN p.l = 0 THEN 0 ELSE 1 END <= len(t.toks)
"""
    BLOCKS[f"o_hit_{tag}"] = f"""
SELECT DISTINCT p.lib, p.query_id, array_to_string(list_slice(t.toks, p.s, p.s + p.l - 1), ' ') AS alias
FROM o_scan_{tag} p JOIN o_q_tokens t ON t.lib = p.lib AND t.query_id = p.query_id WHERE p.l > 0
"""


alias_blocks("ok", "o_amap")
alias_blocks("bad", "o_inv_alias")

BLOCKS["o_match"] = """
SELECT q.lib, q.query_id, h.rec_id FROM o_q q JOIN f_haystack h ON h.lib = q.lib AND contains(h.hay, lower(q.text))
"""
BLOCKS["o_literal"] = """
SELECT DISTINCT m.lib, m.query_id, r.endpoint FROM o_match m JOIN o_res r ON r.lib = m.lib AND r.rec_id = m.rec_id
JOIN f_records e ON e.lib = r.lib AND e.rec_id = r.endpoint AND lower(e.status) LIKE 'accepted%'
"""
BLOCKS["o_targets"] = """
SELECT h.lib, h.query_id, h.alias, a.target_id, COUNT(*) OVER (PARTITION BY h.lib, h.query_id, h.alias) AS n
FROM o_hit_ok h JOIN o_amap a ON a.lib = h.lib AND a.alias = h.alias
"""
BLOCKS["o_via"] = """
SELECT t.lib, t.query_id, t.target_id AS endpoint, t.alias FROM o_targets t WHERE t.n = 1
AND NOT EXISTS (SELECT 1 FROM o_literal l WHERE l.lib = t.lib AND l.query_id = t.query_id AND l.endpoint = t.target_id)
"""
BLOCKS["o_summary"] = """
SELECT lib, query_id, text, matched_records, literal_endpoints, alias_endpoints, alias_conflicts, invalid_aliases,
       literal_endpoints > 1 AS conflict,
       literal_endpoints + alias_endpoints = 1 AND alias_conflicts = 0 AND invalid_aliases = 0 AS resolved_unique,
       concat_ws('; ', CASE WHEN literal_endpoints > 1 THEN 'conflict' WHEN literal_endpoints = 0 AND alias_endpoints = 0 THEN 'no current record' END,
         CASE WHEN alias_conflicts > 0 THEN 'ambiguous codename' END,
         CASE WHEN invalid_aliases > 0 THEN 'invalid supersession chain' END) AS note
FROM (SELECT q.lib, q.query_id, q.text, COALESCE(m.n, 0) AS matched_records, COALESCE(l.n, 0) AS literal_endpoints,
             COALESCE(v.n, 0) AS alias_endpoints, COALESCE(c.n, 0) AS alias_conflicts, COALESCE(b.n, 0) AS invalid_aliases
      FROM o_q q
      LEFT JOIN (SELECT lib, query_id, COUNT(*) AS n FROM o_match GROUP BY 1, 2) m ON m.lib = q.lib AND m.query_id = q.query_id
      LEFT JOIN (SELECT lib, query_id, COUNT(*) AS n FROM o_literal GROUP BY 1, 2) l ON l.lib = q.lib AND l.query_id = q.query_id
      LEFT JOIN (SELECT lib, query_id, COUNT(DISTINCT endpoint) AS n FROM o_via GROUP BY 1, 2) v ON v.lib = q.lib AND v.query_id = q.query_id
      LEFT JOIN (SELECT lib, query_id, COUNT(DISTINCT alias) AS n FROM o_targets WHERE n > 1 GROUP BY 1, 2) c ON c.lib = q.lib AND c.query_id = q.query_id
      LEFT JOIN (SELECT lib, query_id, COUNT(*) AS n FROM o_hit_bad GROUP BY 1, 2) b ON b.lib = q.lib AND b.query_id = q.query_id) x
"""
BLOCKS["o_ends"] = """
SELECT lib, query_id, endpoint, 'literal' AS via, '' AS alias FROM o_literal
UNION ALL SELECT lib, query_id, endpoint, 'alias', alias FROM o_via
"""
BLOCKS["o_replaced"] = """
SELECT r.lib, r.rec_id, CASE WHEN s.rec_id IS NOT NULL THEN s.rec_id ELSE b.back_id END AS replaced_id
FROM f_records r LEFT JOIN f_records s ON s.lib = r.lib AND s.rec_id = r.supersedes
LEFT JOIN (SELECT n.lib, n.nxt, arg_min(n.rec_id, f.type || '|' || f.path) AS back_id FROM o_next n
           JOIN f_records f ON f.lib = n.lib AND f.rec_id = n.rec_id WHERE n.nxt IS NOT NULL AND n.nxt <> n.rec_id GROUP BY 1, 2) b
  ON b.lib = r.lib AND b.nxt = r.rec_id
WHERE s.rec_id IS NOT NULL OR b.back_id IS NOT NULL
"""


def over_queries(source: str, body: str) -> str:
    """A twin whose query table ``o_q`` is ``source``."""
    BLOCKS["o_q"] = source
    try:
        return twin(body)
    finally:
        del BLOCKS["o_q"]
