"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from decisionlake.llm import quality_rules as q

SPLIT = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def quality_figures(source: str = "documents") -> str:
    """Common table expressions up to ``figures``."""
    symbols = "".join("\\" + c if c in "|$*" else c for c in q.SYMBOLS)
    return f"""
texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM {source}),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPLIT}'), lambda w: w <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HAS_WORD}')) AS lines FROM texts),
placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM split),
windows AS (SELECT doc_id, pos, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) WHERE repeated.n > 1 GROUP BY doc_id),
raw AS (SELECT s.doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{SPLIT}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^{symbols}]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
        FROM split s LEFT JOIN covered ON covered.doc_id = s.doc_id),
figures AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM raw)"""


def quality_verdicts(source: str = "documents") -> str:
    """Common table expressions up to ``verdicts`` (figures with ``kept``)."""
    rules = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {c} AS cutoff" for r in q.RULES for c in r.cutoffs)
    ratios = " UNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, '{r.name}' AS rule, CASE WHEN {r.under} > 0 THEN {r.over}::DOUBLE / {r.under} ELSE 0 END AS ratio FROM figures"
        for r in q.RULES)
    risk = q.ALPHA / len(q.RULES)
    return f"""{quality_figures(source)},
rules AS ({rules}),
ratios AS ({ratios}),
truth AS (SELECT doc_id, min(quality) >= 1 AS clean FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, rule, ratio, clean FROM ratios JOIN truth USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT stratum, rule, cutoff, count(*) FILTER (clean) AS n, count(*) FILTER (clean AND ratio >= cutoff) AS k,
          count(*) FILTER (NOT clean) AS n_bad, count(*) FILTER (NOT clean AND ratio >= cutoff) AS caught
          FROM held JOIN rules USING (rule) GROUP BY ALL),
terms AS (SELECT *, unnest(range(0, CASE WHEN k <= n * {risk} THEN k + 1 ELSE 0 END)) AS i FROM tests),
tails AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) AS p
          FROM terms GROUP BY ALL),
gains AS (SELECT *, caught::DOUBLE / greatest(n_bad, 1) - {q.LOSS} * k / greatest(n, 1) AS gain FROM tests JOIN tails USING (stratum, rule, cutoff)
          WHERE p <= {q.DELTA} / (SELECT count(*) FROM tests)),
chosen AS (SELECT stratum, rule, arg_max(cutoff, {{'g': gain, 'c': cutoff}}) AS cut FROM gains WHERE gain > 0 GROUP BY ALL),
broken AS (SELECT DISTINCT doc_id FROM ratios JOIN chosen USING (stratum, rule) WHERE ratio >= cut),
verdicts AS (SELECT f.*, NOT base_failed AND b.doc_id IS NULL AS kept FROM figures f LEFT JOIN broken b ON b.doc_id = f.doc_id)"""


def quality() -> str:
    return f"""WITH {quality_verdicts()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts"""


def line_dedup() -> str:
    return f"""WITH lines AS (
  SELECT doc_id, i AS line_no, list_distinct(list_filter(regexp_split_to_array(line, '{SPLIT}'), lambda w: w <> '')) AS ws FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
sets AS (SELECT *, len(ws) AS n FROM lines WHERE len(ws) > 0),
tokens AS (SELECT doc_id, line_no, n, unnest(ws) AS w FROM sets),
frequency AS (SELECT w, count(*) AS df FROM tokens GROUP BY w),
ranked AS (SELECT doc_id, line_no, n, w, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY df, w) AS r FROM tokens JOIN frequency USING (w)),
prefixes AS (SELECT doc_id, line_no, n, w FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.doc_id, a.line_no, b.doc_id AS b_doc, b.line_no AS b_line FROM prefixes a JOIN prefixes b ON a.w = b.w
          AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.line_no < a.line_no) AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
gone AS (SELECT DISTINCT p.doc_id, p.line_no FROM pairs p JOIN sets a ON a.doc_id = p.doc_id AND a.line_no = p.line_no
         JOIN sets b ON b.doc_id = b_doc AND b.line_no = b_line WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
grouped AS (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.removed, '') AS removed
FROM documents d LEFT JOIN grouped g ON g.doc_id = d.doc_id"""
