"""Registered queries: evaluation runs, scoring, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.operators import evals as ev
from decisionlake.operators import resolve as rs
from decisionlake.operators import scoring as sc
from decisionlake.plans import q_retrieval as qr
from decisionlake.plans import q_transcripts as qt
from decisionlake.plans.q_library import _Q, SHOWN, records
from decisionlake.plans.registry import query
from decisionlake.plans.twins import BLOCKS, over_queries, twin
from decisionlake.session import cut
from decisionlake.sources.fixtures import projection as P


def results(spark, d):
    return P(spark, d, "f_eval")


def runs(spark, d):
    return P(spark, d, "f_eval_runs")


BLOCKS["o_pass"] = """
SELECT run_id, SUM(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS passed, SUM(CASE WHEN status IN ('pass', 'fail') THEN 1 ELSE 0 END) AS done,
       SUM(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS failed FROM f_eval GROUP BY 1
"""
KIND = """CASE WHEN lower(provenance) LIKE '%read-verified%' OR lower(provenance) LIKE '%manual%' THEN 'read-verified' WHEN judge IS NOT NULL THEN 'llm-judged'
     WHEN checks > 0 THEN 'auto-scored' ELSE 'self-asserted' END"""


@query("pass_rate", twin("SELECT run_id, CAST(passed AS BIGINT) AS passed, CAST(done AS BIGINT) AS done, CAST(failed AS BIGINT) AS failed, round(100.0 * passed / done, 6) AS rate FROM o_pass"))
def pass_rate(spark, d):
    return ev.pass_rate(results(spark, d)).withColumn("rate", F.round("rate", 6))


@query("provenance_mix", twin(f"SELECT run_id, {KIND} AS kind, COUNT(*) AS n FROM f_eval WHERE status IN ('pass', 'fail') GROUP BY 1, 2"))
def provenance_mix(spark, d):
    return ev.provenance_mix(results(spark, d))


@query("antipattern_coverage", twin("SELECT run_id, anti_pattern, COUNT(CASE WHEN status = 'pass' THEN 1 END) AS passed, COUNT(*) AS n FROM f_eval WHERE anti_pattern IS NOT NULL GROUP BY 1, 2"))
def antipattern_coverage(spark, d):
    return ev.antipattern_coverage(results(spark, d))


@query("result_matrix", twin("SELECT scenario, " + ", ".join(f"MAX(CASE WHEN run_id = {r} THEN status END) AS run_{r}" for r in range(6)) + " FROM f_eval GROUP BY 1"))
def result_matrix(spark, d):
    return ev.result_matrix(results(spark, d), list(range(6)))


@query("drift_curve", twin("""
SELECT run_id, drift_size, COUNT(CASE WHEN status = 'pass' THEN 1 END) AS passed, COUNT(*) AS n, round(100.0 * COUNT(CASE WHEN status = 'pass' THEN 1 END) / COUNT(*), 3) AS rate
FROM f_eval WHERE drift_size IS NOT NULL AND run_id <> 5 GROUP BY 1, 2
"""))
def drift_curve(spark, d):
    return ev.drift_curve(results(spark, d), runs(spark, d))


BLOCKS["o_base_model"] = """
SELECT run_id, model AS name, base FROM (SELECT r.run_id, r.model, p.model AS base, ROW_NUMBER() OVER (PARTITION BY r.run_id ORDER BY length(p.model) DESC) AS rn
  FROM f_eval_runs r JOIN f_prices p ON r.model = p.model OR starts_with(r.model, p.model || '-')) x WHERE rn = 1
"""


@query("price_lookup", twin("SELECT run_id, base FROM o_base_model"))
def price_lookup(spark, d):
    return ev.price_lookup(runs(spark, d), P(spark, d, "f_prices"))


@query("price_lookup_dated", twin("""
SELECT e.k AS run_id, p.model AS base FROM (SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet-20250101' WHEN 2 THEN 'haiku-x' ELSE 'opus-2025' END AS model FROM {events}) e
JOIN f_prices p ON p.model = e.model OR p.model = regexp_replace(e.model, '-20[0-9]{6}$', '')
"""))
def price_lookup_dated(spark, d):
    k = F.col("event_id") % 4
    r = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("run_id"), F.when(k == 0, "opus").when(k == 1, "sonnet-20250101").when(k == 2, "haiku-x").otherwise("opus-2025").alias("model"))
    return ev.price_lookup(r, P(spark, d, "f_prices"), dated=True)


BLOCKS["o_cost"] = """
SELECT run_id, model, model_tier, condition, scenario_set, total, cost_index, passed, done, failed, rate, cost_index * 1.0 / passed AS index_per_pass, rate < 80.0 AS gated, usd, estimated, usd / passed AS usd_pp
FROM (SELECT r.*, t.tin + t.tout AS total, CASE WHEN r.has_split THEN t.tin + 5 * t.tout ELSE t.tin + t.tout END AS cost_index, p.passed, p.done, p.failed, 100.0 * p.passed / p.done AS rate,
        COALESCE(CASE WHEN r.has_split THEN t.tin / 1e6 * q.price_in + t.tout / 1e6 * q.price_out END, (t.tin + t.tout) / 1e6 * COALESCE(z.blended, q.blended)) AS usd,
        (CASE WHEN r.has_split THEN q.price_in END) IS NULL AS estimated
  FROM f_eval_runs r JOIN (SELECT run_id, SUM(tok_in) AS tin, SUM(tok_out) AS tout FROM f_eval GROUP BY 1) t ON t.run_id = r.run_id JOIN o_pass p ON p.run_id = r.run_id
  LEFT JOIN o_base_model b ON b.run_id = r.run_id LEFT JOIN f_prices q ON q.model = b.base LEFT JOIN f_prices z ON z.model = r.model_tier) x
"""


@query("run_cost", twin("""
SELECT run_id, model, model_tier, condition, scenario_set, CAST(total AS BIGINT) AS total, CAST(cost_index AS BIGINT) AS cost_index, CAST(passed AS BIGINT) AS passed, CAST(done AS BIGINT) AS done, CAST(failed AS BIGINT) AS failed,
       round(rate, 6) AS rate, round(index_per_pass, 6) AS index_per_pass, gated, round(usd, 9) AS usd, estimated, round(usd_pp, 9) AS usd_pp, CASE WHEN NOT gated THEN round(usd_pp, 9) END AS usd_per_pass FROM o_cost
"""))
def run_cost(spark, d):
    c = ev.run_cost(results(spark, d), runs(spark, d), P(spark, d, "f_prices"))
    for name, digits in (("rate", 6), ("index_per_pass", 6), ("usd", 9), ("usd_pp", 9), ("usd_per_pass", 9)):
        c = c.withColumn(name, F.round(F.col(name).cast("double"), digits))
    return c


_RANK = "CASE model_tier WHEN 'opus' THEN 3 WHEN 'sonnet' THEN 2 WHEN 'haiku' THEN 1 ELSE {} END"


@query("value_lenses", twin(f"""
SELECT s.scenario_set, round(s.top, 6) AS top, v.cheap_run, v.dear_run, round(v.saving, 6) AS saving, b.run_id AS baseline_run, t.run_id AS transfer_run, round(t.mult, 6) AS transfer_mult
FROM (SELECT scenario_set, MAX(rate) AS top FROM o_cost GROUP BY 1 HAVING COUNT(*) >= 2) s
LEFT JOIN (SELECT c.scenario_set, arg_min(c.run_id, c.usd_pp) AS cheap_run, arg_max(c.run_id, c.usd_pp) AS dear_run, MAX(c.usd_pp) / MIN(c.usd_pp) AS saving FROM o_cost c
           JOIN (SELECT scenario_set, MAX(rate) AS top FROM o_cost GROUP BY 1) m ON m.scenario_set = c.scenario_set AND m.top = c.rate WHERE c.usd_pp IS NOT NULL AND NOT c.gated GROUP BY 1 HAVING COUNT(*) >= 2) v ON v.scenario_set = s.scenario_set
LEFT JOIN (SELECT * FROM (SELECT *, {_RANK.format(0)} AS rk, ROW_NUMBER() OVER (PARTITION BY scenario_set ORDER BY {_RANK.format(0)} DESC, rate DESC, run_id) AS rn FROM o_cost WHERE condition = 'baseline') x WHERE rn = 1) b ON b.scenario_set = s.scenario_set
LEFT JOIN (SELECT * FROM (SELECT c.run_id, c.scenario_set, y.usd_pp / c.usd_pp AS mult, ROW_NUMBER() OVER (PARTITION BY c.scenario_set ORDER BY y.usd_pp / c.usd_pp DESC, c.run_id) AS rn FROM o_cost c
    JOIN (SELECT * FROM (SELECT *, {_RANK.format(0)} AS rk, ROW_NUMBER() OVER (PARTITION BY scenario_set ORDER BY {_RANK.format(0)} DESC, rate DESC, run_id) AS rn FROM o_cost WHERE condition = 'baseline') x WHERE rn = 1) y ON y.scenario_set = c.scenario_set
    WHERE {_RANK.format(9).replace("model_tier", "c.model_tier")} < y.rk AND c.rate >= y.rate AND NOT c.gated AND c.usd_pp IS NOT NULL AND y.usd_pp > 0) z WHERE rn = 1) t ON t.scenario_set = s.scenario_set
"""))
def value_lenses(spark, d):
    c = cut(ev.run_cost(results(spark, d), runs(spark, d), P(spark, d, "f_prices")).withColumn("usd_pp", F.col("usd_pp").cast("double")))
    out = ev.value_lenses(c)
    for name in ("top", "saving", "transfer_mult"):
        out = out.withColumn(name, F.round(F.col(name).cast("double"), 6))
    return out


BLOCKS["o_disc"] = "SELECT scenario, COUNT(*) AS runs, MIN(status) <> MAX(status) AS separates FROM f_eval WHERE status IN ('pass', 'fail') GROUP BY 1 HAVING COUNT(*) >= 2"


@query("discriminating", twin("SELECT scenario, runs, separates FROM o_disc"))
def discriminating(spark, d):
    return ev.discriminating(results(spark, d))


@query("calibration_verdict", twin(f"""
SELECT CASE WHEN b < 2 OR co = 0 THEN CASE WHEN weak OR fails = 0 THEN 'NO' ELSE 'UNKNOWN' END WHEN sep * 1.0 / co < 0.25 THEN 'NO' ELSE 'YES' END AS status,
       concat_ws('; ', CASE WHEN b < 2 THEN 'too few judged runs' WHEN co = 0 THEN 'disjoint scenario sets' WHEN sep = 0 THEN 'nothing discriminates' WHEN sep * 1.0 / co < 0.25 THEN 'too little discriminates' ELSE 'enough discriminates' END,
                 CASE WHEN weak THEN 'mostly unverified' END, CASE WHEN fails = 0 THEN 'never failed' END) AS reasons, sep AS separating, co AS co_tested, verified, done
FROM (SELECT *, verified * 1.0 / done < 0.5 AS weak FROM (SELECT (SELECT COUNT(*) FROM f_eval_runs WHERE tier = 'B') AS b, (SELECT COUNT(*) FROM o_disc) AS co, (SELECT COUNT(*) FROM o_disc WHERE separates) AS sep,
        COUNT(CASE WHEN status = 'fail' THEN 1 END) AS fails, COUNT(CASE WHEN status IN ('pass', 'fail') THEN 1 END) AS done,
        COUNT(CASE WHEN status IN ('pass', 'fail') AND {KIND} IN ('auto-scored', 'llm-judged') THEN 1 END) AS verified FROM f_eval) x) y
"""))
def calibration_verdict(spark, d):
    return ev.calibration_verdict(results(spark, d), runs(spark, d))


# --- answers against gold --------------------------------------------------------------------
BLOCKS["o_scored"] = """
SELECT a.arm, a.tier, a.sample, a.probe_id, a.current_value <> '' AND (contains(lower(a.current_value), lower(g.current_value)) OR contains(lower(g.current_value), lower(a.current_value))) AS cur_ok,
       a.replaced_value <> '' AND contains(lower(a.replaced_value), lower(COALESCE(g.replaced_value, ''))) AS rep_ok
FROM f_answers a JOIN f_gold g ON g.probe_id = a.probe_id
"""
BLOCKS["o_major"] = """
SELECT v.arm, v.tier, s.samples, round(SUM(CASE WHEN v.votes * 2 > s.samples THEN 1 ELSE 0 END) * 1.0 / (SELECT COUNT(*) FROM f_gold), 3) AS majority
FROM (SELECT arm, tier, probe_id, SUM(CASE WHEN cur_ok THEN 1 ELSE 0 END) AS votes FROM o_scored GROUP BY 1, 2, 3) v
JOIN (SELECT arm, tier, COUNT(DISTINCT sample) AS samples FROM f_answers GROUP BY 1, 2) s ON s.arm = v.arm AND s.tier = v.tier GROUP BY 1, 2, 3
"""


@query("majority_vote", twin("SELECT arm, tier, samples, majority FROM o_major"))
def majority_vote(spark, d):
    return sc.majority_vote(P(spark, d, "f_answers"), P(spark, d, "f_gold"))


@query("recall_stats", twin("""
SELECT arm, tier, COUNT(*) AS samples, round(AVG(cur) * 1.0 / n, 3) AS recall_mean, round(AVG(rep) * 1.0 / n, 3) AS replaced_mean, round(stddev_pop(cur * 1.0 / n), 3) AS recall_stdev
FROM (SELECT arm, tier, sample, CAST(SUM(CASE WHEN cur_ok THEN 1 ELSE 0 END) AS DOUBLE) AS cur, CAST(SUM(CASE WHEN rep_ok THEN 1 ELSE 0 END) AS DOUBLE) AS rep, CAST((SELECT COUNT(*) FROM f_gold) AS DOUBLE) AS n FROM o_scored GROUP BY 1, 2, 3) x GROUP BY arm, tier, n
"""))
def recall_stats(spark, d):
    return sc.recall_stats(P(spark, d, "f_answers"), P(spark, d, "f_gold"))


@query("separation", twin("""
SELECT tier, round(MAX(CASE WHEN arm = 'resolve' THEN majority END) - greatest(MAX(CASE WHEN arm = 'flat' THEN majority END), MAX(CASE WHEN arm = 'retrieval' THEN majority END)), 3) AS separation FROM o_major GROUP BY 1
"""))
def separation(spark, d):
    m = sc.majority_vote(P(spark, d, "f_answers"), P(spark, d, "f_gold"))
    return sc.separation(m.select("arm", "tier", F.col("majority").alias("recall")))


@query("per_probe_diff", twin("""
SELECT a.arm, a.tier, COUNT(CASE WHEN a.cur_ok AND NOT b.cur_ok THEN 1 END) AS regressions, COUNT(CASE WHEN NOT a.cur_ok AND b.cur_ok THEN 1 END) AS recoveries,
       COUNT(CASE WHEN NOT a.cur_ok AND b.cur_ok THEN 1 END) - COUNT(CASE WHEN a.cur_ok AND NOT b.cur_ok THEN 1 END) AS net
FROM o_scored a JOIN o_scored b ON a.arm = b.arm AND a.tier = b.tier AND a.probe_id = b.probe_id AND a.sample = 0 AND b.sample = 1 GROUP BY 1, 2
"""))
def per_probe_diff(spark, d):
    s = sc.scored(P(spark, d, "f_answers"), P(spark, d, "f_gold")).select("arm", "tier", "sample", "probe_id", F.col("cur_ok").alias("correct"))
    return sc.per_probe_diff(s.where("sample = 0").drop("sample"), s.where("sample = 1").drop("sample"))


def replies(spark, d):
    """One reply per answer, fenced or bare, some with a repeated id, some cut off."""
    a = P(spark, d, "f_answers")
    one = F.to_json(F.struct(F.col("probe_id").cast("string").alias("id"), F.col("current_value").alias("current"), F.col("replaced_value").alias("replaced")))
    first = F.to_json(F.struct(F.col("probe_id").cast("string").alias("id"), F.lit("nothing").alias("current"), F.lit("nothing").alias("replaced")))
    arr = F.when(F.col("h") % 5 == 0, F.concat(F.lit("["), first, F.lit(", "), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    text = (F.when(F.col("h") % 23 == 0, F.concat(F.lit("```json\n"), F.substring(arr, 1, 12), F.lit("\n```")))
            .when(F.col("h") % 2 == 0, F.concat(F.lit("Sure.\n```json\n"), arr, F.lit("\n```\nbye")))
            .otherwise(F.concat(F.lit("Answer: "), arr, F.lit(" done"))))
    return a.select("arm", "tier", "sample", F.col("h").alias("reply_id"), text.alias("text"))


@query("score_answers", twin("""
SELECT s.arm, s.tier, s.sample, COUNT(*) AS parsed, COUNT(CASE WHEN s.cur_ok THEN 1 END) AS current, COUNT(CASE WHEN s.rep_ok THEN 1 END) AS replaced
FROM o_scored s JOIN f_answers a ON a.arm = s.arm AND a.tier = s.tier AND a.sample = s.sample AND a.probe_id = s.probe_id AND a.h % 23 <> 0 GROUP BY 1, 2, 3
"""))
def score_answers(spark, d):
    return sc.score_answers(replies(spark, d), P(spark, d, "f_gold"))


_VERDICT = """
SELECT c_custkey AS reply_id, CASE WHEN c_custkey % 2 = 0 THEN 'superseded' ELSE 'recorded' END AS scenario_kind, c_custkey % 50 AS needle,
       CASE WHEN c_custkey % 11 = 0 THEN 'I think ADR ' || CAST(c_custkey AS STRING) || ' was superseded.'
       ELSE CASE WHEN c_custkey % 3 = 0 THEN 'Done.' || chr(10) || '```verdict' || chr(10) ELSE 'see ' END
         || CASE WHEN c_custkey % 2 = 0 THEN '{"superseded_adr":"ADR 00' || CAST(CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_custkey % 50 END AS STRING) || '","created_superseding_adr":' || CASE WHEN c_custkey % 13 = 0 THEN '"true"' ELSE 'true' END
              || ',"near_miss_untouched":' || CASE WHEN c_custkey % 17 = 0 THEN 'false' ELSE 'true' END || ',"current_store":"' || CASE WHEN c_custkey % 19 = 0 THEN 'postgres' WHEN c_custkey % 4 = 0 THEN 'DuckDB' ELSE 'a columnar file' END || '"}'
            ELSE '{"already_recorded_adr":"ADR ' || CAST(CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_custkey % 50 END AS STRING) || '","created_new_adr":' || CASE WHEN c_custkey % 13 = 0 THEN '"false"' ELSE 'false' END || '}' END
         || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '```' ELSE ' end' END END AS text
FROM {customer}
"""


@query("score_verdict", twin("""
SELECT k AS reply_id, CASE WHEN s THEN 'superseded' ELSE 'recorded' END AS scenario_kind, CASE WHEN none THEN 'unscorable' WHEN r AND m AND n AND t THEN 'pass' ELSE 'fail' END AS outcome,
       CASE WHEN NOT none THEN r END AS right_record, CASE WHEN NOT none THEN m END AS creation, CASE WHEN NOT none THEN n END AS near_miss, CASE WHEN NOT none THEN t END AS state
FROM (SELECT c_custkey AS k, c_custkey % 2 = 0 AS s, c_custkey % 11 = 0 AS none, c_custkey % 7 <> 0 AS r, c_custkey % 13 <> 0 AS m, c_custkey % 2 = 1 OR c_custkey % 17 <> 0 AS n, c_custkey % 2 = 1 OR c_custkey % 19 <> 0 AS t FROM {customer}) x
"""))
def score_verdict(spark, d):
    return sc.score_verdict(spark.sql(_VERDICT.replace("{customer}", f"parquet.`{d}/customer.parquet`")))


_PROBES = "SELECT lib, probe_id AS query_id, 'entity ' || CAST(entity AS VARCHAR) || ' ' || dimension AS text FROM f_gold"
BLOCKS["o_live_titles"] = """
SELECT l.query_id AS probe_id, r.title FROM o_literal l JOIN f_records r ON r.lib = l.lib AND r.rec_id = l.endpoint
"""
BLOCKS["o_chain_vals"] = """
SELECT g.probe_id, n.value, n.value = g.current_value AS is_current FROM f_gold g JOIN f_numbered n ON n.entity = g.entity AND n.dimension = g.dimension
"""
BLOCKS["o_resolution"] = """
SELECT g.probe_id, COALESCE(n.n, 0) AS n_live, COALESCE(n.n, 0) > 1 AS conflict, COALESCE(n.n = 1 AND f.cur AND NOT f.old, false) AS correct,
       COALESCE(f.cur, false) AS want_in, COALESCE(f.old, false) AS old_in, f.probe_id IS NOT NULL AS any_in
FROM f_gold g LEFT JOIN (SELECT probe_id, COUNT(*) AS n FROM o_live_titles GROUP BY 1) n ON n.probe_id = g.probe_id
LEFT JOIN (SELECT c.probe_id, bool_or(c.is_current) AS cur, bool_or(NOT c.is_current) AS old FROM o_chain_vals c JOIN o_live_titles t ON t.probe_id = c.probe_id AND contains(t.title, c.value) GROUP BY 1) f ON f.probe_id = g.probe_id
"""
_MISS = "CASE WHEN n_live = 0 THEN 'no-result' WHEN old_in THEN 'wrong-value' WHEN NOT any_in THEN 'invented' WHEN NOT want_in THEN 'omitted' ELSE 'wrong-value' END"


def _resolution(spark, d):
    gold = cut(P(spark, d, "f_gold"))
    q = gold.select("lib", F.col("probe_id").alias("query_id"), F.concat(F.lit("entity "), F.col("entity").cast("string"), F.lit(" "), F.col("dimension")).alias("text"))
    lib = rs.Library.of(records(spark, d))
    res = rs.resolve(lib, q, use_aliases=False)
    live = res.endpoints.join(lib.records.select("lib", F.col("rec_id").alias("endpoint"), "title"), ["lib", "endpoint"]).select(F.col("query_id").alias("probe_id"), "title")
    chains = P(spark, d, "f_numbered").select("entity", "dimension", "value").join(gold, ["entity", "dimension"]).select(
        "probe_id", "value", (F.col("value") == F.col("current_value")).alias("is_current"))
    return sc.score_resolution(live, gold, chains)


@query("score_resolution", over_queries(_PROBES, "SELECT probe_id, n_live, conflict, correct, want_in, old_in, any_in FROM o_resolution"))
def score_resolution(spark, d):
    return _resolution(spark, d)


@query("classify_miss", over_queries(_PROBES, f"SELECT probe_id, {_MISS} AS miss FROM o_resolution WHERE NOT correct"))
def classify_miss(spark, d):
    return sc.classify_miss(_resolution(spark, d))


@query("miss_taxonomy", over_queries(_PROBES, f"SELECT {_MISS} AS miss, COUNT(*) AS n FROM o_resolution WHERE NOT correct GROUP BY 1"))
def miss_taxonomy(spark, d):
    return sc.miss_taxonomy(sc.classify_miss(_resolution(spark, d)))


@query("endpoints", over_queries(_Q, "SELECT DISTINCT lib, query_id, endpoint FROM o_ends"))
def endpoints(spark, d):
    lib = rs.Library.of(records(spark, d))
    return rs.resolve(lib, P(spark, d, "f_queries")).endpoints.select("lib", "query_id", "endpoint").distinct()


@query("token_reduction", over_queries(_Q, """
SELECT w.lib, w.library_tokens, w.records, p.resolve_tokens, round(100 * (w.library_tokens - p.resolve_tokens) / w.library_tokens, 3) AS reduction_pct
FROM (SELECT lib, CAST(SUM(greatest(floor(length(body) / 4), 1)) AS BIGINT) AS library_tokens, COUNT(*) AS records FROM f_records GROUP BY 1) w
JOIN (SELECT lib, round(AVG(t), 3) AS resolve_tokens FROM (SELECT s.lib, s.query_id, SUM(greatest(floor(length(s.note || '|' || COALESCE(e.endpoint, '') || '|' || COALESCE(r.title, '')) / 4), 1)) AS t
  FROM o_summary s LEFT JOIN o_ends e ON e.lib = s.lib AND e.query_id = s.query_id LEFT JOIN f_records r ON r.lib = e.lib AND r.rec_id = e.endpoint GROUP BY 1, 2) x GROUP BY 1) p ON p.lib = w.lib
"""))
def token_reduction(spark, d):
    lib = rs.Library.of(records(spark, d, SHOWN))
    rows = rs.resolve_query(lib, P(spark, d, "f_queries"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    out = rows.select("lib", "query_id", F.concat("note", F.lit("|"), empty("endpoint"), F.lit("|"), empty("title")).alias("text"))
    return sc.token_reduction(lib.records, out)


@query("fixture_audit", twin("""
SELECT CAST(v AS VARCHAR) AS variant, source AS name, CASE WHEN v % 2 = 1 AND source = 'src3' THEN 'missing' ELSE 'mismatch' END AS issue
FROM (SELECT DISTINCT d.source, r.r_regionkey AS v FROM {documents} d JOIN {region} r ON true) x WHERE (v % 2 = 1 AND source = 'src3') OR (v % 2 = 0 AND source = 'src7')
"""))
def fixture_audit(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    hashes = ev.content_hashes(docs, "source", "text")
    regions = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("string").alias("variant"))
    expected = hashes.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("variant", F.col("variant").cast("string")).join(regions, "variant", "left_semi")
    odd = F.col("variant").cast("int") % 2
    got = expected.where(~((odd == 1) & (F.col("name") == "src3"))).withColumn("hash", F.when((odd == 0) & (F.col("name") == "src7"), F.lit("x")).otherwise(F.col("hash")))
    return ev.fixture_audit(got, expected)


@query("expectation_checks", twin("""
SELECT 'coverage:' || p.agent AS name, c.sessions = p.sessions AS ok, 'got ' || CAST(CAST(c.sessions AS BIGINT) AS VARCHAR) AS detail FROM o_planted p JOIN o_cov c ON c.agent = p.agent
UNION ALL SELECT 'coverage:total', a.s = b.s, 'total=' || CAST(CAST(a.s AS BIGINT) AS VARCHAR) || ' expected=' || CAST(CAST(b.s AS BIGINT) AS VARCHAR) FROM (SELECT SUM(sessions) AS s FROM o_cov) a, (SELECT SUM(sessions) AS s FROM o_planted) b
UNION ALL SELECT 'misattributed:' || agent, false, CAST(CAST(sessions AS BIGINT) AS VARCHAR) || ' unexpected' FROM o_cov WHERE sessions > 0 AND agent NOT IN (SELECT agent FROM o_planted)
UNION ALL SELECT 'phrase:' || CAST(p.phrase_id AS VARCHAR), CASE WHEN p.rule = 'present' THEN COALESCE(h.n, 0) > 0 ELSE COALESCE(h.n, 0) = 0 END, p.rule || ' hits=' || CAST(COALESCE(h.n, 0) AS VARCHAR)
  FROM o_phr p LEFT JOIN (SELECT q.phrase_id, COUNT(*) AS n FROM o_phr q JOIN {documents} c ON CASE WHEN q.folded THEN contains(lower(c.text), lower(q.phrase)) ELSE contains(c.text, q.phrase) END GROUP BY 1) h ON h.phrase_id = p.phrase_id
UNION ALL SELECT 'unknown_store', COUNT(*) > 0, 'flagged ' || CAST(COUNT(*) AS VARCHAR) FROM (""" + qt._DIRS + """) x WHERE name LIKE '.windsurfx%' OR name LIKE 'amp-%' OR name LIKE '.Roo%' OR name LIKE 'goose%'
UNION ALL SELECT 'library:' || lib, COUNT(*) >= 3000, CAST(COUNT(*) AS VARCHAR) || ' records' FROM f_records GROUP BY lib
""") if BLOCKS.setdefault("o_planted", "SELECT agent, CASE WHEN agent = 'beta' THEN sessions + 1 ELSE sessions END AS sessions FROM o_cov WHERE agent IN ('alpha', 'beta')") else None)
def expectation_checks(spark, d):
    cov = cut(qt._cov(spark, d))
    planted = cov.where("agent in ('alpha', 'beta')").select("agent", F.when(F.col("agent") == "beta", F.col("sessions") + 1).otherwise(F.col("sessions")).alias("sessions"))
    sizes = records(spark, d).groupBy("lib").agg(F.count(F.lit(1)).alias("records")).withColumn("wanted", F.lit(3000))
    return ev.expectation_checks(cov, planted, qr.phrase_presence(spark, d), qt.unknown_stores(spark, d), sizes)
