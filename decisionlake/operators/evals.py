"""Evaluation runs: pass rates, provenance, cost, value, calibration.

results: (run_id, scenario, status, checks, judge, provenance, drift_size, anti_pattern, tok_in, tok_out);
runs: (run_id, tier, model, model_tier, condition, scenario_set, has_split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake import config


def _done() -> Column:
    return F.col("status").isin("pass", "fail")


def _pass() -> Column:
    return F.col("status") == "pass"


def pass_rate(results: DataFrame) -> DataFrame:
    out = results.groupBy("run_id").agg(F.count_if(_pass()).alias("passed"), F.count_if(_done()).alias("done"),
                                        F.count_if(F.col("status") == "fail").alias("failed"))
    return out.withColumn("rate", F.coalesce(F.try_divide(100.0 * F.col("passed"), F.col("done")), F.lit(0.0)))


def scoring_kind() -> Column:
    prov = F.lower(F.coalesce("provenance", F.lit("")))
    return (F.when(prov.contains("read-verified") | prov.contains("manual"), "read-verified")
            .when(F.coalesce("judge", F.lit("")) != "", "llm-judged")
            .when(F.coalesce(F.col("checks").try_cast("int"), F.lit(0)) > 0, "auto-scored").otherwise("self-asserted"))


def provenance_mix(results: DataFrame) -> DataFrame:
    return results.where(_done()).groupBy("run_id", scoring_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def antipattern_coverage(results: DataFrame) -> DataFrame:
    """Per run and anti-pattern: passed of all."""
    return results.where("anti_pattern is not null").groupBy("run_id", "anti_pattern").agg(
        F.count_if(_pass()).alias("passed"), F.count(F.lit(1)).alias("n"))


def result_matrix(results: DataFrame, run_ids: list) -> DataFrame:
    """Scenario by run: one status column per run."""
    return results.groupBy("scenario").agg(*[
        F.max(F.when(F.col("run_id") == r, F.col("status"))).alias(f"run_{r}") for r in run_ids])


def drift_curve(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Pass rate by library size per run; the substrate tier A is left out."""
    judged = runs.where("tier <> 'A'").select("run_id")
    return results.where("drift_size is not null").join(judged, "run_id", "left_semi").groupBy("run_id", "drift_size").agg(
        F.count_if(_pass()).alias("passed"), F.count(F.lit(1)).alias("n"),
        F.round(100.0 * F.count_if(_pass()) / F.count(F.lit(1)), 3).alias("rate"))


def price_lookup(runs: DataFrame, prices: DataFrame, dated: bool = False) -> DataFrame:
    """(run_id, model) -> base model of the price sheet: the longest name equal to the model or a
    dash-prefix of it. ``dated`` instead takes the exact name, then the name without a date suffix.

    Both are equi-joins on the candidate names of each run.
    """
    sheet = ["sheet"] if "sheet" in runs.columns and "sheet" in prices.columns else []
    names = prices.select(*sheet, F.col("model").alias("base")).distinct()
    if dated:
        cands = F.array_distinct(F.array(F.col("model"), F.regexp_replace("model", r"-20\d{6}$", "")))
    else:
        parts = F.split("model", "-")
        cands = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))
    hits = runs.select("run_id", *sheet, F.explode(cands).alias("base")).join(names, [*sheet, "base"])
    return hits.groupBy("run_id").agg(F.max_by("base", F.length("base")).alias("base"))


def run_cost(results: DataFrame, runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens, weighted index, USD (exact with an in/out split, else estimated from a blended rate) and
    cost per pass; ``usd_per_pass`` is withheld below the efficacy gate."""
    both = F.col("tok_in") + F.col("tok_out")
    one_total = F.coalesce("tok_total", both) if "tok_total" in results.columns else both
    tok = results.groupBy("run_id").agg(F.sum("tok_in").alias("tin"), F.sum("tok_out").alias("tout"), F.sum(one_total).alias("tsum"))
    base = price_lookup(runs, prices)
    sheet = ["sheet"] if "sheet" in runs.columns and "sheet" in prices.columns else []      # several price sheets: a run names its own
    rate = prices.select(*sheet, F.col("model").alias("base"), "price_in", "price_out", "blended")
    tier = prices.select(*sheet, F.col("model").alias("model_tier"), F.col("blended").alias("tier_blended"))
    r = (runs.join(tok, "run_id").join(pass_rate(results), "run_id").join(base, "run_id", "left")
         .join(rate, [*sheet, "base"], "left").join(tier, [*sheet, "model_tier"], "left"))
    total = F.col("tsum")
    exact = F.when(F.col("has_split"), F.col("tin") / 1e6 * F.col("price_in") + F.col("tout") / 1e6 * F.col("price_out"))
    usd = F.coalesce(exact, total / 1e6 * F.coalesce("tier_blended", "blended"))
    r = r.withColumn("total", total).withColumn(
        "cost_index", F.when(F.col("has_split"), F.col("tin") + config.OUTPUT_WEIGHT * F.col("tout")).otherwise(total))
    r = r.withColumn("usd", usd).withColumn("estimated", exact.isNull()).withColumn("gated", F.col("rate") < config.EFFICACY_GATE)
    r = r.withColumn("index_per_pass", F.try_divide("cost_index", "passed")).withColumn("usd_pp", F.try_divide("usd", "passed"))
    return r.select("run_id", "model", "model_tier", "condition", "scenario_set", "total", "cost_index", "passed", "done", "failed",
                    "rate", "index_per_pass", "gated", "usd", "estimated", "usd_pp",
                    F.when(~F.col("gated"), F.col("usd_pp")).alias("usd_per_pass"))


def _tier_rank(tier: Column, default: int) -> Column:
    out = F.lit(default)
    for name, rank in config.TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def value_lenses(costs: DataFrame) -> DataFrame:
    """Per scenario set with two runs or more: cheapest and dearest run at the top pass rate, and the best
    cheaper tier that matches the strongest baseline. Every pick is an aggregate, no set is collected."""
    s = "scenario_set"
    sets = costs.groupBy(s).agg(F.count(F.lit(1)).alias("runs"), F.max("rate").alias("top")).where("runs >= 2")
    iso = costs.join(sets.select(s, "top"), s).where("rate = top and usd_pp is not null and not gated")
    save = iso.groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.min_by("run_id", F.struct("usd_pp", "run_id")).alias("cheap_run"), F.min("usd_pp").alias("lo"),
                              F.min_by("run_id", F.struct(F.negate("usd_pp"), "run_id")).alias("dear_run"), F.max("usd_pp").alias("hi")).where("n >= 2 and hi > 0 and cheap_run <> dear_run")
    save = save.select(s, "cheap_run", "dear_run", F.try_divide("hi", "lo").alias("saving"))
    sota = costs.where("condition = 'baseline'").groupBy(s).agg(F.min_by(
        F.struct("run_id", "rate", "usd_pp", _tier_rank(F.col("model_tier"), 0).alias("rank")),
        F.struct(F.negate(_tier_rank(F.col("model_tier"), 0)), F.negate(F.coalesce("rate", F.lit(-1.0))), "run_id")).alias("b"))
    cand = costs.join(sota, s).where(_tier_rank(F.col("model_tier"), 9) < F.col("b.rank")).where(
        "rate >= b.rate and not gated and usd_pp is not null and coalesce(b.usd_pp, 0) <> 0")
    cand = cand.withColumn("mult", F.try_divide("b.usd_pp", "usd_pp"))
    best = cand.groupBy(s).agg(F.min_by("run_id", F.struct(F.negate(F.coalesce("mult", F.lit(0.0))), "run_id")).alias("transfer_run"),
                               F.max("mult").alias("transfer_mult"))
    return sets.join(save, s, "left").join(sota.select(s, F.col("b.run_id").alias("baseline_run")), s, "left").join(best, s, "left").select(
        s, "top", "cheap_run", "dear_run", "saving", "baseline_run", "transfer_run", "transfer_mult")


def discriminating(results: DataFrame) -> DataFrame:
    """Per scenario run by at least two runs: do their outcomes differ?"""
    return results.where(_done()).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("runs"), (F.min("status") != F.max("status")).alias("separates")).where("runs >= 2")


def calibration_verdict(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: YES / NO / UNKNOWN with the reasons in order."""
    one = F.lit(1).alias("one")
    disc = discriminating(results).agg(F.count(F.lit(1)).alias("co_tested"), F.count_if("separates").alias("separating")).withColumn("one", one)
    tiers = runs.agg(F.count_if(F.col("tier") == "B").alias("judged_runs")).withColumn("one", one)
    kinds = results.agg(F.count_if(_done()).alias("done"), F.count_if(_done() & scoring_kind().isin("auto-scored", "llm-judged")).alias("verified"),
                        F.count_if(F.col("status") == "fail").alias("fails")).withColumn("one", one)
    r = disc.join(tiers, "one").join(kinds, "one")
    ratio = F.try_divide("separating", "co_tested")
    few, disjoint = F.col("judged_runs") < 2, F.col("co_tested") == 0
    status = F.when(few | disjoint, "UNKNOWN").when(ratio < 0.25, "NO").otherwise("YES")
    weak = (F.col("done") > 0) & (F.col("verified") / F.greatest(F.col("done"), F.lit(1)) < 0.5)
    green = F.col("fails") == 0
    reasons = F.array_compact(F.array(
        F.when(few, "too few judged runs").when(disjoint, "disjoint scenario sets").when(F.col("separating") == 0, "nothing discriminates")
        .when(ratio < 0.25, "too little discriminates").otherwise("enough discriminates"),
        F.when(weak, "mostly unverified"), F.when(green, "never failed")))
    final = F.when((status == "UNKNOWN") & (weak | green), "NO").otherwise(status)
    return r.select(final.alias("status"), F.array_join(reasons, "; ").alias("reasons"), "separating", "co_tested", "verified", "done")


def content_hashes(docs: DataFrame, name: str, text: str) -> DataFrame:
    """(name, hash) of the documents under each name: count, sum and xor, so that no two changes cancel each other."""
    h = F.xxhash64(text)
    parts = [F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)]
    return docs.groupBy(F.col(name).alias("name")).agg(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256).alias("hash"))


def fixture_audit(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results and expected, both (variant, name, hash) -> (variant, name, issue): missing or mismatch."""
    got = results.select("variant", "name", F.col("hash").alias("got"))
    issue = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("hash"), "mismatch")
    return expected.join(got, ["variant", "name"], "left").select("variant", "name", issue.alias("issue")).where("issue is not null")


def expectation_checks(coverage: DataFrame, planted: DataFrame, phrases: DataFrame, unknown: DataFrame, health: DataFrame) -> DataFrame:
    """checks (name, ok, detail): exact session counts per agent and in total, nothing unexpected, planted
    phrases present or absent, unknown stores flagged, library size. planted: (agent, sessions);
    phrases: phrase_presence output; unknown: unknown_stores output; health: (lib, records, wanted)."""
    got = coverage.select("agent", F.col("sessions").alias("got"))
    per = planted.join(got, "agent", "left").select(
        F.concat(F.lit("coverage:"), "agent").alias("name"), (F.coalesce("got", F.lit(0)) == F.col("sessions")).alias("ok"),
        F.concat(F.lit("got "), F.coalesce("got", F.lit(0)).cast("string")).alias("detail"))
    total = coverage.agg(F.sum("sessions").alias("got")).withColumn("one", F.lit(1)).join(
        planted.agg(F.sum("sessions").alias("want")).withColumn("one", F.lit(1)), "one").select(
        F.lit("coverage:total").alias("name"), (F.col("got") == F.col("want")).alias("ok"),
        F.concat(F.lit("total="), F.col("got").cast("string"), F.lit(" expected="), F.col("want").cast("string")).alias("detail"))
    extra = coverage.where("sessions > 0").join(planted, "agent", "left_anti").select(
        F.concat(F.lit("misattributed:"), "agent").alias("name"), F.lit(False).alias("ok"), F.concat(F.col("sessions").cast("string"), F.lit(" unexpected")).alias("detail"))
    words = phrases.select(F.concat(F.lit("phrase:"), F.col("phrase_id").cast("string")).alias("name"), "ok", F.concat(F.col("rule"), F.lit(" hits="), F.col("hits").cast("string")).alias("detail"))
    stores = unknown.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_store").alias("name"), (F.col("n") > 0).alias("ok"), F.concat(F.lit("flagged "), F.col("n").cast("string")).alias("detail"))
    libs = health.select(F.concat(F.lit("library:"), "lib").alias("name"), (F.col("records") >= F.col("wanted")).alias("ok"),
                         F.concat(F.col("records").cast("string"), F.lit(" records")).alias("detail"))
    return per.unionByName(total).unionByName(extra).unionByName(words).unionByName(stores).unionByName(libs)
