"""The composed collection job: from a folder of conversation stores to sessions, coverage and ledger.

    files -> registry rows -> raw lines -> turns -> sessions -> their projects -> since -> ledger -> written sessions and coverage

Every file is read once, into a staged table with a partition for each normaliser and rule, so that each of them reads its own lines only.
Turns are normalised once into another, and sessions, times and messages come from its columns. The counters of what is
emitted are observed in the pass that writes it; the coverage per project is an aggregate of the session table, one row
a session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from decisionlake.functions import text as tx
from decisionlake.operators import attribution as at
from decisionlake.operators import coverage as cv
from decisionlake.operators import incremental as inc
from decisionlake.session import cut, staging_path
from decisionlake.sources import normalize as nz
from decisionlake.sources import registry as reg
from decisionlake.sources import transcripts as tr

SESSION = ["agent", "unit_id"]
EMITTED = ["project", *SESSION]
NORMALISERS = {"turns": nz.norm_turns, "seeded": nz.norm_seeded, "markdown": nz.norm_markdown_chat, "document": nz.norm_document,
               "message_dir": nz.norm_message_dir, "history": nz.norm_history}


def normalise(raw: DataFrame, stores: list[reg.Store], max_chars: int = nz.MAX_CHARS) -> DataFrame:
    """Turns of all layouts that the registry names, in one table: (agent, unit_id, positions, role, text, ts, skipped, doc_first, doc_last)."""
    wanted = dict.fromkeys(s.normaliser for s in stores if s.kind == reg.SESSION)
    parts = [NORMALISERS[n](raw.where(F.col("normaliser") == n), max_chars) for n in wanted]
    for c in ("doc_first", "doc_last"):
        parts = [p if c in p.columns else p.withColumn(c, F.lit(None).cast("timestamp")) for p in parts]
    return nz.union_agents(*parts)


def name_maps(spark: SparkSession, home: str) -> DataFrame:
    """(agent, name, path) of the ``projects.json`` maps that some stores keep beside their sessions."""
    maps = {a: p for a in ("gemini", "qwen") for p in reg.roots(spark, home, [reg.Store(a, f".{a}/projects.json", "")])}      # fixed values: the stores with a map
    if not maps:
        return spark.createDataFrame([], "agent string, name string, path string")
    docs = spark.read.text(list(maps.values()), wholetext=True)
    agent = F.regexp_extract(reg.decoded(F.col("_metadata.file_path")), r"/\.([^/]+)/projects\.json$", 1)
    rows = docs.select(agent.alias("agent"), F.explode(F.from_json(F.get_json_object("value", "$.projects"), "map<string,string>")).alias("path", "name"))
    return rows.select("agent", "name", "path")


def attribute(raw: DataFrame, files: DataFrame, projects: DataFrame, names: DataFrame, include_subdirs: bool = False) -> DataFrame:
    """(project, agent, unit_id), each session by the rule of its store."""
    of = lambda df, *rules: df.where(F.col("rule").isin(*rules))
    units = files.where(F.col("kind") == reg.SESSION).select(*SESSION, "dir", "rule").distinct()
    probed = at.probe_cwd(of(raw, "cwd", "cwd_or_mention"))
    first = of(raw, "message_cwd").withColumn("cwd", F.get_json_object("line", "$.path.cwd")).where("cwd <> ''")
    said = first.groupBy(*SESSION).agg(F.min_by("cwd", "src").alias("cwd"))
    hashes = at.header_hashes(of(raw, "named"))
    named = of(units, "named").join(hashes, SESSION, "left")
    found = [at.attribute_encoded(of(units, "encoded"), projects, include_subdirs),
             at.attribute_encoded(of(units, "bare_encoded"), projects, include_subdirs, strip_leading=True),
             at.attribute_cwd(probed, projects, include_subdirs), at.attribute_cwd(said, projects, include_subdirs),
             at.attribute_mention(of(raw, "mention", "cwd_or_mention"), projects),
             at.attribute_cwd(of(units, "location").withColumn("cwd", F.col("dir")), projects, include_subdirs),
             at.attribute_named(named, projects, names, include_subdirs)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*EMITTED).distinct()


@dataclass(frozen=True)
class Collected:
    """Where a run's results lie: ``totals`` by agent were counted while the sessions were written."""
    coverage: DataFrame
    gaps: DataFrame
    sessions: DataFrame
    messages_path: str
    totals: dict[str, dict[str, int]]


def collect(spark: SparkSession, home: str, projects: DataFrame, out: str, ledger: str, run: str, processed_at: int, stores: list[reg.Store] = reg.STORES,
            since: str | None = None, include_subdirs: bool = False, reprocess: bool = False, max_chars: int = nz.MAX_CHARS, names: DataFrame | None = None,
            logs: tuple[str, ...] = ()) -> Collected:
    """One run over all stores below ``home``, the chat logs ``logs`` inside projects (without the leading point, which hides a file from Spark) and all ``projects`` (project).

    ``ledger`` names the folder of the ledger, ``run`` this run: a run that is repeated under its name leaves the ledger as it is.
    """
    projects = projects.select(tx.cut_slashes(F.col("project")).alias("project")).distinct()
    folders = reg.roots(spark, home, stores, logs)
    files = cut(reg.list_files(spark, folders, stores))
    staged = staging_path(spark, "raw")
    # a scan task holds few small files of every kind; gathered by kind first, so that the number of staged files follows the bytes
    tr.read_stores(spark, folders, files, stores).hint("rebalance", "normaliser", "rule").write.partitionBy("normaliser", "rule").parquet(staged)
    raw = spark.read.parquet(staged)
    turns = cut(normalise(raw, stores, max_chars))
    owners = attribute(raw, files, projects, name_maps(spark, home) if names is None else names, include_subdirs)
    src = files.where(F.col("kind") == reg.SESSION).groupBy(*SESSION).agg(F.min("src").alias("src"))
    found = cv.session_summary(turns).where("kept > 0").join(src, SESSION).join(owners, SESSION)
    recent = cut(found if since is None else at.since_filter(found, since))
    known = inc.read_ledger(spark, ledger)
    delta = inc.incremental_delta(recent, known, reprocess, EMITTED)

    counts, per_agent = Observation(), list(dict.fromkeys(s.agent for s in stores))
    metrics = [metric.alias(f"{a}/{name}") for a in per_agent for name, metric in (
        ("sessions", F.count_if(F.col("agent") == a)), ("messages", F.coalesce(F.sum(F.when(F.col("agent") == a, F.col("kept"))), F.lit(0))),
        ("skipped_lines", F.coalesce(F.sum(F.when(F.col("agent") == a, F.col("skipped"))), F.lit(0))))]
    delta.observe(counts, *metrics).write.parquet(f"{out}/sessions")
    sessions = spark.read.schema(delta.schema).parquet(f"{out}/sessions")
    tr.write_sessions(nz.messages(turns).join(sessions.select(*SESSION).distinct(), SESSION, "left_semi"), f"{out}/messages")
    inc.publish_ledger(sessions.withColumn("processed_at", F.lit(processed_at)), ledger, run, keys=EMITTED)

    totals: dict[str, dict[str, int]] = {a: {} for a in per_agent}
    for name, value in counts.get.items():
        agent, what = name.rsplit("/", 1)
        totals[agent][what] = value
    known_agents = F.explode(F.array(*[F.struct(F.lit(r["agent"]).alias("agent"), F.lit(r["match_mode"]).alias("match_mode"))
                                       for r in reg.agents(spark, stores).collect()])).alias("a")
    every = projects.select("project", known_agents).select("project", "a.*")
    coverage = cv.coverage(sessions, every, inc.skipped_sessions(recent, sessions, EMITTED), by=["project"])
    by_cwd = F.col("rule").isin("cwd", "cwd_or_mention")
    gaps = files.where(by_cwd | (F.col("kind") != reg.SESSION)).join(at.probe_cwd(raw.where(by_cwd)), SESSION, "left")
    return Collected(coverage, cv.coverage_gaps(gaps), sessions, f"{out}/messages", totals)
