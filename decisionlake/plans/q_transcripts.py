"""Registered queries: conversation layouts, attribution, coverage.

The raw stores are staged from ``conversations`` by Spark, one layout per query; the twins start from the
same table, so a query holds only if parsing gives back what went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.functions import text as tx
from decisionlake.operators import attribution as at
from decisionlake.operators import collect as co
from decisionlake.operators import coverage as cv
from decisionlake.operators import incremental as inc
from decisionlake.plans.registry import query
from decisionlake.plans.twins import BLOCKS, twin
from decisionlake.session import cut, staging_path
from decisionlake.sources import normalize as nz
from decisionlake.sources import registry as reg
from decisionlake.sources import transcripts as tr
from decisionlake.sources.fixtures import projection as P

MAX = 600
AGENTS = ["alpha", "beta", "gamma", "delta"]


def _obj(**fields):
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _nested(c):
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text")))


def lines(spark, d):
    """JSONL stores in four shapes, one per agent."""
    m = P(spark, d, "f_messages")
    ts = F.col("ts_s")
    iso = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    role = F.col("role")
    alpha = _obj(type=role, cwd=F.col("cwd"), timestamp=iso, message=F.struct(role, F.col("text").alias("content")))
    beta = _obj(type=F.lit("response_item"), payload=F.struct(
        F.lit("message").alias("type"), role, iso.alias("ts"),
        F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))).alias("content")))
    gamma = _obj(role=F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(role),
                 content=F.col("text"), created_at=ts * 1000, cwd=F.col("cwd"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("grep").alias("name"), F.struct(
        F.lit("a,b: \"c").alias("q"), F.col("pos").alias("n")).alias("input"))
    # tool results inside tool results, 3, 5 or 40 deep
    levels = F.get(F.array(F.lit(3), F.lit(5), F.lit(40)), (F.col("pos") % 4).cast("int") - 1)
    deep = F.concat(F.repeat(F.lit('{"type":"tool_result","content":['), levels), F.to_json(F.struct(F.lit("text").alias("type"), F.concat(
        F.lit("deep "), F.col("pos").cast("string")).alias("text"))), F.repeat(F.lit("]}"), levels))
    blocks = F.concat(F.lit("["), F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))), F.lit(","),
                      F.to_json(tool), F.when(F.col("pos") % 4 > 0, F.concat(F.lit(","), deep)).otherwise(""), F.lit("]"))
    delta = F.concat(F.lit('{"role":"'), role, F.lit('","ts":"'), F.coalesce(ts.cast("string"), F.lit("")),
                     F.lit('","message":{"content":'), blocks, F.lit("}}"))
    a = F.col("agent")
    line = F.when(a == "alpha", alpha).when(a == "beta", beta).when(a == "gamma", gamma).otherwise(delta)
    return m.select("agent", "unit_id", F.col("pos").alias("line_no"), line.alias("line"))


BLOCKS["o_turns"] = """
SELECT agent, unit_id, pos, role, ts_s, cwd, trim(CASE WHEN agent IN ('beta', 'delta') AND length(t) > 600
         THEN left(t, 600) || chr(10) || '…[truncated ' || CAST(length(t) - 600 AS VARCHAR) || ' chars]' ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM (SELECT *, CASE WHEN agent = 'delta' THEN CASE WHEN text = '' THEN '' ELSE text || chr(10) END || '[tool_use: grep] {"q": "a,b: \\"c", "n": ' || CAST(pos AS VARCHAR) || '}'
        || CASE WHEN pos % 4 > 0 THEN chr(10) || left(repeat('[tool_result] ', [3, 5, 40][pos % 4]) || 'deep ' || CAST(pos AS VARCHAR), 314) ELSE '' END ELSE text END AS t
      FROM f_messages WHERE role IN ('user', 'assistant')) x
"""
_TURNS = "SELECT agent, unit_id, pos, role, text, ts_s FROM o_turns WHERE text <> ''"


def _sec(df):
    return df.withColumn("ts_s", F.unix_seconds("ts")).drop("ts")


@query("norm_turns", twin(_TURNS))
def norm_turns(spark, d):
    return _sec(nz.messages(nz.norm_turns(lines(spark, d), MAX))).withColumnRenamed("line_no", "pos")


@query("read_transcripts", twin("""
SELECT agent, COUNT(*) AS messages, CAST(SUM(length(text)) AS BIGINT) AS chars, COUNT(*) AS positions FROM o_turns WHERE text <> '' GROUP BY agent
"""))
def read_transcripts(spark, d):
    path = staging_path(spark, "store")
    lines(spark, d).select("agent", F.col("line").alias("value")).write.partitionBy("agent").text(path)
    raw = nz.union_agents(*[tr.read_transcripts(spark, f"{path}/agent={a}", a) for a in AGENTS])
    turns = nz.messages(nz.norm_turns(raw, MAX))
    once = turns.groupBy("agent", "unit_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return once.groupBy("agent").agg(F.sum("n").alias("messages"), F.sum("c").alias("chars"), F.count(F.lit(1)).alias("positions"))


def _docs(spark, d, item, name="messages"):
    m = P(spark, d, "f_messages").withColumn("item", item)
    per = m.groupBy("agent", "unit_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ",").alias("items"),
        F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi"))
    return per


@query("norm_document", twin("""
SELECT agent, unit_id, pos, role, trim(CASE WHEN length(text) > 600 THEN left(text, 600) || chr(10) || '…[truncated ' || CAST(length(text) - 600 AS VARCHAR) || ' chars]' ELSE text END,
       ' ' || chr(9) || chr(10) || chr(13)) AS text, CASE WHEN unit_id % 2 = 0 THEN lo END AS first_s, CASE WHEN unit_id % 2 = 0 THEN hi END AS last_s
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit_id ORDER BY pos) - 1 AS p, MIN(ts_s) OVER (PARTITION BY unit_id) AS lo, MAX(ts_s) OVER (PARTITION BY unit_id) AS hi FROM f_messages) x
WHERE role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
""".replace("unit_id, pos, role, trim", "unit_id, CAST(p AS BIGINT) AS pos, role, trim")))
def norm_document(spark, d):
    item = _obj(role=F.col("role"), content=_nested(F.col("text")))
    per = _docs(spark, d, item)
    doc = F.when(F.col("unit_id") % 2 == 0, F.concat(
        F.lit('{"session_start":"'), F.coalesce(F.col("lo").cast("string"), F.lit("")), F.lit('","last_updated":"'),
        F.coalesce(F.col("hi").cast("string"), F.lit("")), F.lit('","messages":['), F.col("items"), F.lit("]}"))).otherwise(
        F.concat(F.lit("["), F.col("items"), F.lit("]")))
    out = nz.messages(nz.norm_document(per.select("agent", "unit_id", doc.alias("line")), MAX))
    return out.select("agent", "unit_id", F.col("pos").cast("bigint").alias("pos"), "role", "text",
                      F.unix_seconds("doc_first").alias("first_s"), F.unix_seconds("doc_last").alias("last_s"))


@query("norm_seeded", twin("""
SELECT agent, unit_id, CASE WHEN pos < 2 THEN 1 ELSE pos END AS line_no, CASE WHEN pos < 2 THEN pos ELSE 0 END AS seed_pos, role, text, ts_s FROM f_kept
"""))
def norm_seeded(spark, d):
    m = P(spark, d, "f_messages")
    iso = F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd HH:mm:ss")
    one = _obj(id=F.col("pos").cast("string"), timestamp=iso, type=F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role")),
               content=F.array(F.struct(F.col("text").alias("text"))))
    m = m.withColumn("one", one)
    head = m.groupBy("agent", "unit_id").agg(F.lit(0).cast("bigint").alias("line_no"), F.lit('{"sessionId":"x","projectHash":"h"}').alias("line"))
    seed = m.where("pos < 2").groupBy("agent", "unit_id").agg(F.lit(1).cast("bigint").alias("line_no"), F.concat(
        F.lit('{"$set":{"messages":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: x["one"]), ","), F.lit("]}}")).alias("line"))
    rest = m.where("pos >= 2").select("agent", "unit_id", F.col("pos").alias("line_no"), F.col("one").alias("line"))
    out = nz.messages(nz.norm_seeded(head.unionByName(seed).unionByName(rest), 1 << 30))
    return _sec(out.withColumn("seed_pos", F.col("seed_pos").cast("bigint")))


@query("norm_message_dir", twin("""
SELECT agent, unit_id, CAST(COALESCE(ts_s, 0) * 1000.0 AS DOUBLE) AS created, 'msg_' || CAST(pos AS VARCHAR) AS src, role,
       CASE WHEN pos % 3 = 1 THEN text || chr(10) || 'end' ELSE text END AS text, ts_s FROM f_kept
"""))
def norm_message_dir(spark, d):
    m = P(spark, d, "f_kept")
    t = F.col("text")
    doc = _obj(role=F.col("role"), time=F.struct((F.col("ts_s") * 1000).alias("created")), path=F.struct("cwd"),
               summary=F.when(F.col("pos") % 3 == 0, F.struct(t.alias("body"))),
               parts=F.when(F.col("pos") % 3 == 1, F.array(F.struct(t.alias("text")), F.struct(F.lit("end").alias("text")))),
               content=F.when(F.col("pos") % 3 == 2, t))
    raw = m.select("agent", "unit_id", F.concat(F.lit("msg_"), F.col("pos").cast("string")).alias("src"), doc.alias("line"))
    return _sec(nz.messages(nz.norm_message_dir(raw, 1 << 30)))


@query("norm_history", twin("""
SELECT agent, unit_id, role, text, CAST(1717804800 AS BIGINT) AS doc_s FROM (
  SELECT *, LAG(role) OVER w AS pr, LAG(text) OVER w AS pt FROM f_kept WINDOW w AS (PARTITION BY unit_id ORDER BY pos)) x
WHERE pr IS NULL OR NOT (pr = role AND pt = text)
"""))
def norm_history(spark, d):
    t = F.col("text")
    msg = _obj(message=F.struct("role", t.alias("content")))
    flat = _obj(role=F.col("role"), content=_nested(t))
    said = _obj(observation=F.struct(t.alias("user_input")), step=F.struct(F.lit("User Input").alias("name")))
    did = _obj(step=F.struct(F.lit("edit").alias("name"), t.alias("description")))
    k = F.col("unit_id") % 3
    item = F.when(k == 0, msg).when(k == 1, flat).when(F.col("role") == "user", said).when(F.col("role") == "assistant", did).otherwise(F.lit("{}"))
    per = _docs(spark, d, F.concat(item, F.lit(","), item))       # every message twice
    tail = F.lit(',"session_info":{"date_created":"1717804800"}}')
    doc = (F.when(k == 0, F.concat(F.lit('{"history":['), F.col("items"), F.lit("]"), tail))
           .when(k == 1, F.concat(F.lit('{"messages":['), F.col("items"), F.lit("]"), tail))
           .otherwise(F.concat(F.lit('{"history":{"timeline":['), F.col("items"), F.lit("]}"), tail)))
    out = nz.messages(nz.norm_history(per.select("agent", "unit_id", doc.alias("line")), 1 << 30))
    return out.select("agent", "unit_id", "role", "text", F.unix_seconds("doc_first").alias("doc_s"))


BLOCKS["o_md"] = """
SELECT agent, unit_id, pos * 1000000 + i AS line_no, line, CASE WHEN line LIKE '# aider chat started%' THEN 'reset' WHEN line LIKE '#### %' THEN 'user'
       WHEN line LIKE '>%' OR line LIKE '#%' THEN 'echo' WHEN trim(line, ' ' || chr(9)) <> '' THEN 'assistant' END AS mark
FROM (SELECT agent, unit_id, pos, generate_subscripts(parts, 1) AS i, CASE WHEN role = 'user' THEN '#### ' ELSE '' END || unnest(parts) AS line
      FROM (SELECT agent, unit_id, pos, role, list_concat(CASE WHEN pos = 0 THEN [CASE WHEN role = 'user' THEN '' ELSE '# aider chat started' END] ELSE [] END,
            string_split(text || chr(10) || chr(10) || '> tokens', chr(10))) AS parts FROM f_messages WHERE role <> 'system') a) b
"""


@query("norm_markdown_chat", twin("""
SELECT agent, unit_id, s AS line_no, role, left(t, 600) AS text FROM (
  SELECT agent, unit_id, s, role, trim(string_agg(CASE WHEN mark = 'user' THEN substr(line, 6) ELSE line END, chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (
    SELECT *, MAX(CASE WHEN start THEN line_no END) OVER w AS s, last_value(CASE WHEN start THEN mark END IGNORE NULLS) OVER w AS role FROM (
      SELECT *, mark IS NOT NULL AND mark IS DISTINCT FROM last_value(mark IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
      FROM o_md WHERE mark IS NULL OR mark <> 'echo') x WINDOW w AS (PARTITION BY unit_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) y
  WHERE role = 'user' AND mark IS NOT NULL OR role = 'assistant' GROUP BY agent, unit_id, s, role) z WHERE t <> ''
"""))
def norm_markdown_chat(spark, d):
    m = P(spark, d, "f_messages").where("role <> 'system'")
    head = F.when(F.col("pos") == 0, F.array(F.when(F.col("role") == "user", "").otherwise("# aider chat started"))).otherwise(
        F.array().cast("array<string>"))
    parts = F.concat(head, F.split(F.concat("text", F.lit("\n\n> tokens")), "\n"))
    rows = m.select("agent", "unit_id", "pos", "role", F.posexplode(parts).alias("i", "l"))
    raw = rows.select("agent", "unit_id", (F.col("pos") * 1000000 + F.col("i") + 1).alias("line_no"),
                      F.concat(F.when(F.col("role") == "user", "#### ").otherwise(""), "l").alias("line"))
    return nz.messages(nz.norm_markdown_chat(raw, MAX, block=1000)).drop("ts")


@query("norm_table_chat", twin("""
SELECT agent, unit_id, CAST(ts_s * 1000 AS DOUBLE) AS created, CAST(unit_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS msg_id, role, text, ts_s FROM f_kept
"""))
def norm_table_chat(spark, d):
    m = P(spark, d, "f_kept")
    parts = F.when(F.col("pos") % 2 == 0, F.to_json(_nested(F.col("text")))).otherwise(F.col("text"))
    msgs = m.select(F.concat(F.col("unit_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("id"),
                    F.col("unit_id").alias("session_id"), "role", parts.alias("parts"), (F.col("ts_s") * 1000).alias("created_at"))
    sess = m.select("agent", F.col("unit_id").alias("id")).distinct()
    return _sec(nz.messages(nz.norm_table_chat(sess, msgs, 1 << 30)))


@query("union_agents", twin("SELECT agent, COUNT(*) AS messages FROM o_turns WHERE text <> '' GROUP BY agent"))
def union_agents(spark, d):
    raw = lines(spark, d)
    parts = [nz.messages(nz.norm_turns(raw.where(F.col("agent") == a), MAX)) for a in AGENTS]
    return nz.union_agents(*parts).groupBy("agent").agg(F.count(F.lit(1)).alias("messages"))


@query("write_sessions", twin(_TURNS))
def write_sessions(spark, d):
    path = staging_path(spark, "sessions")
    tr.write_sessions(norm_turns(spark, d), path)
    return spark.read.parquet(path).select("agent", "unit_id", "pos", "role", "text", "ts_s")


BLOCKS["o_sess"] = """
SELECT agent, unit_id, CAST(SUM(CASE WHEN k THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(SUM(CASE WHEN k THEN 0 ELSE 1 END) AS BIGINT) AS skipped,
       MIN(CASE WHEN k THEN ts_s END) AS first_s, MAX(CASE WHEN k THEN ts_s END) AS last_s, MAX(cwd) AS cwd
FROM (SELECT *, role IN ('user', 'assistant') AND (agent = 'delta' OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS k FROM f_messages) x GROUP BY 1, 2
"""


def sessions(spark, d):
    """Session summaries with their cwd."""
    s = cv.session_summary(nz.norm_turns(lines(spark, d), MAX))
    cwd = P(spark, d, "f_sessions").select("agent", "unit_id", "cwd")
    return s.join(cwd, ["agent", "unit_id"])


@query("session_summary", twin("SELECT agent, unit_id, kept, skipped, first_s, last_s FROM o_sess"))
def session_summary(spark, d):
    s = cv.session_summary(nz.norm_turns(lines(spark, d), MAX))
    return s.select("agent", "unit_id", "kept", "skipped", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"))


# the ledger of the fixture: every session with an even id was seen, some of them earlier in their life
BLOCKS["o_ledger"] = """
SELECT agent, unit_id, first_s, CASE WHEN unit_id % 6 = 0 THEN last_s - 60 WHEN unit_id % 10 = 0 THEN NULL ELSE last_s END AS last_s, 'src' AS src, 100 AS processed_at
FROM f_sessions WHERE unit_id % 2 = 0
"""


def ledger(spark, d):
    s = P(spark, d, "f_sessions").where("unit_id % 2 = 0")
    last = F.when(F.col("unit_id") % 6 == 0, F.col("last_s") - 60).when(F.col("unit_id") % 10 == 0, F.lit(None)).otherwise(F.col("last_s"))
    s = s.withColumn("last_s", last).withColumn("src", F.lit("src")).withColumn("processed_at", F.lit(100))
    return s.withColumn("first_ts", F.timestamp_seconds("first_s")).withColumn("last_ts", F.timestamp_seconds("last_s"))


_AG = "(SELECT DISTINCT agent, 'scan of ' || agent AS match_mode FROM f_messages UNION ALL SELECT 'omega', 'none')"


def _agents(spark, d):
    a = P(spark, d, "f_messages").select("agent").distinct().unionByName(spark.sql("SELECT 'omega' AS agent"))
    return a.withColumn("match_mode", F.when(F.col("agent") == "omega", "none").otherwise(F.concat(F.lit("scan of "), "agent")))


# sessions that are not empty and recent enough; of these, those the ledger has seen and that did not go on are skipped
SINCE, SINCE_S = "2026-01-02", 1767312000
BLOCKS["o_recent"] = f"""
SELECT s.*, l.unit_id IS NOT NULL AND (s.last_s IS NULL OR COALESCE(s.last_s <= l.last_s, false)) AS skip
FROM o_sess s LEFT JOIN o_ledger l ON l.agent = s.agent AND l.unit_id = s.unit_id WHERE s.kept > 0 AND (s.last_s IS NULL OR s.last_s >= {SINCE_S})
"""
BLOCKS["o_cov"] = f"""
SELECT a.agent, a.match_mode, COALESCE(s.n, 0) AS sessions, COALESCE(s.m, 0) AS messages, COALESCE(s.k, 0) AS skipped_lines, COALESCE(s.z, 0) AS skipped_sessions, s.first_s, s.last_s
FROM {_AG} a LEFT JOIN (SELECT agent, SUM(CASE WHEN skip THEN 0 ELSE 1 END) AS n, SUM(CASE WHEN skip THEN 0 ELSE kept END) AS m, SUM(CASE WHEN skip THEN 0 ELSE skipped END) AS k,
  SUM(CASE WHEN skip THEN 1 ELSE 0 END) AS z, MIN(CASE WHEN NOT skip THEN first_s END) AS first_s, MAX(CASE WHEN NOT skip THEN last_s END) AS last_s
  FROM o_recent GROUP BY agent) s ON s.agent = a.agent
"""


def _cov(spark, d):
    recent = cut(at.since_filter(sessions(spark, d).where("kept > 0"), SINCE))
    delta = inc.incremental_delta(recent, ledger(spark, d))
    return cv.coverage(delta, _agents(spark, d), inc.skipped_sessions(recent, delta))


@query("coverage", twin("""
SELECT agent, match_mode, CAST(sessions AS BIGINT) AS sessions, CAST(messages AS BIGINT) AS messages, CAST(skipped_lines AS BIGINT) AS skipped_lines, CAST(skipped_sessions AS BIGINT) AS skipped_sessions, first_s, last_s FROM o_cov
"""))
def coverage(spark, d):
    c = _cov(spark, d)
    return c.withColumn("first_s", F.unix_seconds("first_ts")).withColumn("last_s", F.unix_seconds("last_ts")).drop("first_ts", "last_ts")


@query("coverage_totals", twin("""
SELECT agent, CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(messages) AS BIGINT) AS messages, CAST(SUM(skipped_lines) AS BIGINT) AS skipped_lines, CAST(SUM(skipped_sessions) AS BIGINT) AS skipped_sessions
FROM o_cov GROUP BY ROLLUP (agent)
"""))
def coverage_totals(spark, d):
    return cv.coverage_totals(_cov(spark, d))


_KIND = "CASE WHEN unit_id % 17 = 0 THEN 'dump' WHEN unit_id % 19 = 0 THEN 'index' WHEN unit_id % 23 = 0 THEN 'flat' ELSE 'session' END"


@query("coverage_gaps", twin(f"""
SELECT agent, COUNT(CASE WHEN kind = 'session' AND cwd IS NULL THEN 1 END) AS sessions_without_cwd, COUNT(CASE WHEN kind = 'flat' THEN 1 END) AS flat_files,
       COUNT(CASE WHEN kind = 'dump' THEN 1 END) AS dumps_excluded, COUNT(CASE WHEN kind = 'index' THEN 1 END) AS index_files
FROM (SELECT *, {_KIND} AS kind FROM f_sessions) x GROUP BY agent
"""))
def coverage_gaps(spark, d):
    return cv.coverage_gaps(P(spark, d, "f_sessions").withColumn("kind", F.expr(_KIND)))


BLOCKS["o_act"] = """
SELECT COALESCE(cwd, '(' || agent || ') unscoped') AS project, agent, COUNT(*) AS sessions, MIN(first_s) AS first_s, MAX(last_s) AS last_s FROM f_sessions GROUP BY 1, 2
"""


def _activity(spark, d):
    u = P(spark, d, "f_sessions").withColumn("first_ts", F.timestamp_seconds("first_s")).withColumn("last_ts", F.timestamp_seconds("last_s"))
    return cv.project_activity(u)


@query("project_activity", twin("SELECT project, agent, sessions, first_s, last_s FROM o_act"))
def project_activity(spark, d):
    return _activity(spark, d).select("project", "agent", "sessions", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"))


@query("project_index", twin("""
SELECT project, CAST(SUM(CASE WHEN agent = 'alpha' THEN sessions END) AS BIGINT) AS alpha, CAST(SUM(CASE WHEN agent = 'beta' THEN sessions END) AS BIGINT) AS beta,
       CAST(SUM(CASE WHEN agent = 'gamma' THEN sessions END) AS BIGINT) AS gamma, CAST(SUM(CASE WHEN agent = 'delta' THEN sessions END) AS BIGINT) AS delta, MAX(last_s) AS last_s FROM o_act GROUP BY project
"""))
def project_index(spark, d):
    return cv.project_index(_activity(spark, d), AGENTS).withColumn("last_s", F.unix_seconds("last_ts")).drop("last_ts")


@query("misattributed", twin("SELECT agent, CAST(sessions AS BIGINT) AS sessions FROM o_cov WHERE sessions > 0 AND agent NOT IN (SELECT agent FROM f_sessions WHERE agent < 'c')"))
def misattributed(spark, d):
    return cv.misattributed(_cov(spark, d), P(spark, d, "f_sessions").where("agent < 'c'"))


# --- attribution -----------------------------------------------------------------------------
_PROJ = "(SELECT DISTINCT '/home/u/p' || CAST(conv_id % 7 AS STRING) AS project FROM {conversations} UNION ALL SELECT '/home/u' UNION ALL SELECT '/home/u/p3/su')"


def projects(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    base = c.select(F.concat(F.lit("/home/u/p"), (F.col("conv_id") % 7).cast("string")).alias("project")).distinct()
    return base.unionByName(spark.sql("SELECT '/home/u' AS project UNION ALL SELECT '/home/u/p3/su'"))


@query("probe_cwd", twin("SELECT agent, unit_id, CASE WHEN agent IN ('alpha', 'gamma') THEN cwd END AS cwd FROM f_sessions"))
def probe_cwd(spark, d):
    return at.probe_cwd(lines(spark, d))


@query("attribute_cwd", twin(f"""
SELECT s.agent, s.unit_id, p.project FROM f_sessions s JOIN {_PROJ} p ON s.cwd = p.project OR starts_with(s.cwd, p.project || '/')
"""))
def attribute_cwd(spark, d):
    return at.attribute_cwd(P(spark, d, "f_sessions"), projects(spark, d), include_subdirs=True)


@query("attribute_encoded", twin(f"""
SELECT s.agent, s.unit_id, p.project FROM (SELECT agent, unit_id, regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g') AS dir FROM f_sessions WHERE cwd IS NOT NULL) s
JOIN (SELECT project, regexp_replace(project, '[^A-Za-z0-9]', '-', 'g') AS enc FROM {_PROJ}) p ON s.dir = p.enc OR starts_with(s.dir, p.enc || '-')
"""))
def attribute_encoded(spark, d):
    u = P(spark, d, "f_sessions").where("cwd is not null").withColumn("dir", tx.encode_path(F.col("cwd")))
    return at.attribute_encoded(u, projects(spark, d), include_subdirs=True)


@query("attribute_mention", twin(f"""
SELECT s.agent, s.unit_id, p.project FROM f_sessions s JOIN {_PROJ} p ON s.agent IN ('alpha', 'gamma') AND contains(s.cwd, p.project)
"""))
def attribute_mention(spark, d):
    return at.attribute_mention(lines(spark, d), projects(spark, d))


@query("attribute_named", twin(f"""
SELECT DISTINCT s.agent, s.unit_id, p.project
FROM (SELECT agent, unit_id, 'p' || CAST(unit_id % 9 AS VARCHAR) AS dir, CASE WHEN unit_id % 5 = 0 THEN sha256('/home/u/p' || CAST(unit_id % 7 AS VARCHAR)) END AS hh FROM f_sessions) s
JOIN (SELECT a.agent, a.dir, p.project FROM (SELECT DISTINCT agent, 'p' || CAST(unit_id % 9 AS VARCHAR) AS dir FROM f_sessions) a JOIN {_PROJ} p
        ON a.dir = regexp_replace(p.project, '^.*/', '') OR (a.dir = 'p8' AND p.project = '/home/u/p2')
      UNION SELECT b.agent, 'p' || CAST(b.unit_id % 9 AS VARCHAR), q.project FROM f_sessions b JOIN {_PROJ} q ON b.unit_id % 5 = 0 AND q.project = '/home/u/p' || CAST(b.unit_id % 7 AS VARCHAR)) p
  ON p.agent = s.agent AND p.dir = s.dir
"""))
def attribute_named(spark, d):
    u = P(spark, d, "f_sessions").select("agent", "unit_id", F.concat(F.lit("p"), (F.col("unit_id") % 9).cast("string")).alias("dir"), F.when(
        F.col("unit_id") % 5 == 0, tx.project_hash(F.concat(F.lit("/home/u/p"), (F.col("unit_id") % 7).cast("string")))).alias("header_hash"))
    return at.attribute_named(u, projects(spark, d), spark.sql("SELECT 'p8' AS name, '/home/u/p2/' AS path"))


@query("since_filter", twin("SELECT agent, unit_id, last_s FROM o_sess WHERE last_s IS NULL OR last_s >= 1767312000"))
def since_filter(spark, d):
    return at.since_filter(sessions(spark, d), "2026-01-02").select("agent", "unit_id", F.unix_seconds("last_ts").alias("last_s"))


_DIRS = """
SELECT DISTINCT CASE c_custkey % 8 WHEN 0 THEN '.claude' WHEN 1 THEN '.windsurfx' || CAST(c_custkey AS STRING) WHEN 2 THEN '.cursor-tutor'
  WHEN 3 THEN 'ampere' || CAST(c_custkey AS STRING) WHEN 4 THEN 'amp-' || CAST(c_custkey AS STRING) WHEN 5 THEN '.Rooster' || CAST(c_custkey AS STRING)
  WHEN 6 THEN '.android' ELSE 'gooseberry' || CAST(c_nationkey AS STRING) END AS name FROM {customer}
"""


@query("unknown_stores", twin(f"SELECT name FROM ({_DIRS}) x WHERE name LIKE '.windsurfx%' OR name LIKE 'amp-%' OR name LIKE '.Roo%' OR name LIKE 'goose%'"))
def unknown_stores(spark, d):
    return at.unknown_stores(spark.sql(_DIRS.replace("{customer}", f"parquet.`{d}/customer.parquet`")))


# --- the composed job ------------------------------------------------------------------------
_STAGED = [reg.Store("alpha", "", r"/store=alpha/dir=([^/]+)/unit=([^/]+)/[^/]+", (2,), 1, rule="encoded", match_mode="directory"),
           reg.Store("beta", "", r"/store=beta/dir=[^/]+/unit=([^/]+)/[^/]+", rule="cwd", match_mode="cwd"),
           reg.Store("gamma", "", r"/store=gamma/dir=[^/]+/unit=([^/]+)/[^/]+", layout=reg.DOCUMENT, normaliser="document", rule="mention", match_mode="mention"),
           reg.Store("delta", "", r"/store=delta/dir=([^/]+)/unit=([^/]+)/[^/]+", (2,), 1, normaliser="seeded", rule="named", match_mode="name"),
           reg.Store("omega", "", r"/store=omega/([^/]+)", match_mode="nothing")]


def _home(spark, d, upto: int):
    """Stores of four kinds on disk, one folder a session, with the messages before place ``upto``."""
    m = P(spark, d, "f_messages").where(F.col("pos") < upto)
    iso = F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    role, text, cwd, a, at_pos = F.col("role"), F.col("text"), F.col("cwd"), F.col("agent"), F.col("pos").cast("bigint").alias("at")
    of = lambda name: m.where(a == name)
    key = [a.alias("store"), F.lit("all").alias("dir"), F.col("unit_id").alias("unit")]
    alpha = of("alpha").select(a.alias("store"), F.coalesce(tx.encode_path(cwd), F.lit("none")).alias("dir"), F.col("unit_id").alias("unit"), at_pos,
                               _obj(type=role, timestamp=iso, message=F.struct(role, text.alias("content"))).alias("value"))
    meta = of("beta").groupBy("agent", "unit_id").agg(F.max("cwd").alias("cwd"))
    beta = meta.select(*key, F.lit(-1).cast("bigint").alias("at"), _obj(type=F.lit("session_meta"), payload=F.struct("cwd")).alias("value")).unionByName(
        of("beta").select(*key, at_pos, _obj(type=F.lit("response_item"), timestamp=iso, payload=F.struct(
            F.lit("message").alias("type"), role, _nested(text).alias("content"))).alias("value")))
    # one document a session: its messages in order, after one that names the folder
    item = _obj(role=role, timestamp=iso, content=_nested(text))
    gamma = of("gamma").withColumn("item", item).groupBy(*key).agg(F.max("cwd").alias("cwd"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ",").alias("items"))
    named = _obj(role=F.lit("system"), content=F.coalesce(F.col("cwd"), F.lit("no folder")))
    gamma = gamma.select("store", "dir", "unit", F.lit(0).cast("bigint").alias("at"), F.concat(F.lit("["), named, F.lit(","), F.col("items"), F.lit("]")).alias("value"))
    where = [F.lit("delta").alias("store"), F.concat(F.lit("p"), (F.col("unit_id") % 9).cast("string")).alias("dir"), F.col("unit_id").alias("unit")]
    head = of("delta").select("unit_id").distinct().select(*where, F.lit(-1).cast("bigint").alias("at"), _obj(sessionId=F.lit("x"), projectHash=F.when(
        F.col("unit_id") % 5 == 0, tx.project_hash(F.concat(F.lit("/home/u/p"), (F.col("unit_id") % 7).cast("string")))).otherwise("none")).alias("value"))
    delta = head.unionByName(of("delta").select(*where, at_pos, _obj(
        timestamp=iso, type=F.when(role == "assistant", "gemini").otherwise(role), content=F.array(F.struct(text.alias("text")))).alias("value")))
    path, parts = staging_path(spark, "home"), ["store", "dir", "unit"]
    rows = alpha.unionByName(beta).unionByName(gamma).unionByName(delta)
    rows.repartition(max(8, spark.sparkContext.defaultParallelism), *parts).sortWithinPartitions(*parts, "at").select(*parts, "value").write.partitionBy(*parts).text(path)
    return path


def _found(upto: int) -> str:
    """Sessions of the staged stores with the projects they belong to."""
    kept = "role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"
    return f"""
SELECT s.*, p.project FROM (
  SELECT agent, unit_id, MAX(cwd) AS cwd, COUNT(CASE WHEN {kept} THEN 1 END) AS kept,
         COUNT(CASE WHEN NOT ({kept}) AND NOT (agent = 'delta' AND role = 'system') THEN 1 END) + CASE WHEN agent IN ('beta', 'gamma') THEN 1 ELSE 0 END AS skipped,
         MIN(CASE WHEN {kept} THEN ts_s END) AS first_s, MAX(CASE WHEN {kept} THEN ts_s END) AS last_s FROM f_messages WHERE pos < {upto} GROUP BY 1, 2) s
JOIN (SELECT agent, unit_id, project FROM o_owner UNION SELECT * FROM o_named) p ON p.agent = s.agent AND p.unit_id = s.unit_id WHERE s.kept > 0
"""


BLOCKS["o_owner"] = f"""
SELECT s.agent, s.unit_id, p.project FROM f_sessions s JOIN {_PROJ} p ON
  CASE s.agent WHEN 'alpha' THEN regexp_replace(s.cwd, '[^A-Za-z0-9]', '-', 'g') || '-' LIKE regexp_replace(p.project, '[^A-Za-z0-9]', '-', 'g') || '-%'
    WHEN 'beta' THEN s.cwd = p.project OR starts_with(s.cwd, p.project || '/') WHEN 'gamma' THEN contains(s.cwd, p.project) ELSE false END
"""
BLOCKS["o_named"] = f"""
SELECT s.agent, s.unit_id, q.project FROM f_sessions s JOIN (
  SELECT 'p' || CAST(i AS VARCHAR) AS dir, p.project FROM range(9) r(i) JOIN {_PROJ} p ON 'p' || CAST(i AS VARCHAR) = regexp_replace(p.project, '^.*/', '')
    OR i = 8 AND p.project IN ('/home/u/p3/su', '/home/u/p3', '/home/u')
  UNION SELECT 'p' || CAST(b.unit_id % 9 AS VARCHAR), p.project FROM f_sessions b JOIN {_PROJ} p ON b.agent = 'delta' AND b.unit_id % 5 = 0 AND p.project = '/home/u/p' || CAST(b.unit_id % 7 AS VARCHAR)
) q ON q.dir = 'p' || CAST(s.unit_id % 9 AS VARCHAR) WHERE s.agent = 'delta'
"""
BLOCKS["o_first"] = _found(3) + " AND (last_s IS NULL OR last_s >= 1767312000)"
BLOCKS["o_second"] = f"""
SELECT n.*, f.unit_id IS NOT NULL AND (n.last_s IS NULL OR COALESCE(n.last_s <= f.last_s, false)) AS skip
FROM ({_found(1 << 30)} AND (last_s IS NULL OR last_s >= 1767312000)) n LEFT JOIN o_first f ON f.project = n.project AND f.agent = n.agent AND f.unit_id = n.unit_id
"""


@query("collect", twin(f"""
SELECT a.project, a.agent, CAST(COALESCE(s.n, 0) AS BIGINT) AS sessions, CAST(COALESCE(s.m, 0) AS BIGINT) AS messages, CAST(COALESCE(s.k, 0) AS BIGINT) AS skipped_lines,
       CAST(COALESCE(s.z, 0) AS BIGINT) AS skipped_sessions, s.first_s, s.last_s, CAST(COALESCE(s.e, 0) AS BIGINT) AS ledger_entries
FROM (SELECT p.project, g.agent FROM {_PROJ} p, (SELECT unnest(['alpha', 'beta', 'gamma', 'delta', 'omega']) AS agent) g) a
LEFT JOIN (SELECT project, agent, COUNT(CASE WHEN NOT skip THEN 1 END) AS n, SUM(CASE WHEN NOT skip THEN kept END) AS m, SUM(CASE WHEN NOT skip THEN skipped END) AS k, COUNT(CASE WHEN skip THEN 1 END) AS z,
             MIN(CASE WHEN NOT skip THEN first_s END) AS first_s, MAX(CASE WHEN NOT skip THEN last_s END) AS last_s, COUNT(*) AS e FROM o_second GROUP BY 1, 2) s ON s.project = a.project AND s.agent = a.agent
"""))
def collect(spark, d):
    """Two runs over growing stores: what the second one emits, skips, and leaves in the ledger."""
    ledger_path = staging_path(spark, "collected")
    names = spark.sql("SELECT 'p8' AS name, '/home/u/p3/su/' AS path")
    for run, upto in ((1, 3), (2, 1 << 30)):
        done = co.collect(spark, _home(spark, d, upto), projects(spark, d), staging_path(spark, "out"), ledger_path, f"run {run}", run, _STAGED, SINCE, True, names=names)
    entries = inc.read_ledger(spark, ledger_path).groupBy("project", "agent").agg(F.count(F.lit(1)).alias("ledger_entries"))
    c = done.coverage.join(entries, ["project", "agent"], "left").fillna(0, ["ledger_entries"])
    return c.select("project", "agent", "sessions", "messages", "skipped_lines", "skipped_sessions", F.unix_seconds("first_ts").alias("first_s"),
                    F.unix_seconds("last_ts").alias("last_s"), "ledger_entries")
