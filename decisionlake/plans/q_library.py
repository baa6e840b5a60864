"""Registered queries: chains, supersession graph, aliases, resolution, lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.operators import alias as al
from decisionlake.operators import chains, graph, library
from decisionlake.operators import resolve as rs
from decisionlake.plans.registry import query
from decisionlake.plans.twins import over_queries, twin
from decisionlake.session import cut
from decisionlake.sources.fixtures import projection as P

DIMS = ["urgent", "routine"]


def records(spark, d, columns=("*",)):
    """All records, with the columns that a query's steps read."""
    return cut(P(spark, d, "f_records").select(*columns))


LINKS = ["lib", "rec_id", "status", "supersedes"]
ALIASED = [*LINKS, "aliases"]
ASKED = [*ALIASED, "type", "title", "field_text", "body"]
SHOWN = [*ASKED, "path", "date", "decided_originally"]


_CHAINS = """
SELECT entity_key, 'Entity ' || substr(entity_key, 8) AS entity, dimension,
       ROW_NUMBER() OVER w AS pos, value, CAST(d AS VARCHAR) AS date,
       CASE WHEN LEAD(value) OVER w IS NULL THEN 'Accepted' ELSE 'Superseded' END AS status,
       LEAD(value) OVER w AS superseded_by, LAG(value) OVER w AS supersedes
FROM (SELECT trim(regexp_replace(lower(entity), '\\s+', ' ', 'g')) AS entity_key, lower(trim(dimension)) AS dimension,
             value, MIN(d) AS d FROM f_extractions WHERE lower(trim(dimension)) IN ('urgent', 'routine') GROUP BY 1, 2, 3) x
WINDOW w AS (PARTITION BY entity_key, dimension ORDER BY d, value)
"""


@query("assemble_chains", twin(_CHAINS))
def assemble_chains(spark, d):
    out = chains.assemble_chains(P(spark, d, "f_extractions"), DIMS)
    return out.withColumn("date", F.col("date").cast("string"))


@query("assign_numbers", twin("""
SELECT p_type, p_partkey, COALESCE(c.last_number, 0) + ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_partkey) AS number
FROM {part} LEFT JOIN (SELECT p_type AS t, MAX(p_size) AS last_number FROM {part} WHERE p_brand < 'Brand#3' GROUP BY 1) c ON c.t = p_type
"""))
def assign_numbers(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    counters = part.where("p_brand < 'Brand#3'").select("p_type", F.col("p_size").alias("last_number"))
    return chains.assign_numbers(part.select("p_type", "p_partkey"), counters, "p_type", "p_partkey", spread=512).select(
        "p_type", "p_partkey", F.col("number").cast("bigint").alias("number"))


@query("supersede_edges", twin("SELECT lib, src_id, dst_id, via FROM o_edges"))
def supersede_edges(spark, d):
    return graph.supersede_edges(records(spark, d, LINKS))


@query("resolve_current", twin("SELECT lib, rec_id, endpoint, depth, terminal FROM o_res"))
def resolve_current(spark, d):
    return graph.resolve_current(records(spark, d))


@query("resolve_walk", twin("SELECT lib, rec_id, hop, walked_id FROM o_trail"))
def resolve_walk(spark, d):
    r = records(spark, d)
    return graph.resolve_walk(r, cut(graph.resolve_current(r)))


@query("supersede_cycles", twin("SELECT DISTINCT lib, a AS rec_id FROM o_reach WHERE a = b"))
def supersede_cycles(spark, d):
    return graph.supersede_cycles(graph.validation_edges(records(spark, d))).select("lib", "rec_id")


@query("invalid_chains", twin("SELECT lib, rec_id, reason FROM o_invalid"))
def invalid_chains(spark, d):
    r = records(spark, d, ALIASED)
    ids = cut(graph.nodes(r))
    return graph.invalid_chains(r, cut(graph.resolve_current(r, ids)), ids)


@query("immediately_replaced", twin("""
SELECT p.lib, p.rec_id, p.replaced_id, t.title AS replaced_title
FROM o_replaced p JOIN f_records r ON r.lib = p.lib AND r.rec_id = p.rec_id AND r.status LIKE 'Accepted%'
JOIN f_records t ON t.lib = p.lib AND t.rec_id = p.replaced_id
"""))
def immediately_replaced(spark, d):
    r = records(spark, d)
    return graph.immediately_replaced(r, r.where("status like 'Accepted%'"))


_OPS = """
SELECT lib, rec_id AS old_id,
       label || ' ' || CASE WHEN length(CAST(number + CASE WHEN number % 7 = 0 THEN 0 ELSE number % 5 END AS STRING)) >= 4
         THEN CAST(number + CASE WHEN number % 7 = 0 THEN 0 ELSE number % 5 END AS STRING)
         ELSE lpad(CAST(number + CASE WHEN number % 7 = 0 THEN 0 ELSE number % 5 END AS STRING), 4, '0') END AS new_id
FROM f_records WHERE status NOT LIKE 'Superseded%'
"""


def _ops(spark, d):
    r = records(spark, d).where("status not like 'Superseded%'")
    from decisionlake.functions.text import record_id
    step = F.when(F.col("number") % 7 == 0, 0).otherwise(F.col("number") % 5)
    return r.select("lib", F.col("rec_id").alias("old_id"), record_id(F.col("label"), F.col("number") + step).alias("new_id"))


_GOOD = f"""
(SELECT o.lib, o.old_id, o.new_id FROM ({_OPS}) o JOIN f_records n ON n.lib = o.lib AND n.rec_id = o.new_id WHERE o.old_id <> o.new_id)
"""


@query("apply_supersede", twin(f"""
SELECT r.lib, r.rec_id,
       CASE WHEN NOT clash AND by_id IS NOT NULL THEN 'Superseded by ' || by_id ELSE r.status END AS status,
       CASE WHEN NOT clash AND of_id IS NOT NULL THEN of_id ELSE r.supersedes END AS supersedes,
       CASE WHEN clash THEN 'conflict' WHEN by_id IS NOT NULL THEN 'superseded' WHEN of_id IS NOT NULL THEN 'supersedes' ELSE 'none' END AS change
FROM (SELECT r.lib, r.rec_id, r.status, r.supersedes, a.by_id, b.of_id, COALESCE(a.n, 0) > 1 OR COALESCE(b.n, 0) > 1 AS clash
      FROM f_records r
      LEFT JOIN (SELECT lib, old_id, COUNT(*) AS n, MIN(new_id) AS by_id FROM {_GOOD} x GROUP BY 1, 2) a ON a.lib = r.lib AND a.old_id = r.rec_id
      LEFT JOIN (SELECT lib, new_id, COUNT(*) AS n, MIN(old_id) AS of_id FROM {_GOOD} y GROUP BY 1, 2) b ON b.lib = r.lib AND b.new_id = r.rec_id) r
"""))
def apply_supersede(spark, d):
    return graph.apply_supersede(records(spark, d), _ops(spark, d))


@query("alias_map", twin("""
SELECT a.lib, a.alias, a.target_id, COUNT(*) OVER (PARTITION BY a.lib, a.alias) > 1 AS collision FROM o_amap a
"""))
def alias_map(spark, d):
    lib = rs.Library.of(records(spark, d))
    clash = al.alias_collisions(lib.amap)
    return lib.amap.join(clash, ["lib", "alias"], "left").select(
        "lib", "alias", "target_id", F.col("targets").isNotNull().alias("collision"))


@query("glossary", twin("""
SELECT a.lib, a.alias, a.target_id, r.title, r.status, COUNT(*) OVER (PARTITION BY a.lib, a.alias) > 1 AS ambiguous
FROM o_amap a JOIN f_records r ON r.lib = a.lib AND r.rec_id = a.target_id
"""))
def glossary(spark, d):
    lib = rs.Library.of(records(spark, d, [*ALIASED, "title"]))
    return al.glossary(lib.records, lib.amap)


_Q = "SELECT lib, query_id, text FROM f_queries"


@query("match_aliases", over_queries(_Q, "SELECT lib, query_id, alias FROM o_hit_ok"))
def match_aliases(spark, d):
    lib = rs.Library.of(records(spark, d, ALIASED))
    return al.match_aliases(P(spark, d, "f_queries"), lib.amap)


@query("resolve_query", over_queries(_Q, """
SELECT s.lib, s.query_id, s.matched_records, s.conflict, s.resolved_unique, s.note, e.endpoint, e.via, e.alias, r.title, r.status, r.path, r.aliases,
       CASE WHEN r.decided_originally <> '' THEN r.decided_originally ELSE r.date END AS date,
       CASE WHEN e.via = 'literal' THEN p.replaced_id END AS replaced_id
FROM o_summary s LEFT JOIN o_ends e ON e.lib = s.lib AND e.query_id = s.query_id
LEFT JOIN f_records r ON r.lib = e.lib AND r.rec_id = e.endpoint
LEFT JOIN o_replaced p ON p.lib = e.lib AND p.rec_id = e.endpoint
"""))
def resolve_query(spark, d):
    return rs.resolve_query(rs.Library.of(records(spark, d, SHOWN)), P(spark, d, "f_queries"))


@query("resolve_trail", over_queries(_Q, """
SELECT DISTINCT m.lib, m.query_id, l.endpoint, t.walked_id AS superseded_id
FROM o_match m JOIN o_res r ON r.lib = m.lib AND r.rec_id = m.rec_id
JOIN o_literal l ON l.lib = m.lib AND l.query_id = m.query_id AND l.endpoint = r.endpoint
JOIN o_trail t ON t.lib = m.lib AND t.rec_id = m.rec_id
"""))
def resolve_trail(spark, d):
    lib = rs.Library.of(records(spark, d, ASKED))
    return rs.resolve_trail(lib, rs.resolve(lib, P(spark, d, "f_queries")))


_TITLES = "SELECT DISTINCT lib, title AS query_id, title AS text FROM f_records WHERE lower(status) LIKE 'accepted%'"


@query("ambiguous_topics", over_queries(_TITLES, """
SELECT a.lib, a.rec_id, a.title, COALESCE(k.n, 0) - COALESCE(o.own, 0) AS collisions
FROM f_records a JOIN o_summary s ON s.lib = a.lib AND s.query_id = a.title
LEFT JOIN (SELECT lib, query_id, COUNT(DISTINCT id) AS n FROM (
             SELECT lib, query_id, endpoint AS id FROM o_ends UNION ALL SELECT lib, query_id, target_id FROM o_targets WHERE n > 1) c GROUP BY 1, 2) k
  ON k.lib = a.lib AND k.query_id = a.title
LEFT JOIN (SELECT DISTINCT lib, query_id, id, 1 AS own FROM (
             SELECT lib, query_id, endpoint AS id FROM o_ends UNION ALL SELECT lib, query_id, target_id FROM o_targets WHERE n > 1) c) o
  ON o.lib = a.lib AND o.query_id = a.title AND o.id = a.rec_id
WHERE lower(a.status) LIKE 'accepted%' AND NOT (s.resolved_unique AND EXISTS (
  SELECT 1 FROM o_ends e WHERE e.lib = a.lib AND e.query_id = a.title AND e.endpoint = a.rec_id))
"""))
def ambiguous_topics(spark, d):
    return rs.ambiguous_topics(rs.Library.of(records(spark, d)))


_SEARCH = """
SELECT lib, query_id, rank, rec_id, type, status, title, total_matches, total_matches > 3 AS truncated FROM (
  SELECT q.lib, q.query_id, r.rec_id, r.type, r.status, r.title,
         ROW_NUMBER() OVER (PARTITION BY q.lib, q.query_id ORDER BY r.type, r.path) AS rank,
         COUNT(*) OVER (PARTITION BY q.lib, q.query_id) AS total_matches
  FROM (SELECT *, CASE WHEN query_id % 5 = 0 THEN 'pdr' END AS want_type, CASE WHEN query_id % 7 = 0 THEN 'Super' END AS want_status FROM f_queries) q
  JOIN f_records r ON r.lib = q.lib AND (contains(lower(concat_ws(' ', r.title, """ + ", ".join(f"nullif(r.{c}, '')" for c in config.FIELD_COLUMNS.values()) + """)), lower(q.text)) OR contains(lower(r.body), lower(q.text)))
   AND (q.want_type IS NULL OR q.want_type = r.type) AND (q.want_status IS NULL OR starts_with(lower(r.status), lower(q.want_status)))) x
WHERE rank <= 3
"""


@query("search", twin(_SEARCH))
def search(spark, d):
    q = P(spark, d, "f_queries").withColumn("type", F.when(F.col("query_id") % 5 == 0, "pdr")).withColumn(
        "status", F.when(F.col("query_id") % 7 == 0, "Super"))
    return library.search(records(spark, d), q, 3)


_ASKS = """
SELECT 'lib' || CAST(o_orderkey % 4 AS STRING) AS lib, o_orderkey AS ask_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'ADR ' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'pdr' || CAST(o_orderkey AS STRING)
            WHEN 2 THEN ' ' || CAST(o_orderkey AS STRING) || ' ' WHEN 3 THEN 'Pdr 000' || CAST(o_orderkey AS STRING) ELSE 'x-' || CAST(o_orderkey AS STRING) END AS id_text
FROM {orders}
"""


@query("get_record", twin(f"""
SELECT a.lib, a.ask_id, a.id_text,
       CASE WHEN a.ask_id % 5 = 4 THEN 'bad_id' WHEN h.n IS NULL THEN 'none' WHEN h.n > 1 THEN 'ambiguous' ELSE 'one' END AS outcome,
       CASE WHEN h.n = 1 THEN h.rec_id END AS rec_id, CASE WHEN h.n = 1 THEN h.title END AS title
FROM ({_ASKS}) a LEFT JOIN (
  SELECT b.lib, b.ask_id, COUNT(*) AS n, MIN(r.rec_id) AS rec_id, MIN(r.title) AS title FROM ({_ASKS}) b
  JOIN f_records r ON r.lib = b.lib AND r.number = b.ask_id AND b.ask_id % 5 <> 4
   AND (b.ask_id % 5 = 2 OR (b.ask_id % 5 = 0 AND r.label = 'ADR') OR (b.ask_id % 5 IN (1, 3) AND r.label = 'PDR'))
  GROUP BY 1, 2) h ON h.lib = a.lib AND h.ask_id = a.ask_id
"""))
def get_record(spark, d):
    text = _ASKS.replace("{orders}", f"parquet.`{d}/orders.parquet`")
    return library.get_record(records(spark, d), spark.sql(text))


@query("review_baseline", twin("""
SELECT lib, rec_id, effective, COALESCE(honoured, effective) AS baseline, honoured,
       CASE WHEN reviewed = 'soon' THEN 'not a YYYY-MM-DD date' WHEN reviewed <> '' AND try_cast(reviewed AS DATE) IS NULL THEN 'not a real calendar date'
            WHEN reviewed = '2999-01-01' THEN 'in the future' WHEN reviewed <> '' AND honoured IS NULL THEN 'before the effective date' END AS review_problem
FROM (SELECT lib, rec_id, reviewed, effective, CASE WHEN try_cast(reviewed AS DATE) IS NOT NULL AND reviewed <= '2030-01-01' AND reviewed >= effective THEN reviewed END AS honoured
      FROM (SELECT *, CASE WHEN decided_originally <> '' THEN decided_originally ELSE date END AS effective FROM f_records) r) x
"""))
def review_baseline(spark, d):
    from decisionlake.sources.fixtures import TODAY
    return library.review_baseline(records(spark, d), TODAY).select(
        "lib", "rec_id", "effective", "baseline", "honoured", "review_problem")


@query("extract_source_paths", twin("""
SELECT lib, rec_id, CAST(pos AS INTEGER) AS pos, source_path FROM (
  SELECT lib, rec_id, 0 AS pos, CASE number % 6 WHEN 5 THEN 'src/o' || CAST((number * 11) % 20000 AS VARCHAR) || '.py'
         ELSE 'src/o' || CAST((number * 7) % 20000 AS VARCHAR) || '.py' END AS source_path FROM f_records WHERE number % 6 >= 2
  UNION ALL SELECT lib, rec_id, 1, 'README.md' FROM f_records WHERE number % 6 = 2
  UNION ALL SELECT lib, rec_id, 1, 'lib/util' || CAST(entity % 50 AS VARCHAR) FROM f_records WHERE number % 6 = 3) x
"""))
def extract_source_paths(spark, d):
    return library.extract_source_paths(records(spark, d))


@query("timeline", twin("""
SELECT lib, CASE WHEN decided_originally <> '' THEN decided_originally ELSE date END AS effective, type, number, rec_id, title, status
FROM f_records ORDER BY effective, type, number, lib
"""))
def timeline(spark, d):
    return library.timeline(records(spark, d))
