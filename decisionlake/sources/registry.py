"""The registry of conversation stores: where each agent keeps its sessions, how they are laid out, and how they find their project.

The registry is a table. Readers, normalisers and attribution rules are picked by its columns, so a new agent is a new row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.session import listing

LINES, DOCUMENT = "lines", "document"
SESSION, FLAT, DUMP, INDEX = "session", "flat", "dump", "index"


@dataclass(frozen=True)
class Store:
    """``root`` is the folder below home (a glob) and ``path`` a pattern for the end of a file's path; ``unit`` and ``dir`` name its groups.

    normaliser: turns, seeded, markdown (of lines), document, message_dir, history (of whole documents).
    rule: how a session finds its projects: encoded or bare_encoded (directory), cwd, mention, cwd_or_mention, named, message_cwd,
    location. ``kind`` marks files that are counted and not read.
    """
    agent: str
    root: str
    path: str
    unit: tuple[int, ...] = (1,)
    dir: int = 0
    layout: str = LINES
    normaliser: str = "turns"
    rule: str = "mention"
    match_mode: str = ""
    kind: str = SESSION


LOG = "(in projects)"                     # logs inside projects, named one by one; Spark lists no hidden file, so they carry no leading point
_STORAGE = "Library/Application Support/*/User/globalStorage"
_EDITOR = r"/Library/Application Support/([^/]+)/User/globalStorage"


def _tasks(agent: str, extension: str) -> Store:
    return Store(agent, f"{_STORAGE}/{extension}/tasks", rf"{_EDITOR}/{re.escape(extension)}/tasks/([^/]+)/api_conversation_history\.json", (1, 2), 0, DOCUMENT, "document", "mention",
                 "globalStorage tasks; fuzzy path mention")


# fixed values: agents, where they keep sessions, and the names of the ways they are matched; the first row that fits a file counts
STORES = [
    Store("claude", ".claude/projects", r"/\.claude/projects/([^/]+)/([^/]+)\.jsonl", (2,), 1, rule="encoded", match_mode="path-encoded project dir"),
    Store("codex", ".codex/sessions", r"/\.codex/sessions/(?:.*/)?(rollout-[^/]*)\.jsonl", rule="cwd", match_mode="scan + cwd filter"),
    Store("factory", ".factory/sessions", r"/\.factory/sessions/([^/]+)/([^/]+)\.jsonl", (2,), 1, rule="encoded", match_mode="path-encoded project dir"),
    Store("factory", ".factory/sessions", r"/\.factory/sessions/([^/]+)\.jsonl", kind=FLAT),
    Store("hermes", ".hermes/sessions", r"/\.hermes/sessions/(request_dump_[^/]*)\.json", layout=DOCUMENT, kind=DUMP),
    Store("hermes", ".hermes/sessions", r"/\.hermes/sessions/([^/]+)\.jsonl", rule="mention", match_mode="fuzzy: project path mentioned in transcript"),
    Store("hermes", ".hermes/sessions", r"/\.hermes/sessions/(session_[^/]*)\.json", layout=DOCUMENT, normaliser="document", rule="mention",
          match_mode="fuzzy: project path mentioned in transcript"),
    Store("cursor", ".cursor/projects", r"/\.cursor/projects/([^/]+)/agent-transcripts/(?:.*/)?([^/]+)\.jsonl", (2,), 1, rule="bare_encoded", match_mode="cursor-encoded project dir"),
    Store("gemini", ".gemini/tmp", r"/\.gemini/tmp/([^/]+)/chats/([^/]+)\.jsonl", (2,), 1, normaliser="seeded", rule="named", match_mode="tmp/<project>/chats + projects.json map"),
    Store("qwen", ".qwen/tmp", r"/\.qwen/tmp/([^/]+)/chats/([^/]+)\.jsonl", (2,), 1, normaliser="seeded", rule="named", match_mode="tmp/<project>/chats (gemini-fork)"),
    Store("opencode", ".local/share/opencode/storage/message", r"/opencode/storage/message/([^/]+)/[^/]+\.json", (1,), 1, DOCUMENT, "message_dir", "message_cwd", "session dir; path.cwd per message"),
    _tasks("cline", "saoudrizwan.claude-dev"),
    _tasks("roo", "rooveterinaryinc.roo-cline"),
    _tasks("kilo", "kilocode.kilo-code"),
    Store("continue", ".continue/sessions", r"/\.continue/sessions/(sessions)\.json", layout=DOCUMENT, kind=INDEX),
    Store("continue", ".continue/sessions", r"/\.continue/sessions/([^/]+)\.json", layout=DOCUMENT, normaliser="history", rule="mention",
          match_mode="fuzzy: project path mentioned in session"),
    Store("claude-agent", "Library/Application Support/Claude/local-agent-mode-sessions", r"/local-agent-mode-sessions/(?:.*/)?(audit)\.jsonl", kind=INDEX),
    Store("claude-agent", "Library/Application Support/Claude/local-agent-mode-sessions", r"/local-agent-mode-sessions/(?:.*/)?([^/]+)\.jsonl", rule="cwd_or_mention", match_mode="agent-mode JSONL; cwd field"),
    Store("aider", LOG, r"(/.*)/\.?aider\.chat\.history\.md", (1,), 1, normaliser="markdown", rule="location", match_mode="per-project .aider.chat.history.md"),
    Store("goose", ".local/share/goose/sessions", r"/goose/sessions/([^/]+)\.jsonl", rule="cwd_or_mention", match_mode="sessions/*.jsonl; cwd in meta or fuzzy"),
    Store("windsurf", ".codeium/windsurf", r"/\.codeium/windsurf/(?:.*/)?([^/]+)\.jsonl", match_mode="best-effort scan (UNVERIFIED)"),
    Store("windsurf", ".codeium/windsurf", r"/\.codeium/windsurf/(?:.*/)?([^/]*conversation[^/]*)\.json", layout=DOCUMENT, normaliser="document", match_mode="best-effort scan (UNVERIFIED)"),
    Store("windsurf", ".codeium/windsurf", r"/\.codeium/windsurf/(?:.*/)?cascade[^/]*/(?:.*/)?([^/]+)\.json", layout=DOCUMENT, normaliser="document",
          match_mode="best-effort scan (UNVERIFIED)"),
    Store("augment", f"{_STORAGE}/augment.vscode-augment", rf"{_EDITOR}/augment\.vscode-augment/(?:.*/)?([^/]+)\.jsonl", (2,), match_mode="best-effort globalStorage scan (UNVERIFIED)"),
    Store("augment", f"{_STORAGE}/augment.vscode-augment", rf"{_EDITOR}/augment\.vscode-augment/(?:.*/)?([^/]+)\.json", (2,), layout=DOCUMENT, normaliser="document",
          match_mode="best-effort globalStorage scan (UNVERIFIED)"),
]


def agents(spark: SparkSession, stores: list[Store]) -> DataFrame:
    """(agent, match_mode), one row an agent, in the registry's order."""
    modes: dict[str, str] = {}
    for s in stores:
        modes[s.agent] = modes.get(s.agent) or s.match_mode
    return spark.createDataFrame(list(modes.items()), "agent string, match_mode string")


def decoded(path: Column) -> Column:
    """A file path as it is written on disk: without its scheme, ``%20`` and the like undone."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), r"\+", "%2B"))


def table(stores: list[Store]) -> Column:
    """The registry as one array of rows, a constant of the plan."""
    return F.array(*[F.struct(F.lit(s.agent).alias("agent"), F.lit(f"{s.path}$").alias("path"), F.array(*[F.lit(g) for g in s.unit]).alias("unit"), F.lit(s.dir).alias("dir"),
                              F.lit(s.layout).alias("layout"), F.lit(s.normaliser).alias("normaliser"), F.lit(s.rule).alias("rule"), F.lit(s.kind).alias("kind"))
                     for s in stores])


def any_path(stores: list[Store], layout: str) -> str:
    """One pattern for the files of a layout that hold sessions."""
    return "(?:" + "|".join(s.path for s in stores if s.layout == layout and s.kind == SESSION) + ")$"


def _matches(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath().toString() for f in found or []]


def roots(spark: SparkSession, home: str, stores: list[Store], logs: tuple[str, ...] = ()) -> list[str]:
    """The folders of ``stores`` that exist below ``home``, and the logs that do. They are hidden ones, so home itself does not show them."""
    wanted = dict.fromkeys(f"{home.rstrip('/')}/{s.root}".rstrip("/") for s in stores if s.root != LOG)
    return [r for w in [*wanted, *logs] for r in _matches(spark, w)]


def list_files(spark: SparkSession, folders: list[str], stores: list[Store]) -> DataFrame:
    """(agent, unit_id, dir, layout, normaliser, rule, kind, src, mtime) of every file below ``folders`` that the registry knows; no content is read."""
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    rows = files.select(F.col("_metadata.file_path").alias("src"), F.col("modificationTime").alias("mtime")).withColumn("at", decoded(F.col("src")))
    rows = rows.withColumn("s", F.get(F.filter(table(stores), lambda s: F.rlike(F.col("at"), s["path"])), F.lit(0))).where("s is not null")
    group = lambda g: F.call_function("regexp_extract", F.col("at"), F.col("s.path"), g)
    return rows.select("s.agent", F.array_join(F.transform("s.unit", group), "-").alias("unit_id"), F.when(F.col("s.dir") > 0, group(F.col("s.dir"))).otherwise("").alias("dir"),
                       "s.layout", "s.normaliser", "s.rule", "s.kind", "src", "mtime")
