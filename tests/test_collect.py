"""The registry and the composed job on a home folder as agents leave it."""
import hashlib
import json
import pathlib

import pytest

from decisionlake.operators import collect as co
from decisionlake.operators import incremental as inc
from decisionlake.sources import registry as reg
from decisionlake.sources import transcripts as tr

PROJECT = "/w/my proj+x"
ENC, BARE = "-w-my-proj-x", "w-my-proj-x"
EDITOR = "Library/Application Support/Code/User/globalStorage"
TURNS = [("user", "What now?"), ("assistant", "This.")]


def lines(*rows) -> str:
    return "".join(json.dumps(r) + "\n" for r in rows)


def nested(**more):
    return [{"type": r, "timestamp": f"2026-01-0{i + 1}T00:00:00Z", "message": {"role": r, "content": [{"type": "text", "text": t}]}, **more} for i, (r, t) in enumerate(TURNS)]


def flat(**more):
    return [{"role": r, "content": t, "timestamp": f"2026-01-0{i + 1}T00:00:00Z", **more} for i, (r, t) in enumerate(TURNS)]


def write(home, path, text):
    p = pathlib.Path(home, path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


@pytest.fixture
def home(tmp_path):
    h = tmp_path / "home"
    seed = [{"id": str(i), "timestamp": f"2026-01-0{i + 1}T00:00:00Z", "type": "gemini" if r == "assistant" else r, "content": [{"text": t}]} for i, (r, t) in enumerate(TURNS)]
    write(h, f".claude/projects/{ENC}/s1.jsonl", lines(*nested()))
    write(h, f".claude/projects/{ENC}-sub/s2.jsonl", lines(*nested()))
    write(h, ".claude/projects/-other/s3.jsonl", lines(*nested()))
    write(h, ".codex/sessions/2026/01/rollout-a.jsonl", lines({"type": "session_meta", "payload": {"cwd": PROJECT}}, *nested()))
    write(h, ".codex/sessions/rollout-b.jsonl", lines(*nested()))
    write(h, ".codex/sessions/notes.jsonl", lines(*nested(cwd=PROJECT)))
    write(h, f".factory/sessions/{ENC}/f1.jsonl", lines({"type": "session_start", "id": "x"}, *nested()))
    write(h, ".factory/sessions/loose.jsonl", lines(*nested()))
    write(h, ".hermes/sessions/h1.jsonl", lines(*flat(), {"role": "tool", "content": f"cd {PROJECT}"}))
    write(h, ".hermes/sessions/session_h2.json", json.dumps({"session_start": "2026-01-01T00:00:00Z", "messages": [{"role": r, "content": t} for r, t in TURNS] + [{"role": "system", "content": PROJECT}]}))
    write(h, ".hermes/sessions/request_dump_1.json", json.dumps({"request": PROJECT}))
    write(h, f".cursor/projects/{BARE}/agent-transcripts/deep/c1.jsonl", lines(*[{"role": r, "message": {"content": [{"type": "text", "text": t}]}} for r, t in TURNS]))
    write(h, ".gemini/projects.json", json.dumps({"projects": {PROJECT + "/": "mapped"}}))
    write(h, ".gemini/tmp/mapped/chats/g1.jsonl", lines({"sessionId": "x", "projectHash": "none"}, *seed))
    write(h, ".gemini/tmp/my proj+x/chats/g2.jsonl", lines({"sessionId": "x"}, {"$set": {"messages": seed}}))
    write(h, ".gemini/tmp/0abc/chats/g3.jsonl", lines({"projectHash": hashlib.sha256(PROJECT.encode()).hexdigest()}, *seed))
    write(h, ".gemini/tmp/0abc/chats/g4.jsonl", lines({"projectHash": "none"}, *seed))
    write(h, ".gemini/tmp/elsewhere/chats/g5.jsonl", lines({"projectHash": "none"}, *seed))
    write(h, ".qwen/tmp/mapped/chats/q1.jsonl", lines({"sessionId": "x"}, *seed))       # the map is gemini's
    for i, (r, t) in enumerate(TURNS):
        write(h, f".local/share/opencode/storage/message/ses1/msg_{i}.json", json.dumps({"role": r, "time": {"created": 1767225600000 + i}, "path": {"cwd": PROJECT}, "summary": {"body": t}}))
    for agent, ext in (("cline", "saoudrizwan.claude-dev"), ("roo", "rooveterinaryinc.roo-cline")):
        for task in ("t1", "t2"):
            write(h, f"{EDITOR}/{ext}/tasks/{task}/api_conversation_history.json", json.dumps(
                [{"role": r, "content": [{"type": "text", "text": f"{t} {PROJECT if task == 't1' else ''}"}]} for r, t in TURNS]))
    write(h, ".continue/sessions/sessions.json", json.dumps([PROJECT]))
    write(h, ".continue/sessions/k1.json", json.dumps({"history": [{"message": {"role": r, "content": t}} for r, t in TURNS], "workspaceDirectory": PROJECT}))
    write(h, "Library/Application Support/Claude/local-agent-mode-sessions/x/l1.jsonl", lines(*nested(cwd=PROJECT)))
    write(h, "Library/Application Support/Claude/local-agent-mode-sessions/x/audit.jsonl", lines(*nested(cwd=PROJECT)))
    write(h, f"{PROJECT[1:]}/aider.chat.history.md", "# aider chat started at 2026\n\n#### What now?\n\nThis.\n\n> echo\n")
    write(h, ".local/share/goose/sessions/o1.jsonl", lines({"type": "session", "cwd": PROJECT}, *flat()))
    write(h, ".local/share/goose/sessions/o2.jsonl", lines(*flat()))
    write(h, "README.md", "not a store")
    return h


def run(spark, home, tmp_path, name, **options):
    projects = spark.createDataFrame([(PROJECT,), (f"{home}{PROJECT}",), ("/w/none/",)], "project string")
    return co.collect(spark, str(home), projects, str(tmp_path / f"out-{name}"), str(tmp_path / "ledger"), name, 1,
                      logs=(f"{home}{PROJECT}/aider.chat.history.md", f"{home}/none/aider.chat.history.md"), **options)


def test_every_store_finds_its_project(spark, home, tmp_path):
    done = run(spark, home, tmp_path, "one")
    found = {(r.agent, r.unit_id): r.kept for r in done.sessions.where(f"project = '{PROJECT}'").collect()}
    assert found == {k: 2 for k in [
        ("claude", "s1"), ("codex", "rollout-a"), ("factory", "f1"), ("hermes", "h1"), ("hermes", "session_h2"), ("cursor", "c1"), ("gemini", "g1"), ("gemini", "g2"),
        ("gemini", "g3"), ("gemini", "g4"), ("opencode", "ses1"), ("cline", "Code-t1"), ("roo", "Code-t1"), ("continue", "k1"), ("claude-agent", "l1"), ("goose", "o1")]}
    assert {(r.agent, r.unit_id.rsplit("/", 1)[-1]) for r in done.sessions.where(f"project = '{home}{PROJECT}'").collect()} == {("aider", "my proj+x"), ("gemini", "g2")}
    cov = {(r.project, r.agent): (r.sessions, r.messages, r.skipped_sessions) for r in done.coverage.collect()}
    assert len(cov) == 3 * len({s.agent for s in reg.STORES}) and cov[PROJECT, "gemini"] == (4, 8, 0) and cov["/w/none", "claude"] == (0, 0, 0)
    # counted while writing, and once more from what was written
    per_agent = {a: sum(v[0] for (_, b), v in cov.items() if a == b) for a in done.totals}
    assert {a: t["sessions"] for a, t in done.totals.items()} == per_agent and done.totals["gemini"]["messages"] == 10
    written = spark.read.parquet(done.messages_path)
    assert {(r.agent, r["count"]) for r in written.groupBy("agent").count().collect() if r.agent in ("gemini", "aider", "opencode")} == {("gemini", 8), ("aider", 2), ("opencode", 2)}
    gaps = {r.agent: r for r in done.gaps.collect()}
    assert (gaps["codex"].sessions_without_cwd, gaps["goose"].sessions_without_cwd, gaps["factory"].flat_files, gaps["hermes"].dumps_excluded, gaps["continue"].index_files) == (1, 1, 1, 1, 1)


def test_runs_after_the_first_emit_what_went_on(spark, home, tmp_path):
    first = run(spark, home, tmp_path, "one", include_subdirs=True, since="2026-01-02")
    assert ("claude", "s2") in {(r.agent, r.unit_id) for r in first.sessions.collect()}
    n = first.sessions.count()
    path = home / f".claude/projects/{ENC}/s1.jsonl"
    path.write_text(path.read_text() + lines({"type": "user", "timestamp": "2026-02-01T00:00:00Z", "message": {"role": "user", "content": "More"}}))
    second = run(spark, home, tmp_path, "two", include_subdirs=True, since="2026-01-02")
    assert [(r.agent, r.unit_id, r.kept) for r in second.sessions.collect()] == [("claude", "s1", 3)]
    assert sum(r.skipped_sessions for r in second.coverage.collect()) == n - 1
    assert inc.read_ledger(spark, str(tmp_path / "ledger")).count() == n
    assert run(spark, home, tmp_path, "three", include_subdirs=True, since="2026-01-02", reprocess=True).sessions.count() == n


@pytest.mark.parametrize("split", ["64k", "1m", "128m"])
def test_line_numbers_are_dense_at_any_split(spark, tmp_path, split):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, n in (("a", 9000), ("b", 3), ("c", 1)):
        (folder / f"{name}.jsonl").write_text("".join(f"{name}{i} {'x' * (i % 90)}\n" for i in range(1, n + 1)))
    (folder / "empty.jsonl").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = tr.read_transcripts(spark, str(folder), "x").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 9004 and all(r.line.startswith(f"{r.unit_id}{r.line_no} ") for r in rows)


def test_units_by_directory(spark, tmp_path):
    for task in ("t1", "t2"):
        write(tmp_path, f"tasks/{task}/history.json", "[]")
    rows = tr.read_transcripts(spark, str(tmp_path), "x", "document", r"/tasks/([^/]+)/[^/]+$").collect()
    assert {r.unit_id for r in rows} == {"t1", "t2"}
