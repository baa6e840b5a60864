"""Rules of paths, times and search on cases the fixtures do not hold."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions.text import extract_source_paths, slugify
from decisionlake.functions.times import normalize_ts
from decisionlake.operators.attribution import attribute_table
from decisionlake.operators.freshness import last_changes
from decisionlake.operators.gates import gates_report, parse_changes, refused_changes
from decisionlake.operators.health import validate_records
from decisionlake.operators.library import search
from decisionlake.operators.resolve import Library
from decisionlake.sources.normalize import norm_markdown_chat


def paths(text):
    """A path starts a word, is no address, and has a slash or a short extension after some name."""
    out = []
    for word in re.split(r"[\s,(`]+", re.sub("`[^`]*·[^`]*`", " ", text)):
        name = re.match(r"[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)*/?", word)
        name = name.group().rstrip(".") if name and not re.match("https?://", word) else ""
        if ("/" in name or re.search(r"^.+\.[A-Za-z0-9]{1,5}$", name)) and name.rstrip("/"):
            out.append(name.rstrip("/"))
    return list(dict.fromkeys(out))


def test_source_paths(spark):
    known = {".env": [], "a..py": ["a..py"], ".a.py": [".a.py"], "..": [], "tests/": ["tests"], "see src/a.py, b.yml; c.py)": ["src/a.py", "b.yml", "c.py"],
             "https://x.org/a.py d/e": ["d/e"], "`a · b.py · 2026-01-01` x.md": ["x.md"], "v1.2.": ["v1.2"], "a.toolong b.": [], "(lib/x,lib/x)": ["lib/x"]}
    random.seed(1)
    texts = list(known) + ["".join(random.choice([".", "/", "a", "py", " ", ",", "(", "`", "·", "-", ";", "https://", ".md"]) for _ in range(random.randint(0, 14))) for _ in range(800)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract_source_paths(F.col("t")).alias("p")).collect()
    got = {texts[r.i]: list(r.p) for r in rows}
    assert {t: got[t] for t in known} == known
    assert got == {t: paths(t) for t in texts}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    def iso(text):
        try:
            t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        return (t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)).timestamp()
    texts = ["2026-06-08", "2026-06-08T01", "2026-06-08 01:02", "2026-06-08T01:02:03", "2026-06-08T01:02:03.5", "2026-06-08T01:02:03,123456789Z", "20260608T000000", "20260608T010203Z",
             "2026-W24-1", "2026W241", "2026-W24", "2026W24T10", "2020-W53-7", "2021-W53-1", "2026-W00-1", "2026-W24-9", "2026-06-08T01:02:03+05:30", "2026-06-08T01:02:03-0530", "2026-06-08T01+05",
             "2026-13-01", "2026-02-30", "2026-0608", "yesterday", "", "2026", "2026-06", "1e3", "2026-06-08T25:00"]
    want = {t: iso(t) for t in texts} | {"2026": 2026.0, "1767225600": 1767225600.0, "1767225600000": 1767225600.0, "-5": -5.0, "12.5": 12.5, "1e3": None, " 7 ": 7.0, ".5": 0.5}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in want], "t string")
        got = {r.t: None if r.s is None else r.s / 1e6 for r in df.select("t", F.unix_micros(normalize_ts(F.col("t"))).alias("s")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_search_looks_at_each_text_by_itself(spark):
    fields = {c: "" for c in config.FIELD_COLUMNS.values()}
    rows = [{"lib": "l", "rec_id": "ADR 0001", "path": "a", "type": "adr", "title": "Alpha", "body": "beta gamma", "field_text": "Accepted x"} | fields | {"status": "Accepted", "aliases": "x"}]
    records = spark.createDataFrame(rows)
    asks = ["alpha accepted", "accepted x", "x beta", "gamma", "alpha beta", "BETA GAMMA", "x accepted"]
    q = spark.createDataFrame([("l", i, t) for i, t in enumerate(asks)], "lib string, query_id int, text string")
    assert {asks[r.query_id] for r in search(records, q, 5).collect()} == {"alpha accepted", "accepted x", "gamma", "BETA GAMMA"}


def test_markdown_turns_hold_their_first_characters_only(spark):
    def stripped(lines, most):
        return "\n".join(lines).strip()[:most]
    random.seed(5)
    turns, rows = [], []
    for i in range(120):
        role = "user" if i % 2 == 0 else "assistant"
        lines = ["".join(random.choice(" ab\t") for _ in range(random.choice([0, 1, 5, 40]))) for _ in range(random.choice([1, 2, 9, 40]))]
        if role == "assistant":
            lines[0] = " x" + lines[0]
        start = len(rows) + 1
        rows += [("#### " if role == "user" else "") + x for x in lines]
        turns.append((start, role, stripped(lines, 50)))
    df = spark.createDataFrame([("a", "u", i + 1, x) for i, x in enumerate(rows)], "agent string, unit_id string, line_no long, line string").repartition(4)
    for block in (7, 1 << 16):
        got = {(r.line_no, r.role, r.text) for r in norm_markdown_chat(df, 50, block).collect()}
        assert got == set(turns)


def test_days_are_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT 'l' AS lib, 'p' AS path, timestamp_seconds(1767225600 + 3600) AS commit_ts")
        assert last_changes(df).first().last_change == dt.date(2026, 1, 1)
        assert last_changes(df.withColumn("commit_ts", F.lit("2026-01-05").cast("date"))).first().last_change == dt.date(2026, 1, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_later_record_of_a_number_is_a_finding(spark):
    rows = [{"lib": "l", "label": "ADR", "type": "adr", "number": n, "rec_id": f"ADR {n:04d}", "path": f"{n:04d}-{k}.md", "title": "t", "body": "", "field_text": "", "entity": 0}
            | {c: "" for c in config.FIELD_COLUMNS.values()} | {"status": "Accepted", "date": "2026-01-01", "decider": "d", "label": "XDR" if k == "d" else "ADR"}
            for n, ks in ((1, "abc"), (2, "d")) for k in ks]
    found = validate_records(Library.of(spark.createDataFrame(rows)), "2030-01-01").collect()
    assert sorted(r.subject for r in found if r.code == "duplicate_number") == ["0001-b.md", "0001-c.md"]
    assert [(r.subject, r.detail) for r in found if r.code == "unknown_label"] == [("0002-d.md", "XDR")]


def test_a_change_that_leaves_the_project_is_refused(spark):
    diffs = spark.createDataFrame([("l", "good", "src/a.py"), ("l", "bad", "../x.py\nsrc/a.py"), ("l", "root", "/etc/x")], "lib string, change_key string, diff string")
    refused = refused_changes(parse_changes(diffs))
    assert {r.change_key for r in refused.collect()} == {"bad", "root"}
    per_lib = spark.createDataFrame([("l", g, "pass") for g in ("validation", "integrity", "staleness", "anchoring")], "lib string, gate string, status string")
    per_change = spark.createDataFrame([("l", k, g, "pass") for k in ("good", "bad", "root") for g in ("denylist", "evidence_presence")], "lib string, change_key string, gate string, status string")
    report = {r.change_key: (r.validation, r.denylist, r.ok) for r in gates_report(diffs, per_lib, per_change, refused).collect()}
    assert report == {"good": ("pass", "pass", True), "bad": ("pass", None, False), "root": ("pass", None, False)}


def test_table_sessions_without_a_folder_count_everywhere(spark):
    sessions = spark.createDataFrame([("a", "1", "/w/p/"), ("a", "2", None), ("a", "3", ""), ("a", "4", "/w/p/sub"), ("a", "5", "/other")], "agent string, unit_id string, cwd string")
    projects = spark.createDataFrame([("/w/p",), ("/w",)], "project string")
    assert {(r.unit_id, r.project) for r in attribute_table(sessions, projects).collect()} == {("1", "/w/p"), ("2", None)}
    assert {(r.unit_id, r.project) for r in attribute_table(sessions, projects, True).collect()} == {
        ("1", "/w/p"), ("1", "/w"), ("2", None), ("4", "/w/p"), ("4", "/w")}


def test_slugs(spark):
    def slug(text):
        s = re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).strip("-")
        return (s or "untitled")[:80].strip("-")
    texts = ["Use Postgres!", "  --A__b..c  ", "", "!!!", "x" * 100, "a" * 79 + "-b" * 5, "Ünïcode ß"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", slugify(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == {t: slug(t) for t in texts}
