"""Cases that the fixture tables do not hold."""
import json

from pyspark.sql import functions as F

from decisionlake.functions.text import literal_haystack, type_rank
from decisionlake.functions.times import first_ts
from decisionlake.operators import evals, graph, scoring
from decisionlake.operators.contains import contains_join
from decisionlake.sources import normalize


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_a_run_is_priced_by_its_own_sheet(spark):
    prices = rows(spark, "sheet string, model string, price_in double, price_out double, blended double",
                  ("old", "m", 1.0, 2.0, 1.5), ("new", "m", 10.0, 20.0, 15.0))
    runs = rows(spark, "run_id string, sheet string, model string, model_tier string, condition string, scenario_set string, has_split boolean",
                ("r1", "new", "m-large", "t", "c", "s", True), ("r2", "old", "m", "t", "c", "s", False))
    results = rows(spark, "run_id string, scenario string, status string, tok_in long, tok_out long, tok_total long",
                   ("r1", "a", "pass", 1_000_000, 1_000_000, None), ("r2", "a", "pass", None, None, 2_000_000))
    got = {r.run_id: (r.total, r.usd) for r in evals.run_cost(results, runs, prices).collect()}
    assert got == {"r1": (2_000_000, 30.0), "r2": (2_000_000, 3.0)}


def test_text_run_ids(spark):
    costs = rows(spark, "run_id string, scenario_set string, rate double, usd_pp double, gated boolean, condition string, model_tier string",
                 ("b", "s", 100.0, 1.0, False, "baseline", "opus"), ("a", "s", 100.0, 1.0, False, "baseline", "opus"), ("c", "s", 100.0, 0.5, False, "x", "haiku"))
    got = evals.value_lenses(costs).first()
    assert (got.cheap_run, got.dear_run, got.baseline_run, got.transfer_run) == ("c", "a", "a", "c")


def test_a_sample_without_answers_counts(spark):
    gold = rows(spark, "probe_id long, current_value string, replaced_value string", (1, "x", "y"))
    replies = rows(spark, "arm string, tier string, sample long, reply_id long, text string",
                   ("a", "t", 1, 1, '```json\n[{"id": "1", "current": "x", "replaced": "y"}]\n```'), ("a", "t", 2, 2, "no idea"))
    answers = rows(spark, "arm string, tier string, sample long, probe_id long, current_value string, replaced_value string", ("a", "t", 1, 1, "x", "y"))
    assert sorted(tuple(r) for r in scoring.score_answers(replies, gold).collect()) == [("a", "t", 1, 1, 1, 1), ("a", "t", 2, 0, 0, 0)]
    got = scoring.recall_stats(answers, gold, replies).first()
    assert (got.samples, got.recall_mean) == (2, 0.5)
    assert scoring.majority_vote(answers, gold, replies).first().majority == 0.0


def test_a_foreign_block_is_no_verdict(spark):
    text = 'see ```json\n{"x": 1}\n``` then ```json\n{"already_recorded_adr": "ADR 3", "created_new_adr": false}\n```'
    got = scoring.score_verdict(rows(spark, "reply_id long, scenario_kind string, needle long, text string", (1, "recorded", 3, text), (2, "recorded", 3, '```\n{"x": 1}\n```')))
    assert {r.reply_id: r.outcome for r in got.collect()} == {1: "pass", 2: "unscorable"}


def test_unfenced_answers(spark):
    got = scoring.parse_answers(rows(spark, "reply_id long, text string", (1, 'so: [ {"id": "4", "current": "c"} ] done'), (2, "[]"), (3, '[{"id": '))).collect()
    assert [(r.reply_id, r.id, r.current_value) for r in got] == [(1, "4", "c")]


def test_library_order_is_not_the_alphabet(spark):
    got = rows(spark, "t string", ("bdr",), ("zzz",), ("pdr",), ("adr",)).orderBy(type_rank(F.col("t"))).collect()
    assert [r.t for r in got] == ["adr", "pdr", "bdr", "zzz"]


def test_a_missing_field_is_no_missing_record(spark):
    records = rows(spark, "lib string, rec_id string, status string, supersedes string", ("l", "ADR 0001", "Superseded by ADR 0002", None), ("l", "ADR 0002", "Accepted", None))
    assert {r.rec_id: r.reason for r in graph._node_reasons(records).collect()} == {"ADR 0001": None, "ADR 0002": None}


def test_null_parts_stay_findable(spark):
    got = rows(spark, "a string, b string, c string", (None, "Field", None)).select(literal_haystack(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert "field" in got


def test_sessions_of_two_stores(spark):
    sessions = rows(spark, "agent string, id string", ("A", "1"), ("B", "1"))
    messages = rows(spark, "agent string, session_id string, id string, role string, content string, created string",
                    ("A", "1", "m", "user", "from a", "1"), ("B", "1", "m", "user", "from b", "1"))
    got = normalize.norm_table_chat(sessions, messages).collect()
    assert sorted((r.agent, r.text) for r in got) == [("A", "from a"), ("B", "from b")]


def test_parts_that_are_no_objects(spark):
    line = json.dumps({"role": "user", "time": {"created": 1}, "parts": [{"text": "a"}, "x", {"text": "b"}]})
    assert normalize.norm_message_dir(rows(spark, "agent string, unit_id string, src string, line string", ("A", "1", "s", line))).first().text == "a\nb"


def test_times_lie_any_number_of_payloads_deep(spark):
    deep = {"payload": {"payload": {"payload": {"payload": {"ts": "2026-06-08"}}}}}
    df = rows(spark, "line string", (json.dumps(deep),), (json.dumps({"ts": "1717804800", "payload": {"ts": "1"}}),), (json.dumps({"a": 1}),))
    got = [r[0] for r in df.select(F.unix_seconds(first_ts(F.try_parse_json("line")))).collect()]
    assert got == [1780876800, 1717804800, None]


def test_substring_join_has_no_nested_loop(spark):
    texts = rows(spark, "id long, text string", (1, "the red fox"), (2, "a fox"), (3, ""))
    needles = rows(spark, "n long, needle string", (1, "red fox"), (2, "ox"), (3, "zebra"))
    found = contains_join(texts, needles, ["id"], ["n"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (1, 2), (2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    every = contains_join(texts, rows(spark, "n long, needle string", (9, "")), ["id"], ["n"])
    assert every.count() == 3
