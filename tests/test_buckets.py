"""Keyed tables in buckets, the ledger, and the streams that keep them."""
import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from decisionlake.operators import incremental as inc
from decisionlake.operators.runs import fold_runs
from decisionlake.sources import buckets as bk
from decisionlake.streaming import sessions as st

T0 = dt.datetime(2026, 1, 1)
EVENT = "run_id string, seq long, event string, checker_result string, outcome string, note string, artifact string"


def files(base) -> dict[str, float]:
    return {str(p): p.stat().st_mtime for p in pathlib.Path(base).rglob("*.parquet")}


def entries(spark, rows):
    return spark.createDataFrame([(a, u, T0, T0 + dt.timedelta(minutes=m), "src", at) for a, u, m, at in rows],
                                 "agent string, unit_id string, first_ts timestamp, last_ts timestamp, src string, processed_at int")


def ledger(spark, base):
    return {(r.agent, r.unit_id): r.processed_at for r in inc.read_ledger(spark, base).collect()}


def test_ledger_rewrites_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path / "ledger")
    assert inc.read_ledger(spark, base) is None
    inc.publish_ledger(entries(spark, [("a", str(i), 0, 1) for i in range(200)]), base, "first")
    before = files(base)
    inc.publish_ledger(entries(spark, [("a", "7", 5, 2)]), base, "second")
    after = files(base)
    assert set(before) - set(after) == set() and len({pathlib.Path(p).parent for p in set(after) - set(before)}) == 1
    assert ledger(spark, base) == {("a", str(i)): 2 if i == 7 else 1 for i in range(200)}
    # the same run again, or a run without sessions, writes nothing
    inc.publish_ledger(entries(spark, [("a", "8", 9, 3)]), base, "second")
    inc.publish_ledger(entries(spark, []), base, "third")
    assert files(base) == after and bk.newest(spark, base).version == 1
    # what two versions back alone used is gone
    inc.publish_ledger(entries(spark, [("a", str(i), 9, 4) for i in range(200)]), base, "fourth")
    inc.publish_ledger(entries(spark, [("b", "1", 9, 5)]), base, "fifth")
    assert not any("version=0" in p or "version=1/" in p for p in files(base))
    assert len(ledger(spark, base)) == 201 and len(list(pathlib.Path(base, "_announced").iterdir())) == bk.KEEP


def test_a_half_written_version_is_not_seen_and_is_replaced(spark, tmp_path):
    base = str(tmp_path / "ledger")
    inc.publish_ledger(entries(spark, [("a", "1", 0, 1)]), base, "first")
    entries(spark, [("a", "1", 0, 99)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{base}/version=1")      # stopped before it was announced
    assert ledger(spark, base) == {("a", "1"): 1}
    inc.publish_ledger(entries(spark, [("a", "2", 0, 2)]), base, "second")
    assert ledger(spark, base) == {("a", "1"): 1, ("a", "2"): 2}


def messages(spark, folder, name, rows):
    df = spark.createDataFrame([(a, u, T0 + dt.timedelta(minutes=m)) for a, u, m in rows], "agent string, unit_id string, ts timestamp")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    for p in pathlib.Path(folder, name).glob("*.parquet"):
        p.rename(pathlib.Path(folder, f"{name}-{p.name}"))
    return df.schema


def test_session_stream_over_restarts_and_a_new_checkpoint(spark, tmp_path):
    inbox, base = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    schema = messages(spark, inbox, "m1", [("a", str(i), 0) for i in range(100)])

    def run(checkpoint, folder=inbox):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*.parquet")
        st.stream_sessions(stream, base, str(tmp_path / checkpoint)).awaitTermination()
        return {r.unit_id: (r.kept, r.last_ts) for r in st.latest_sessions(spark, base).collect()}

    assert run("c1") == {str(i): (1, T0) for i in range(100)}
    before = files(base)
    assert len(run("c1")) == 100 and files(base) == before           # idle: nothing new
    messages(spark, inbox, "m2", [("a", "5", -30), ("a", "5", 10)])    # one session, one of its rows late
    got = run("c1")
    assert got["5"] == (3, T0 + dt.timedelta(minutes=10)) and got["6"] == (1, T0)
    new = {pathlib.Path(p).parent for p in set(files(base)) - set(before)}
    assert len(new) == 1                                      # one session, one bucket
    (tmp_path / "in2").mkdir()
    messages(spark, tmp_path / "in2", "m3", [("a", "5", 20), ("b", "1", 0)])
    got = run("c2", tmp_path / "in2")                         # a new checkpoint goes on from the table
    assert got["5"][0] == 4 and got["6"][0] == 1 and got["1"][0] in (1, 2) and len(st.latest_sessions(spark, base).collect()) == 101


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_run_stream_equals_batch_after_any_split(spark, tmp_path, parts):
    random.seed(parts)
    rows = []
    for run in range(12):
        for seq in range(random.randint(1, 9)):
            event = random.choice(["open", "append", "append", "close"])
            rows.append((f"r{run}", seq, event, random.choice([None, "pass", "fail"]), random.choice([None, "success"]), f"n{seq}", random.choice([None, "a", "b"])))
    random.shuffle(rows)
    inbox, base = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    events = spark.createDataFrame(rows, EVENT)
    want = {tuple(r) for r in fold_runs(events).collect()}
    for k in range(parts):                                    # every part a batch of its own, in no order of seq
        spark.createDataFrame(rows[k::parts], EVENT).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        for p in (tmp_path / f"p{k}").glob("*.parquet"):
            p.rename(inbox / f"{k}-{p.name}")
        stream = spark.readStream.schema(events.schema).parquet(str(inbox))
        st.stream_runs(stream, base, str(tmp_path / "c"), n=4).awaitTermination()
    assert {tuple(r) for r in st.streamed_runs(spark, base).collect()} == want
    version = st.table_version(spark, f"{base}/runs")
    st.stream_runs(spark.readStream.schema(events.schema).parquet(str(inbox)), base, str(tmp_path / "c"), n=4).awaitTermination()
    assert st.table_version(spark, f"{base}/runs") == version
