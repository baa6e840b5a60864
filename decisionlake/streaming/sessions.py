"""Session totals and the run fold as streams.

Both keep their state as a keyed table in hash buckets (``sources.buckets``): a micro-batch reads and rewrites the buckets of
the keys it carries and nothing else, whatever the history. A batch is known by the stream's own id, which its
checkpoint keeps over restarts, and its number, so a replayed batch counts nothing twice, an idle one writes nothing, and a new
checkpoint over an old table goes on from that table. Rows may come late and in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from decisionlake.operators.runs import fold_runs
from decisionlake.sources.buckets import BUCKETS, bucket_of, merge_buckets, newest, read_buckets

SESSION = ["agent", "unit_id"]


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps over restarts."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def _started(stream: DataFrame, each, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _totals(old: DataFrame | None, new: DataFrame) -> DataFrame:
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy(*SESSION).agg(F.sum("kept").alias("kept"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def stream_sessions(stream: DataFrame, base: str, checkpoint: str, available_now: bool = True, n: int = BUCKETS) -> StreamingQuery:
    """Messages (agent, unit_id, ts) -> running totals of each session, in the table at ``base``."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("kept"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        merge_buckets(part, base, SESSION, _totals, _stream_id(batch.sparkSession, checkpoint), batch_id, n)
    return _started(stream, merge, checkpoint, available_now)


def latest_sessions(spark: SparkSession, base: str) -> DataFrame | None:
    """The totals after the last finished micro-batch; None before the first."""
    return read_buckets(spark, base)


def stream_runs(events: DataFrame, base: str, checkpoint: str, available_now: bool = True, n: int = BUCKETS) -> StreamingQuery:
    """Run events -> the state of each run, in the table at ``base/runs``.

    An append after a close is refused by ``seq``, also where the close came in another batch, before or after it; so the
    events of a run must be known again when it gets more. They lie in ``base/events``, appended bucket by bucket; a batch reads
    the buckets of its own runs only and folds these runs only. The fold combines map-side, so one run may be of any size.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, source = batch.sparkSession, _stream_id(batch.sparkSession, checkpoint)
        if batch.isEmpty():
            return
        name = f"{source}-{batch_id:012d}"                       # a replay writes the same folder again
        batch.withColumn("bucket", bucket_of(["run_id"], n)).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/events/batch={name}")
        every = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", StringType()), StructField("bucket", IntegerType())])).parquet(f"{base}/events")
        mine = every.where(F.col("batch") == name)
        touched = [r["bucket"] for r in mine.select("bucket").distinct().collect()]     # at most n
        events_of = every.where(F.col("bucket").isin(touched)).drop("batch", "bucket").join(mine.select("run_id").distinct(), "run_id", "left_semi")

        def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if old is None else old.join(new.select("run_id"), "run_id", "left_anti").unionByName(new)
        merge_buckets(fold_runs(events_of), f"{base}/runs", ["run_id"], replaced, source, batch_id, n)
    return _started(events, fold, checkpoint, available_now)


def streamed_runs(spark: SparkSession, base: str) -> DataFrame | None:
    """The runs' states after the last finished micro-batch; None before the first."""
    return read_buckets(spark, f"{base}/runs")


def table_version(spark: SparkSession, base: str) -> int | None:
    """Which version of a streamed table is current."""
    last = newest(spark, base)
    return last.version if last else None
