"""Session helpers: the shared folder for lineage cuts and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may go without it; a folder of its own is made there once per session.
    """
    conf = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="decisionlake-")
        spark.conf.set(_KEY, conf)
    return conf


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks a core, where Spark's own setting starts a task a folder, which costs more than its listing.

    What is found is not kept beyond its reader: by default up to 250 MB of file entries stay with the driver until the session ends.
    """
    key, kept = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize"
    old, size = spark.conf.get(key), spark.conf.get(kept)
    spark.conf.set(key, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(kept, "0")
    try:
        yield
    finally:
        spark.conf.set(key, old)
        spark.conf.set(kept, size)


UNPACKED = 8                              # bytes of rows in memory for one in a file of a cut table, as a rule


@contextmanager
def unpacked(spark: SparkSession) -> Iterator[None]:
    """Files count for what their rows take in memory, where the session does not say otherwise. By the size of its packed files a table
    that takes hundreds of MB of the driver may pass for a small one and be broadcast."""
    key = "spark.sql.sources.fileCompressionFactor"
    old = spark.conf.get(key)
    spark.conf.set(key, str(max(float(old), UNPACKED)))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """A cut table goes when the session's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of an iteration: writes a table to the shared folder and reads it back.

    Survives lost executors, and the next plan starts from the table's real size instead of an estimate
    multiplied over every earlier join.
    """
    spark = df.sparkSession
    path = staging_path(spark, "cut")
    df.write.parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_unpacked(df: DataFrame) -> DataFrame:
    """A cut whose joins are planned by the unpacked size of the tables they read."""
    with unpacked(df.sparkSession):
        return cut(df)
