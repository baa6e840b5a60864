"""Token ids as Parquet files that can be read selectively.

A folder written by :func:`write_token_files` holds

* ``tokens/`` -- one row a document, files and rows in ascending ``doc_id`` order (nulls first, equal ids by text).
  ``ids`` is a list column, dictionary encoded; ``doc_id``, ``n_tokens`` and ``local_start`` are delta encoded.
  Row groups and pages have a set size, and the page index lets a reader skip pages by ``doc_id`` and fetch
  ``n_tokens`` without touching the ids.
* ``manifest/`` -- one row a file: its documents, tokens, range of ``doc_id`` and ``base``, the ids in all files before it.

A document's start in the whole stream is ``base + local_start``: no pass over the ids and no window over the corpus is
needed to know it.

Defined results: a null text is an empty one (only the end id); rows with equal ``doc_id`` are kept, ordered by text;
an empty table gives an empty, readable folder; other columns are ignored unless named in ``metadata``, where they
are kept in one struct column and so cannot clash.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from decisionlake.llm.common import WordEncoder, slices, vocabulary, worker_encoder

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
MAX_RANGES = 10_000                       # bounds are held by the driver


def _encode(tokenizer: str, end_id: int, has_meta: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        encoder, start = worker_encoder(WordEncoder, tokenizer), 0
        for b in slices(batches):
            ids, begins = encoder.encode_column(b.column("text"))
            sizes, offsets = np.diff(begins) + 1, begins + np.arange(len(begins))           # with the end ids
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.insert(ids, begins[1:], end_id).astype(np.int32)))
            out = [b.column("doc_id"), ids, pa.array(sizes), pa.array(start + offsets[:-1])]
            start += int(offsets[-1])
            names = ["doc_id", "ids", "n_tokens", "local_start"]
            if has_meta:
                out.append(b.column("meta"))
                names.append("meta")
            yield pa.RecordBatch.from_arrays(out, names)
    return run


def _in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by ranges of ``doc_id``, in ascending order of the ranges; the bounds come from the ids alone, texts are not sampled."""
    if not isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return rows.repartitionByRange("doc_id")
    ranges = min(MAX_RANGES, max(1, rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("bounds")).first() if shares else None
    bounds = sorted(set(found.bounds or [])) if found else []
    if not bounds:
        return rows.repartitionById(1, F.lit(0))
    # two steps of about the root of all bounds each: the group of bounds, then the place inside it
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    group = below(F.lit([g[-1] for g in groups]))
    inside = F.coalesce(below(F.get(F.lit(groups), group)), F.lit(0))
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(group * width + F.greatest(inside, F.lit(0)), F.lit(len(bounds))))
    return rows.repartitionById(len(bounds) + 1, at.cast("int"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                      metadata: list[str] | None = None, row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the folder ``path``."""
    spark = docs.sparkSession
    meta = F.struct(*[F.col(c) for c in metadata]).alias("meta") if metadata else None
    rows = docs.select("doc_id", "text", *([meta] if metadata else []))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, n_tokens bigint, local_start bigint"
    if metadata:
        schema += f", meta {rows.schema['meta'].dataType.simpleString()}"
    encoded = _in_ranges(rows).sortWithinPartitions("doc_id", "text").mapInArrow(
        _encode(tokenizer or vocabulary("word_bpe_49k.json"), end_id, bool(metadata)), schema)
    (encoded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.enable.dictionary#local_start", "false").parquet(f"{path}/tokens"))
    files = (spark.read.parquet(f"{path}/tokens").select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"))
             .groupBy("file").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"),
                                  F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")))
    before = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """The documents of a folder with ``start``; only ``columns`` are read, and pages that ``where`` rules out are skipped."""
    rows = spark.read.parquet(f"{path}/tokens")
    if where is not None:
        rows = rows.where(where)
    columns = columns or rows.columns
    rows = rows.select(*columns, F.col("local_start").alias("__local"), F.col("_metadata.file_name").alias("__file"))
    return with_start(spark, path, rows).drop("__local", "__file")


def with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    bases = spark.read.parquet(f"{path}/manifest").select(F.col("file").alias("__file"), "base")
    return rows.join(bases, "__file").withColumn("start", F.col("base") + F.col("__local")).drop("base")


def _checksums(batches):
    import numpy as np
    import pyarrow as pa
    for b in batches:
        ids = b.column("ids")
        values = np.asarray(ids.flatten()).astype("<u4").tobytes()
        ends = np.asarray(ids.offsets).astype(np.int64)
        ends = (ends - ends[0]) * 4
        crc = [zlib.crc32(values[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        sizes = (ends[1:] - ends[:-1]) >> 2
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes), pa.array(crc, pa.int64()), b.column("__local"), b.column("__file")],
            ["doc_id", "n_tokens", "ids_crc32", "__local", "__file"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = spark.read.parquet(f"{path}/tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "ids", F.col("local_start").alias("__local"), F.col("_metadata.file_name").alias("__file"))
    summed = rows.mapInArrow(_checksums, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, __local bigint, __file string")
    return with_start(spark, path, summed).select("doc_id", "start", "n_tokens", "ids_crc32")
