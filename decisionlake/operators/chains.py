"""From extracted decisions to supersession chains, and the corrections applied before that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.functions import text as tx
from decisionlake.operators.blocks import neighbours, ranked


def assemble_chains(extractions: DataFrame, dimensions: list[str]) -> DataFrame:
    """(entity, dimension, value, d) -> one row per link of each (entity, dimension) chain.

    Entities are grouped on their lower-cased, blank-collapsed text and shown in title case; a value
    keeps its earliest date; links are ordered by (date, value); the last one is Accepted.
    """
    links = (extractions
             .select(F.lower(tx.collapse_blanks(F.col("entity"))).alias("entity_key"),
                     F.lower(F.trim("dimension")).alias("dimension"), F.trim("value").alias("value"),
                     F.col("d").alias("date"))
             .where(F.col("dimension").isin(dimensions))
             .groupBy("entity_key", "dimension", "value").agg(F.min("date").alias("date")))
    placed = ranked(links, ["entity_key", "dimension"], ["date", "value"], "pos", F.col("date"))
    linked = neighbours(placed, ["entity_key", "dimension"], "pos", ["value"])
    return linked.select(
        "entity_key", tx.title_case(F.col("entity_key")).alias("entity"), "dimension", "pos", "value", "date",
        F.when(F.col("next_value").isNull(), "Accepted").otherwise("Superseded").alias("status"),
        F.col("next_value").alias("superseded_by"), F.col("prev_value").alias("supersedes"))


def assign_numbers(drafts: DataFrame, counters: DataFrame, key: str = "type", order: str = "draft_id",
                   spread: int = 1 << 20) -> DataFrame:
    """Consecutive numbers per type after ``max(existing, counter)``: adds ``number``.

    ``counters`` is (type, last_number), possibly several rows per type. ``order`` is a numeric draft
    order; it is cut into buckets so that no type is numbered inside one task.
    """
    last = counters.groupBy(key).agg(F.max("last_number").alias("last_number"))
    placed = ranked(drafts, [key], [order], "__pos", F.expr(f"`{order}` div {spread}"))
    return (placed.join(last, key, "left")
            .withColumn("number", F.coalesce("last_number", F.lit(0)) + F.col("__pos"))
            .drop("__pos", "last_number"))


def selfcheck_apply(extractions: DataFrame, fixes: DataFrame, dimensions: list[str]) -> DataFrame:
    """Chunk-scoped corrections of extracted rows.

    extractions (chunk, entity, dimension, value, d); fixes (chunk, entity, dimension, value, d, drop,
    missing, corrected_value, corrected_d, seq). The last fix of a row wins. A row goes only when every
    extraction of it, over all chunks, was dropped; missing rows are added when they are new.
    """
    key = ["entity", "dimension", "value", "d"]
    norm = lambda df: (df.withColumn("entity", F.trim("entity")).withColumn("dimension", F.trim("dimension"))
                       .withColumn("value", F.trim("value")))
    rows = norm(extractions).withColumn("k_dim", F.lower("dimension"))
    fx = norm(fixes).withColumn("k_dim", F.lower("dimension"))
    edits = (fx.where("not coalesce(missing, false) and entity <> ''")
             .groupBy("chunk", "entity", "k_dim", "value", "d")
             .agg(F.max_by(F.struct("drop", "corrected_value", "corrected_d"), "seq").alias("fix")))
    keyed = rows.join(edits, ["chunk", "entity", "k_dim", "value", "d"], "left")
    dropped = F.coalesce(F.col("fix.drop"), F.lit(False))
    # a dropped (chunk, row) counts once however often the chunk repeats it, as the reference counts keys
    per_chunk = keyed.groupBy("chunk", "entity", "k_dim", "value", "d").agg(
        F.count(F.lit(1)).alias("n"), F.max(dropped).alias("dropped"))
    votes = per_chunk.groupBy("entity", "k_dim", "value", "d").agg(
        F.sum("n").alias("copies"), F.sum(F.col("dropped").cast("int")).alias("drops"))
    doomed = votes.where("drops >= copies").select("entity", "k_dim", "value", "d", F.lit(True).alias("doomed"))
    kept = (keyed.join(doomed, ["entity", "k_dim", "value", "d"], "left")
            .where(~(dropped & F.coalesce("doomed", F.lit(False)))))
    edit = ~dropped & F.col("fix").isNotNull()
    corrected = kept.select(
        "entity", "dimension",
        F.when(edit & (F.coalesce("fix.corrected_value", F.lit("")) != ""), F.trim("fix.corrected_value")).otherwise(F.col("value")).alias("value"),
        F.when(edit & F.col("fix.corrected_d").isNotNull(), F.col("fix.corrected_d")).otherwise(F.col("d")).alias("d"))
    added = (fx.where("missing").where(F.col("k_dim").isin(dimensions))
             .select("entity", F.col("k_dim").alias("dimension"), "value", "d").distinct()
             .join(corrected.select("entity", F.lower("dimension").alias("dimension"), "value", "d"), key, "left_anti"))
    return corrected.unionByName(added)


def chunk_checkpoint(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunk rows still to be worked: their (chunk_id, params, hash of the rows) is not in ``done``.

    chunks (chunk_id, params, row_text). The hash of a chunk is order free: a sum and an xor of 64-bit
    row hashes next to the row count, so a chunk of any size is folded by partial aggregation.
    """
    hashed = chunk_hashes(chunks)
    todo = hashed.join(done.select("chunk_id", "params", "rows_hash"), ["chunk_id", "params", "rows_hash"], "left_anti")
    return todo


def chunk_hashes(chunks: DataFrame) -> DataFrame:
    h = F.xxhash64("row_text")
    return chunks.groupBy("chunk_id", "params").agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"),
                           F.sum(h.cast("decimal(38,0)")).cast("string")), 256).alias("rows_hash"),
        F.count(F.lit(1)).alias("n_rows"))
