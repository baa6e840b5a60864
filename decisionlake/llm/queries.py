"""The registered queries of the training-data operators, one each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm import (byte_bpe, line_dedup, lm_scoring, lz_fingerprint, ngram_join, packing, pii, prefix_trie, quality_rules, simhash, token_files, twins,
                              warc, whitening)
from decisionlake.llm.common import table
from decisionlake.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn
    return add


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.token_digest(spark, path)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(table(spark, sf_dir, "documents"))


@query("op10_pii_deobfuscation")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(table(spark, sf_dir, "documents"))


@query("op8_lz_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query("op9_warc_normaliser")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "warc")
    index = warc.archive_pages(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, f"{folder}/members").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_quality_rules", twins.quality())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_line_dedup", twins.line_dedup())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return removed.withColumn("removed", F.array_join("removed", ","))


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_context_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query("op11_simhash_tiles")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


@query("op13_qdwh_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))
