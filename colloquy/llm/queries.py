"""Registered queries of the operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import ann, byte_bpe, class_lm, licenses, line_dedup, mixing, oracles, periodic, quality, secrets, simhash, substring_dedup, token_files, whitening
from colloquy.llm.store import reachable, shared_folder

Run = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder)
    return token_files.read_checksums(spark, folder)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.judged(_table(spark, sf_dir, "documents")).select("row.doc_id", *columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "row.source", "n_tokens", "epoch", "block", "before_tokens", "budget_tokens")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduped(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return found.select("row.doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduped(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.usable(_table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, 20)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.crc32(F.col("doc_id").cast("string"))
    found = periodic.runs_in_texts(_table(spark, sf_dir, "documents"), tile_by=mark)
    columns = "doc_id n_runs start length period exponent_milli runs_sha256".split()
    return found.select(*columns, F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Run] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_class_lm, op3_token_files, op4_byte_bpe, op5_simhash_dedup, op6_quality_rules, op7_source_mixing, op8_line_dedup, op9_substring_dedup, op10_nearest_neighbours, op11_license_scan, op12_periodic_runs, op13_embedding_whitening)
}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
