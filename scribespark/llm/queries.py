"""The queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribespark.llm import alignment, dart_minhash, exact_dedup, html_text, language, licenses, line_dedup, mixing, packing, pii, quality, token_file, whitening
from scribespark.llm.shared import documents, shared_dir

WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 2
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 1
PIECES = "piece_bpe_32k.model"


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_file.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(WORD_BPE), "word", WORD_BPE_END)
    return token_file.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    counts = [_of_kind(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document lies in source/language/thousands/hundreds of its id."""
    parts = (F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), F.col("doc_id"))
    path = F.concat_ws("/", *(F.coalesce(x.cast("string"), F.lit("none")) for x in parts))
    return licenses.scan(documents(spark, sf_dir), path)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find(documents(spark, sf_dir)).drop("row")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return quality.judge(documents(spark, sf_dir)).select(*columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), "byte", BYTE_BPE_END)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(documents(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_html_text, op3_pii, op4_exact_dedup, op5_licenses, op6_line_dedup, op7_quality, op8_mixing, op9_packing, op10_dart_minhash, op11_language, op12_whitening, op13_alignment)}

#: DuckDB SQL by query, where SQL can say it.
ORACLES: dict[str, str] = {"op4_exact_dedup": exact_dedup.sql()}
