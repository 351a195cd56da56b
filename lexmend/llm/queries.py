"""The registered queries of the operators: each applies one to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmend.llm import langid, licenses, toxicity
from lexmend.llm.common import crc_bucket, read, row_keyed
from lexmend.llm.exact_dedup import exact_groups
from lexmend.llm.line_dedup import drop_repeated_lines
from lexmend.llm.mixing import mix_plan
from lexmend.llm.oracles import ORACLES
from lexmend.llm.packing import pack
from lexmend.llm.quality_rules import quality_rules
from lexmend.llm.simhash import hex_digits, simhash_components
from lexmend.llm.span_dedup import drop_repeated_spans
from lexmend.llm.tokens import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.fit(licenses.sample_background(docs)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents"))


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id")) == 0
    model = langid.fit(langid.training_rows(docs, held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(read(spark, sf_dir, "documents")).select(*columns)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = row_keyed(read(spark, sf_dir, "documents"))
    return pack(token_counts(docs, also=(key,)), F.col("tokens"), row_col=key)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id")) == 0
    labels = toxicity.training_labels(read(spark, sf_dir, "labels"), held_out)
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
