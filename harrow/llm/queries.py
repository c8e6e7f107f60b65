"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrow.llm import alignment, ball_kmeans, best_fit, decontaminate, licenses, line_templates, near_dedup, packing, pii, quality, sharding, token_counts, warc
from harrow.llm.shared import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(table(spark, sf_dir, "documents")).selectExpr("doc.doc_id as doc_id", "n_lines", "n_dropped", "kept_text")


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_dedup.groups(table(spark, sf_dir, "documents"), size=3, percent=85)
    return d.selectExpr("doc_id", "n_shingles", "component_id", "doc_id <=> component_id as kept")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(table(spark, sf_dir, "documents")).drop("rule")


def op9_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_bulk_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_line_templates, op3_hyperminhash, op4_pattern_packing, op5_suffix_arrays, op6_label_propagation, op7_disclosure, op8_quality_cascade, op9_warc_members, op10_whole_tokens, op11_byte_owners, op12_bulk_best_fit, op13_ball_kmeans)}

ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.scan_sql(), "op2_line_templates": line_templates.SQL, "op5_suffix_arrays": decontaminate.SQL, "op8_quality_cascade": quality.SQL, "op9_warc_members": warc.SQL, "op13_ball_kmeans": ball_kmeans.sql()}
