"""A corpus pipeline of five stages, each a table written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrow.llm import decontaminate, line_templates, near_dedup, packing, quality
from harrow.llm.shared import discard, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a rule rejects; null and empty texts have no words and go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that recur in another one kept; a null text stays null, a text of nothing else becomes empty."""
    return line_templates.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8); rows without words or doc_id stay."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold ten words in a row of an item of benchmark, or a whole shorter item; a null text holds none, and of repeated rows all stay or all go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of 4096 tokens; a null text is the end token alone, repeated rows are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: Shingles' hashes, suffix arrays and token ids have no SQL here; tests/llm holds the stages against brute force.
ORACLE_SQL: dict[str, str] | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and read again; a stage's table goes when the next one is written. Texts of any length, repeated rows and empty tables pass through; extra columns of documents go along to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before)
    return docs
