"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_records, bpe_automaton, chat_format, fingerprints, hard_negatives, line_dedup, lm_scoring, ngram_join, packing, phrases, quality_rules, suffix_dedup, toxicity
from .common import read_table, scratch
from .tokenizer import public_tokenizer


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.bpe_encode(read_table(spark, sf_dir, "documents"), public_tokenizer(), with_ids=False, with_text=False, digests=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"))


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "records")
    binary_records.write_records(read_table(spark, sf_dir, "documents"), public_tokenizer(), folder, end_id=0)
    return binary_records.read_records(spark, folder, ids="digest")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizer())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scoring(read_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(read_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(chat_format.EXTRA))
    return chat_format.chat_digests(chat_format.chat_format(turns))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_binary_records": op6_binary_records,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_phrases": op11_phrases,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op5_ngram_join": ngram_join.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op12_chat_format": chat_format.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
