"""The corpus pipeline over ``documents``: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame. All but the
last return the columns of ``documents``. Any column may be null, and rows and doc_ids may be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from gridloom.llm.common import DOCUMENT_COLUMNS, free, mark, materialise, read_table
from gridloom.llm.tokenizer import public_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host fails, go."""
    return quality_rules.keep_documents(docs.select(*DOCUMENT_COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut out; a document left without a line goes."""
    return line_dedup.remove_runs(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the first."""
    return ngram_join.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier too are cut out."""
    return suffix_dedup.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_stage),
    ("suffix_array_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: Packing's result (token ids of a tokenizer) cannot be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written as Parquet and read again, and the tables behind it go."""
    docs, begun = read_table(spark, sf_dir, "documents"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
            free(spark, begun)
    return docs
