"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), ``docs`` being its predecessor's rows
written as Parquet and read again. All but the last return the columns of
documents. No SQL states the whole: the classifier is trained and the packing
tokenised; the tests hold every stage against a plain version of itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.lines import deduplicated
from gridloom.llm.minhash import near_deduplicated
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import accepted
from gridloom.llm.queries import tokenizer
from gridloom.llm.scratch import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; documents left without a word go."""
    return deduplicated(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return near_deduplicated(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens and their places in sequences."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("mixing sources", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
