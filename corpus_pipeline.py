"""From raw documents to packed sequences: quality, near duplicates, personal data, mix, packing.

Every stage works on all rows of the stage before, and its decisions take effect: rejected documents
go, one document of each group of near duplicates stays, personal data is replaced, rows are
dropped or repeated to meet the target weights, and what is left is tokenised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrecon.llm import crf, mixing, ngram_join, packing, pii
from sparkrecon.llm.queries import held_out, tokenizer_file
from sparkrecon.plans.lineage import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(~held_out())
    return crf.good_documents(docs, crf.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # fitted models and tokenisers cannot be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
