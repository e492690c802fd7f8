"""One query per operator over the whole ``documents`` table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.llm import (
    crf,
    licenses,
    mixing,
    ngram_join,
    order_minhash,
    packing,
    periodic_runs,
    pii,
    rules,
    substring_dedup,
    super_minhash,
    token_counts,
    whitening,
)
from sparkrecon.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


def op2_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = crf.train(docs, _table(spark, folder, "labels").filter(~held_out()))
    return crf.score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= crf.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.host_rules(_table(spark, folder, "documents"))


def op4_cube_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, folder, "documents"))


def op8_pii_votes(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents"))


def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edited_neighbours(_table(spark, folder, "documents"))


def op10_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, folder, "documents"), planted=True)


def op12_super_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return super_minhash.near_duplicates(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_crf,
        op3_host_rules,
        op4_cube_mix,
        op5_best_fit_packing,
        op6_token_counts,
        op7_substring_dedup,
        op8_pii_votes,
        op9_order_minhash,
        op10_license_rules,
        op11_periodic_runs,
        op12_super_minhash,
        op13_whitening,
    )
}
