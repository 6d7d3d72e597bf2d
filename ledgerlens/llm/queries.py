"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, decontam, exact_dedup, license_scan, line_dedup, lm_score, near_dedup, ngram_join, pii, ranked_search, repeats, toxicity, vector_codes
from ledgerlens.llm.common import table

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), 4).drop("text_key")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"), 4, 85)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_lm_score, op3_near_dedup, op4_decontamination, op5_byte_bpe, op6_suffix_dedup, op7_line_dedup, op8_pii, op9_license_scan, op10_toxicity,
                                  op11_ranked_search, op12_ngram_join, op13_vector_codes)}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_lm_score": lm_score.SQL,
    "op3_near_dedup": near_dedup.sql(4),
    "op4_decontamination": decontam.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_license_scan": license_scan.sql(),
    "op11_ranked_search": ranked_search.SQL,
    "op12_ngram_join": ngram_join.sql(4, 85),
    "op13_vector_codes": vector_codes.sql(),
}
