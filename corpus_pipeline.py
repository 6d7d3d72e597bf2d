"""Corpus cleaning: the stages of the training-data pipeline over `documents`.

Each stage takes what its predecessor kept and all but the last return the
columns of `documents`.  Rows with null or empty texts and null doc_ids pass
every stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontam, line_dedup, near_dedup, toxicity
from ledgerlens.llm.common import Scratch, documents, pick, table

RANK_FILE = "byte_bpe_50k.tiktoken"
COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned grammar scores 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts (n_chars is counted anew); every document stays."""
    return documents(line_dedup.clean_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles) the smallest doc_id stays; of repeated rows one."""
    groups = near_dedup.near_groups(docs, size=5)
    kept = groups.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_key")
    kept = Scratch(spark, "kept").write(kept.distinct())
    rows = pick(docs, **COLUMNS).withColumn("text_key", near_dedup.text_key(F.col("text")))
    chosen = rows.join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return chosen.unionByName(rows.where(F.col("doc_id").isNull())).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that benchmark windows cover to a twentieth of their words or more."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = Scratch(spark, "contaminated").write(found.where("contaminated").select("doc_id", "text_key").distinct())
    bad = bad.withColumnsRenamed({"doc_id": "bad_id", "text_key": "bad_key"})
    rows = pick(docs, **COLUMNS).withColumn("text_key", decontam.text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_key"))
    return rows.join(bad, same, "left_anti").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned 32-bit) of what is left."""
    import public_tokenizers

    coded = bpe.coded(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return coded.select(*bpe.digest_columns(), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a fitted classifier, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None
