"""Exact dedup by skew-safe combining of digest groups (native).

Three stages, each of which compares whole normalised texts, never digests
alone: every map task combines its own copies (partial aggregation), the
copies of one digest meet within one of ``salts`` groups, and the salt
winners of a digest (at most ``salts`` rows) are combined globally.  Documents
find their winner again by (digest, salt), so a text that makes up a third of
the corpus is spread over ``salts`` tasks in every stage.

Null text counts as empty; a long text is one row, hashed and compared whole.
Texts are equal when identical after lower-casing
A-Z.  Of equal texts the row with the largest doc_id stays (null is smallest);
rows that repeat the winning doc_id are all marked ``kept``.  Should two
different texts ever share a SHA-256, the job stops with an error instead of
merging them.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_az, pick

SALTS = 64


def digested(docs: DataFrame, salts: int) -> DataFrame:
    d = pick(docs, doc_id="bigint", text="string")
    d = d.select("doc_id", lower_az(F.coalesce("text", F.lit(""))).alias("norm"))
    return d.select("doc_id", "norm", F.sha2("norm", 256).alias("digest"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digested(docs, salts)
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    same_text, same_digest = Window.partitionBy("digest", "norm"), Window.partitionBy("digest")
    winners = (
        salted.repartition("digest")
        .select("digest", "salt", F.max("top").over(same_text).alias("keep_id"),
                F.sum("n").over(same_text).alias("group_size"), F.sum("n").over(same_digest).alias("of_digest"))
        .select("digest", "salt", "keep_id",
                F.when(F.col("of_digest") == F.col("group_size"), F.col("group_size"))
                .otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint"))
                .alias("group_size"))
    )
    return (
        rows.select("doc_id", "digest", "salt").join(winners, ["digest", "salt"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                F.col("digest").alias("text_sha256"))
    )


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
