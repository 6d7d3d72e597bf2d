"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

#: Rows hold whole texts: so many go to a Python worker at a time, instead of Spark's 10,000.
TEXTS_AT_ONCE = "256"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast to the given types, and nothing else.

    Columns are taken by position, so further columns whose names clash with
    these or with an operator's own names (also by case only) do no harm.  The
    session's Arrow batches are set small, which bounds what workers hold.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE)
    names = df.columns
    lower = [n.lower() for n in names]
    at = {n: names.index(n) if n in names else lower.index(n.lower()) for n in types}
    by_place = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return by_place.select(*[F.col(f"_c{at[n]}").cast(t).alias(n) for n, t in types.items()])


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder that the cluster names.

    ``write`` cuts lineage: the rows are stored as Parquet under
    ``spark.checkpoint.dir`` and read again, so a lost executor costs no
    recomputation and every reader sees the same rows.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        root = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{root}/{what}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame) -> DataFrame:
    """The columns of `documents`; n_chars is counted anew from the text."""
    return df.select("doc_id", "text", "lang", "source",
                     F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))
