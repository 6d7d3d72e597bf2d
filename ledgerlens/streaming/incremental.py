"""Structured Streaming form of the RFM aggregate (CUS-4).

The batch operators cover a cached load.  For sources that keep appending
order lines (files landing in a folder), the same per-customer aggregate runs
incrementally: ``readStream`` over the order-grain files, a streaming
``groupBy`` whose state is the running (last order, distinct orders, monetary,
first order) per customer.  Each trigger appends the customers that changed to
a table in shared storage (update mode, one folder per batch, so a repeated
batch overwrites itself); ``latest_state`` takes each customer's last row.
Recency and age are derived at read time against the latest order date, as
the batch operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import MONEY

ORDER_GRAIN_SCHEMA = T.StructType([
    T.StructField("CustomerID", T.LongType()), T.StructField("OrderDate", T.TimestampType()),
    T.StructField("SalesOrderID", T.LongType()), T.StructField("TotalDue", T.DoubleType())])


def rfm_state_stream(spark: SparkSession, path: str, watermark: str) -> DataFrame:
    """Streaming per-customer RFM state from order-grain parquet files.

    Orders are de-duplicated on SalesOrderID within the watermark, which
    bounds the de-duplication state.
    """
    src = spark.readStream.schema(ORDER_GRAIN_SCHEMA).parquet(path)
    src = src.withWatermark("OrderDate", watermark).dropDuplicatesWithinWatermark(["SalesOrderID"])
    return src.groupBy("CustomerID").agg(
        F.max("OrderDate").alias("LastOrder"), F.count(F.lit(1)).alias("Frequency"),
        F.sum(F.col("TotalDue").cast(MONEY)).cast("double").alias("Monetary"),
        F.min("OrderDate").alias("FirstPurchase"))


def start_rfm_stream(spark: SparkSession, path: str, table: str, checkpoint: str, watermark: str):
    """Start the stream into the folder ``table``; table and checkpoint are in
    shared storage, so a restarted driver resumes."""
    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return (rfm_state_stream(spark, path, watermark).writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).start())


def latest_state(spark: SparkSession, table: str) -> DataFrame:
    """Each customer's state after the last batch that changed it."""
    cols = ["LastOrder", "Frequency", "Monetary", "FirstPurchase"]
    rows = spark.read.option("basePath", table).parquet(table)
    return rows.groupBy("CustomerID").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("CustomerID", "s.*")


def rfm_from_state(state: DataFrame) -> DataFrame:
    """Recency / Age / AOV / PurchaseFrequency from the streaming state."""
    from ledgerlens.functions.exprs import inf_div, safe_div, whole_days
    ref = state.agg(F.max("LastOrder")).collect()[0][0]
    r = F.lit(ref).cast("timestamp")
    return state.select(
        "CustomerID", whole_days(F.col("LastOrder"), r).alias("Recency"), "Frequency", "Monetary",
        "FirstPurchase", whole_days(F.col("FirstPurchase"), r).alias("Age"),
        safe_div(F.col("Monetary"), F.col("Frequency")).alias("AvgOrderValue"),
        (inf_div(F.col("Frequency"), whole_days(F.col("FirstPurchase"), r)) * F.lit(365.0)).alias("PurchaseFrequency"))
