"""Registered queries: RFM, lifetime value, health, segments (CUS-4..9, SET-1, DSH-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as feat
from ledgerlens.operators import value as val
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import health_category_sql, with_ctes


# The per-customer tables are read by several bounded scalar passes
# (moments, CLV spread, min/max, exact medians) before the final projection;
# they are persisted (memory and disk) so each pass scans the customer table,
# not the line fact and its joins again.

def rfm_table(spark, sf_dir):
    return val.calculate_rfm(catalog(spark, sf_dir).order_grain()).persist()


def clv_of(rfm):
    clv, _ = val.fit_btyd(rfm)
    return clv.persist()


def clv_table(spark, sf_dir):
    return clv_of(rfm_table(spark, sf_dir))


def segmented_table(spark, sf_dir):
    return val.segment_customers(clv_table(spark, sf_dir)).persist()


@query("set1_order_grain", with_ctes("og") + """
SELECT CustomerID, OrderDate, SalesOrderID, round(TotalDue, 4) AS TotalDue FROM og""")
def set1_order_grain(spark, sf_dir):
    return finish(catalog(spark, sf_dir).order_grain(),
                  {"CustomerID": None, "OrderDate": None, "SalesOrderID": None, "TotalDue": 4})


@query("cus4_rfm", with_ctes("rfm") + """
SELECT CustomerID, Recency, Frequency, round(Monetary, 4) AS Monetary, FirstPurchase, Age,
       round(AvgOrderValue, 6) AS AvgOrderValue, round(PurchaseFrequency, 8) AS PurchaseFrequency FROM rfm""")
def cus4_rfm(spark, sf_dir):
    return finish(rfm_table(spark, sf_dir), {
        "CustomerID": None, "Recency": None, "Frequency": None, "Monetary": 4, "FirstPurchase": None,
        "Age": None, "AvgOrderValue": 6, "PurchaseFrequency": 8})


@query("cus5_clv", with_ctes("clv") + """
SELECT CustomerID, round(ExpectedFutureTransactions, 8) AS ExpectedFutureTransactions,
       round(PredictedCLV, 4) AS PredictedCLV, round(CLV_Lower, 4) AS CLV_Lower,
       round(CLV_Upper, 4) AS CLV_Upper, round(ProbAlive, 10) AS ProbAlive FROM clv""")
def cus5_clv(spark, sf_dir):
    return finish(clv_table(spark, sf_dir), {
        "CustomerID": None, "ExpectedFutureTransactions": 8, "PredictedCLV": 4, "CLV_Lower": 4,
        "CLV_Upper": 4, "ProbAlive": 10})


@query("cus6_health", with_ctes("health") + f"""
SELECT CustomerID, round(HealthScore, 6) AS HealthScore, {health_category_sql('HealthScore')} AS HealthCategory
FROM health""")
def cus6_health(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    rfm = val.calculate_rfm(cat.order_grain())
    cons = feat.order_consistency(cat.sales_lines())
    return finish(val.health_score(rfm, cons), {"CustomerID": None, "HealthScore": 6, "HealthCategory": None})


@query("cus7_segments", with_ctes("segmented") + """
SELECT s.CustomerID, s.Segment, t.SegmentSize, round(t.SegmentRevenue, 4) AS SegmentRevenue,
       round(t.SegmentAvgCLV, 4) AS SegmentAvgCLV
FROM segmented s JOIN (SELECT Segment, count(CustomerID) AS SegmentSize,
                              CAST(sum(CAST(Monetary AS DECIMAL(18,4))) AS DOUBLE) AS SegmentRevenue,
                              avg(PredictedCLV) AS SegmentAvgCLV FROM segmented GROUP BY Segment) t
ON s.Segment = t.Segment""")
def cus7_segments(spark, sf_dir):
    return finish(segmented_table(spark, sf_dir), {
        "CustomerID": None, "Segment": None, "SegmentSize": None, "SegmentRevenue": 4, "SegmentAvgCLV": 4})


@query("dsh7_clv_by_segment", with_ctes("segmented") + """
SELECT Segment, round(avg(PredictedCLV), 4) AS AvgCLV, count(CustomerID) AS Customers,
       round(CAST(sum(CAST(Monetary AS DECIMAL(18,4))) AS DOUBLE), 4) AS Revenue
FROM segmented GROUP BY Segment""")
def dsh7_clv_by_segment(spark, sf_dir):
    from ledgerlens.functions.exprs import money_sum
    seg = segmented_table(spark, sf_dir)
    out = seg.groupBy("Segment").agg(F.avg("PredictedCLV").alias("AvgCLV"),
                                     F.count("CustomerID").alias("Customers"),
                                     money_sum("Monetary").alias("Revenue"))
    return finish(out, {"Segment": None, "AvgCLV": 4, "Customers": None, "Revenue": 4})
