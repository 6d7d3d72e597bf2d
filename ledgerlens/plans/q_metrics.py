"""Registered queries: customer metrics by period (MET-*), cohorts, migration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import metrics as met
from ledgerlens.operators import reports as rep
from ledgerlens.operators import value as val
from ledgerlens.operators.order_stats import collect_scalars
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import clv_table, segmented_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes

MONTH_SQL = "make_date(CAST((MonthIdx - 1) // 12 AS INTEGER), CAST((MonthIdx - 1) % 12 + 1 AS INTEGER), 1)"


@query("met1_acquisition_cost", with_ctes("cust_month") + """
SELECT m.MonthIdx, m.Month, coalesce(n.NewCustomers, 0) AS NewCustomers, 10000.0::DOUBLE AS MarketingSpend,
       CASE WHEN coalesce(n.NewCustomers, 0) = 0 THEN 'inf'::DOUBLE
            ELSE 10000.0::DOUBLE / n.NewCustomers END AS CAC
FROM (SELECT DISTINCT MonthIdx, Month FROM cust_month) m
LEFT JOIN (SELECT CohortIdx AS MonthIdx, count(*) AS NewCustomers
           FROM (SELECT CustomerID, min(MonthIdx) AS CohortIdx FROM cust_month GROUP BY CustomerID)
           GROUP BY CohortIdx) n ON m.MonthIdx = n.MonthIdx""")
def met1_acquisition_cost(spark, sf_dir):
    out = met.acquisition_cost(catalog(spark, sf_dir).sales_lines())
    return out.select("MonthIdx", "Month", F.col("NewCustomers").cast("bigint").alias("NewCustomers"),
                      "MarketingSpend", "CAC")


@query("met2_retention_rates", with_ctes("cust_month") + """
SELECT a.MonthIdx, a.Month, a.Active, coalesce(n.New, 0) AS New, coalesce(r.StartCustomers, 0) AS StartCustomers,
       round(r.RevenueStart, 4) AS RevenueStart, round(r.Expansion, 4) AS Expansion, round(r.Churned, 4) AS Churned,
       round(CASE WHEN coalesce(r.StartCustomers, 0) = 0 THEN 0.0
                  ELSE (a.Active - coalesce(n.New, 0)) / r.StartCustomers * 100.0::DOUBLE END, 8) AS RetentionRate,
       round(CASE WHEN coalesce(r.RevenueStart, 0.0) > 0
                  THEN (r.RevenueStart + r.Expansion - r.Churned) / r.RevenueStart * 100.0 ELSE 0.0 END, 8)
         AS NetRevenueRetention
FROM (SELECT MonthIdx, count(*) AS Active, min(Month) AS Month FROM cust_month GROUP BY MonthIdx) a
LEFT JOIN (SELECT CohortIdx AS MonthIdx, count(*) AS New
           FROM (SELECT CustomerID, min(MonthIdx) AS CohortIdx FROM cust_month GROUP BY CustomerID)
           GROUP BY CohortIdx) n ON a.MonthIdx = n.MonthIdx
LEFT JOIN (SELECT p.MonthIdx, count(*) AS StartCustomers, sum(p.PrevRevenue) AS RevenueStart,
                  sum(greatest(coalesce(c.Revenue, 0.0) - p.PrevRevenue, 0.0)) AS Expansion,
                  sum(greatest(p.PrevRevenue - coalesce(c.Revenue, 0.0), 0.0)) AS Churned
           FROM (SELECT CustomerID, MonthIdx + 1 AS MonthIdx, Revenue AS PrevRevenue FROM cust_month) p
           LEFT JOIN cust_month c ON p.CustomerID = c.CustomerID AND p.MonthIdx = c.MonthIdx
           GROUP BY p.MonthIdx) r ON a.MonthIdx = r.MonthIdx""")
def met2_retention_rates(spark, sf_dir):
    out = met.retention_rates(catalog(spark, sf_dir).sales_lines())
    out = out.withColumn("New", F.col("New").cast("bigint")).withColumn(
        "StartCustomers", F.col("StartCustomers").cast("bigint"))
    return finish(out, {"MonthIdx": None, "Month": None, "Active": None, "New": None, "StartCustomers": None,
                        "RevenueStart": 4, "Expansion": 4, "Churned": 4, "RetentionRate": 8,
                        "NetRevenueRetention": 8})


def _cohort_sql(measure: str, limit: str = "") -> str:
    return with_ctes("cohort_cells") + f"""
SELECT {MONTH_SQL.replace('MonthIdx', 'c.CohortIdx')} AS CohortMonth, c.Period, c.{measure},
       round(CAST(c.{measure} AS DOUBLE) * 100.0 / CAST(b.base AS DOUBLE), 8) AS Retention
FROM cohort_cells c LEFT JOIN (SELECT CohortIdx, {measure} AS base FROM cohort_cells WHERE Period = 0) b
  ON c.CohortIdx = b.CohortIdx {limit}"""


@query("met4_cohort_value_retention", _cohort_sql("Value").replace("c.Value,", "round(c.Value, 4) AS Value,"))
def met4_cohort_value_retention(spark, sf_dir):
    out = met.cohort_retention(catalog(spark, sf_dir).sales_lines(), "Value")
    return finish(out, {"CohortMonth": None, "Period": None, "Value": 4, "Retention": 8})


@query("met5_cohort_customer_retention", _cohort_sql("Customers"))
def met5_cohort_customer_retention(spark, sf_dir):
    out = met.cohort_retention(catalog(spark, sf_dir).sales_lines(), "Customers")
    return finish(out, {"CohortMonth": None, "Period": None, "Customers": None, "Retention": 8})


@query("cht12_cohort_heatmap", _cohort_sql("Customers").replace(
    "round(CAST(c.Customers AS DOUBLE) * 100.0 / CAST(b.base AS DOUBLE), 8) AS Retention",
    "round(CAST(c.Customers AS DOUBLE) * 100.0 / CAST(b.base AS DOUBLE), 1) AS Retention"))
def cht12_cohort_heatmap(spark, sf_dir):
    out = met.cohort_retention(catalog(spark, sf_dir).sales_lines(), "Customers")
    return finish(out, {"CohortMonth": None, "Period": None, "Customers": None, "Retention": 1})


# the calendar of the orders, January 1995 to August 2001
PERIODS = list(range(12 * (2001 - 1995) + 8))


@query("set5_cohort_pivot", with_ctes("cohort_cells") + f""", p AS (
SELECT {MONTH_SQL.replace('MonthIdx', 'c.CohortIdx')} AS CohortMonth, c.Period,
       round(CAST(c.Customers AS DOUBLE) * 100.0 / CAST(b.base AS DOUBLE), 8) AS Retention
FROM cohort_cells c LEFT JOIN (SELECT CohortIdx, Customers AS base FROM cohort_cells WHERE Period = 0) b
  ON c.CohortIdx = b.CohortIdx)
SELECT CohortMonth, {', '.join(f'max(CASE WHEN Period = {p} THEN Retention END) AS "{p}"' for p in PERIODS)}
FROM p GROUP BY CohortMonth""")
def set5_cohort_pivot(spark, sf_dir):
    long = met.cohort_retention(catalog(spark, sf_dir).sales_lines(), "Customers")
    wide = met.cohort_matrix(long, PERIODS)
    return finish(wide, {"CohortMonth": None, **{p: 8 for p in wide.columns[1:]}})


@query("met6_segment_migration", with_ctes("segmented", "segmented_prev") + """
SELECT PreviousSegment, CurrentSegment, Customers,
       round(Customers / sum(Customers) OVER (PARTITION BY PreviousSegment) * 100.0::DOUBLE, 8) AS Percent
FROM (SELECT p.Segment AS PreviousSegment, c.Segment AS CurrentSegment, count(*) AS Customers
      FROM segmented_prev p JOIN segmented c ON p.CustomerID = c.CustomerID GROUP BY 1, 2)""")
def met6_segment_migration(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    og = cat.order_grain()
    last = collect_scalars(og.agg(F.max("OrderDate")))[0]
    prev_ref = last - dt.timedelta(days=365)
    prev_rfm = val.calculate_rfm(og.where(F.col("OrderDate") <= F.lit(prev_ref)), reference_date=prev_ref)
    prev_clv, _ = val.fit_btyd(prev_rfm)
    prev = val.segment_customers(prev_clv)
    out = met.migration_matrix(prev, segmented_table(spark, sf_dir))
    return finish(out, {"PreviousSegment": None, "CurrentSegment": None, "Customers": None, "Percent": 8})


@query("met7_share_of_wallet", with_ctes("sales") + """
SELECT CustomerID, CategoryName, round(CustomerSpend, 4) AS CustomerSpend, round(CategoryTotal, 4) AS CategoryTotal,
       round(CASE WHEN CategoryTotal > 0 THEN CustomerSpend / CategoryTotal * 100.0 ELSE 0.0 END, 10) AS ShareOfWallet
FROM (SELECT CustomerID, CategoryName, CustomerSpend, sum(CustomerSpend) OVER (PARTITION BY CategoryName) AS CategoryTotal
      FROM (SELECT CustomerID, CategoryName, CAST(sum(CAST(LineTotal AS DECIMAL(18,4))) AS DOUBLE) AS CustomerSpend
            FROM sales WHERE CategoryName IS NOT NULL GROUP BY CustomerID, CategoryName))""")
def met7_share_of_wallet(spark, sf_dir):
    out = met.share_of_wallet(catalog(spark, sf_dir).sales_lines())
    return finish(out, {"CustomerID": None, "CategoryName": None, "CustomerSpend": 4, "CategoryTotal": 4,
                        "ShareOfWallet": 10})


@query("met8_concentration", with_ctes("clv") + """
SELECT t.k AS TopCustomers, round(t.top / t.total * 100.0, 8) AS RevenueConcentration,
       round(t.k / t.n * 100.0::DOUBLE, 8) AS CustomerConcentration,
       round(pow(t.top / t.total, 2) * 10000.0, 6) AS HerfindahlIndex
FROM (SELECT count(*) AS n, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS k, sum(Monetary) AS total,
             (SELECT sum(Monetary) FROM (SELECT Monetary, row_number() OVER (ORDER BY Monetary DESC) AS rn FROM clv)
              WHERE rn <= (SELECT CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) FROM clv)) AS top
      FROM clv) t""")
def met8_concentration(spark, sf_dir):
    out = rep.concentration_metrics(clv_table(spark, sf_dir), 0.05)
    return finish(out, {"TopCustomers": None, "RevenueConcentration": 8, "CustomerConcentration": 8,
                        "HerfindahlIndex": 6})
