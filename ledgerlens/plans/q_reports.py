"""Registered queries: dashboard tables, filters and top-k reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions.exprs import money_sum
from ledgerlens.operators import features as feat
from ledgerlens.operators import reports as rep
from ledgerlens.operators import value as val
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import clv_of, clv_table, rfm_table, segmented_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes

DEEP_DIVE_CUSTOMER = 1
PROFILE_SEGMENT = "Enterprise VIP"
FILTER_TERRITORY = "NATION_1"


def metrics_with_health(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    rfm = rfm_table(spark, sf_dir)
    clv = clv_of(rfm)
    health = val.health_score(rfm, feat.order_consistency(cat.sales_lines()))
    return clv.join(health.select("CustomerID", "HealthScore", "HealthCategory"), "CustomerID", "left")


@query("dsh1_kpi_row", with_ctes("rfm", "metrics_h", "segmented") + """
SELECT r.n AS TotalCustomers, CAST(r.active AS BIGINT) AS ActiveCustomers,
       round(CASE WHEN r.n > 0 THEN r.active / r.n * 100.0::DOUBLE ELSE 0.0 END, 8) AS ActivePct,
       round(coalesce(m.avg_clv, 0.0), 4) AS AvgCLV, round(coalesce(m.avg_clv, 0.0) - 3000.0, 4) AS AvgCLVDelta,
       CAST(s.at_risk AS BIGINT) AS AtRiskCustomers,
       round(CASE WHEN r.n > 0 THEN s.at_risk / r.n * 100.0::DOUBLE ELSE 0.0 END, 8) AS AtRiskPct,
       round(coalesce(m.avg_h, 0.0), 6) AS AvgHealth, round(coalesce(m.avg_h, 0.0) - 50.0, 6) AS AvgHealthDelta,
       round(CASE WHEN r.n > 0 THEN r.churned / r.n * 100.0::DOUBLE ELSE 0.0 END, 8) AS ChurnRate,
       round(CASE WHEN r.n > 0 THEN r.churned / r.n * 100.0::DOUBLE ELSE 0.0 END - 15.0, 8) AS ChurnRateDelta
FROM (SELECT count(*) AS n, count_if(Recency <= 90) AS active, count_if(Recency > 365) AS churned FROM rfm) r,
     (SELECT avg(PredictedCLV) AS avg_clv, avg(HealthScore) AS avg_h FROM metrics_h) m,
     (SELECT count_if(coalesce(regexp_matches(Segment, 'Risk|Dormant|At Risk'), false)) AS at_risk FROM segmented) s
""")
def dsh1_kpi_row(spark, sf_dir):
    rfm = rfm_table(spark, sf_dir)
    clv = clv_of(rfm)
    health = val.health_score(rfm, feat.order_consistency(catalog(spark, sf_dir).sales_lines()))
    metrics = clv.join(health.select("CustomerID", "HealthScore"), "CustomerID", "left")
    out = rep.kpi_row(rfm, metrics, val.segment_customers(clv))
    return finish(out, {"TotalCustomers": None, "ActiveCustomers": None, "ActivePct": 8, "AvgCLV": 4,
                        "AvgCLVDelta": 4, "AtRiskCustomers": None, "AtRiskPct": 8, "AvgHealth": 6,
                        "AvgHealthDelta": 6, "ChurnRate": 8, "ChurnRateDelta": 8})


@query("dsh2_customer_types", with_ctes("clv", "customers") + """
SELECT * FROM (
  SELECT 'Store' AS CustomerType, count(*) AS Customers, round(avg(c.AvgOrderValue), 4) AS AvgOrderValue
  FROM clv c JOIN customers k ON c.CustomerID = k.CustomerID WHERE k.StoreID IS NOT NULL
  UNION ALL
  SELECT 'Individual', count(*), round(avg(c.AvgOrderValue), 4)
  FROM clv c JOIN customers k ON c.CustomerID = k.CustomerID WHERE k.PersonID IS NOT NULL) WHERE Customers > 0""")
def dsh2_customer_types(spark, sf_dir):
    out = rep.customer_type_split(clv_table(spark, sf_dir), catalog(spark, sf_dir).customers())
    return finish(out, {"CustomerType": None, "Customers": None, "AvgOrderValue": 4})


@query("dsh3_quick_stats", with_ctes("rfm", "sales") + """
SELECT (SELECT count(*) FROM rfm) AS TotalCustomers, round(t, 4) AS TotalRevenue, round(t / n, 6) AS AvgLineOrderValue
FROM (SELECT CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS t, count(TotalDue) AS n FROM sales)""")
def dsh3_quick_stats(spark, sf_dir):
    out = rep.quick_stats(rfm_table(spark, sf_dir), catalog(spark, sf_dir).sales_lines())
    return finish(out, {"TotalCustomers": None, "TotalRevenue": 4, "AvgLineOrderValue": 6})


@query("dsh4_segment_distribution", with_ctes("segmented") + """
SELECT Segment, count(*) AS Customers, coalesce(regexp_matches(Segment, 'Risk|Dormant|At Risk'), false) AS IsAtRisk
FROM segmented GROUP BY Segment""")
def dsh4_segment_distribution(spark, sf_dir):
    return rep.segment_distribution(segmented_table(spark, sf_dir))


@query("dsh5_segment_profile", with_ctes("segmented") + f"""
SELECT Segment, count(*) AS Customers, round(avg(PredictedCLV), 4) AS AvgCLV,
       round(avg(Frequency), 8) AS AvgFrequency, round(avg(AvgOrderValue), 4) AS AvgOrderValue
FROM segmented WHERE Segment = '{PROFILE_SEGMENT}' GROUP BY Segment""")
def dsh5_segment_profile(spark, sf_dir):
    out = rep.segment_profile(segmented_table(spark, sf_dir), PROFILE_SEGMENT)
    return finish(out, {"Segment": None, "Customers": None, "AvgCLV": 4, "AvgFrequency": 8, "AvgOrderValue": 4})


@query("dsh6_customer_deep_dive", with_ctes("sales", "segmented") + f"""
SELECT s.CustomerID, s.SalesOrderID, s.LineNumber, s.OrderDate, s.TotalDue, s.OrderQty, s.CategoryName,
       g.Recency, g.Frequency, g.Monetary, g.Segment
FROM sales s LEFT JOIN segmented g ON s.CustomerID = g.CustomerID WHERE s.CustomerID = {DEEP_DIVE_CUSTOMER}""")
def dsh6_customer_deep_dive(spark, sf_dir):
    return rep.customer_deep_dive(catalog(spark, sf_dir).sales_lines(), segmented_table(spark, sf_dir),
                                  DEEP_DIVE_CUSTOMER).select(
        "CustomerID", "SalesOrderID", "LineNumber", "OrderDate", "TotalDue", "OrderQty", "CategoryName",
        "Recency", "Frequency", "Monetary", "Segment")


def _top_sum_sql(table: str, col: str, frac: float) -> str:
    return (f"(SELECT coalesce(sum({col}), 0.0) FROM (SELECT {col}, row_number() OVER (ORDER BY {col} DESC) AS rn "
            f"FROM {table} WHERE {col} IS NOT NULL) WHERE rn <= (SELECT CAST(floor(count({col}) * {frac}::DOUBLE) AS BIGINT) "
            f"FROM {table}))")


@query("dsh8_portfolio_value", with_ctes("clv") + f"""
SELECT round(a.total, 2) AS TotalPortfolioValue, round(t.top, 2) AS Top10PctValue,
       round(CASE WHEN a.total > 0 THEN t.top / a.total * 100.0 ELSE 0.0 END, 6) AS Top10PctShare,
       round(a.av, 4) AS AvgCustomerValue, round(a.med, 4) AS MedianCustomerValue
FROM (SELECT sum(PredictedCLV) AS total, avg(PredictedCLV) AS av, median(PredictedCLV) AS med FROM clv) a,
     (SELECT {_top_sum_sql('clv', 'PredictedCLV', 0.1)} AS top) t""")
def dsh8_portfolio_value(spark, sf_dir):
    out = rep.portfolio_value(clv_table(spark, sf_dir))
    return finish(out, {"TotalPortfolioValue": 2, "Top10PctValue": 2, "Top10PctShare": 6,
                        "AvgCustomerValue": 4, "MedianCustomerValue": 4})


@query("dsh9_concentration_curve", with_ctes("clv") + """
SELECT CustomerID, round(Monetary, 4) AS Monetary, Rank, round(CumulativeRevenue, 4) AS CumulativeRevenue,
       round(CumulativeRevenue / sum(Monetary) OVER () * 100.0, 8) AS CumulativePercent
FROM (SELECT CustomerID, Monetary, row_number() OVER (ORDER BY Monetary DESC, CustomerID) AS Rank,
             sum(Monetary) OVER (ORDER BY Monetary DESC, CustomerID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS CumulativeRevenue
      FROM clv ORDER BY Monetary DESC, CustomerID LIMIT 100)""")
def dsh9_concentration_curve(spark, sf_dir):
    out = rep.concentration_curve(clv_table(spark, sf_dir))
    return finish(out, {"CustomerID": None, "Monetary": 4, "Rank": None, "CumulativeRevenue": 4,
                        "CumulativePercent": 8})


@query("dsh10_promotion_effectiveness", with_ctes("sales") + """
SELECT DiscountCategory, round(avg(OrderQty), 8) AS AvgOrderQty, round(avg(TotalDue), 4) AS AvgOrderValue,
       count(DISTINCT SalesOrderID) AS Orders
FROM (SELECT *, CASE WHEN UnitPriceDiscount * 100.0 > 0 AND UnitPriceDiscount * 100.0 <= 10 THEN '0-10%'
                     WHEN UnitPriceDiscount * 100.0 > 10 AND UnitPriceDiscount * 100.0 <= 20 THEN '10-20%'
                     WHEN UnitPriceDiscount * 100.0 > 20 AND UnitPriceDiscount * 100.0 <= 30 THEN '20-30%'
                     WHEN UnitPriceDiscount * 100.0 > 30 AND UnitPriceDiscount * 100.0 <= 50 THEN '30-50%'
                     WHEN UnitPriceDiscount * 100.0 > 50 AND UnitPriceDiscount * 100.0 <= 100 THEN '50%+' END
                AS DiscountCategory FROM sales)
WHERE DiscountCategory IS NOT NULL GROUP BY DiscountCategory""")
def dsh10_promotion_effectiveness(spark, sf_dir):
    out = rep.promotion_effectiveness(catalog(spark, sf_dir).sales_lines())
    return finish(out, {"DiscountCategory": None, "AvgOrderQty": 8, "AvgOrderValue": 4, "Orders": None})


@query("dsh11_persuasion_quadrants", with_ctes("order_resp", "segmented") + """
SELECT CustomerID, Segment, round(TreatmentEffect, 10) AS TreatmentEffect,
       round(BaselineProbability, 10) AS BaselineProbability,
       CASE WHEN TreatmentEffect < -0.05 THEN 'Sleeping Dogs'
            WHEN TreatmentEffect < 0.08 AND BaselineProbability > 0.4 THEN 'Sure Things'
            WHEN TreatmentEffect > 0.08 AND BaselineProbability < 0.4 THEN 'Persuadables'
            ELSE 'Lost Causes' END AS Quadrant
FROM (SELECT c.CustomerID, c.Segment, c.BaselineProbability, s.TreatmentEffect
      FROM (SELECT r.CustomerID, g.Segment, avg(CASE WHEN NOT r.Promoted THEN r.Responded END) AS BaselineProbability
            FROM order_resp r JOIN segmented g ON r.CustomerID = g.CustomerID GROUP BY r.CustomerID, g.Segment) c
      LEFT JOIN (SELECT g.Segment, avg(CASE WHEN r.Promoted THEN r.Responded END)
                                   - avg(CASE WHEN NOT r.Promoted THEN r.Responded END) AS TreatmentEffect
                 FROM order_resp r JOIN segmented g ON r.CustomerID = g.CustomerID GROUP BY g.Segment) s
      ON c.Segment = s.Segment)""")
def dsh11_persuasion_quadrants(spark, sf_dir):
    resp = rep.order_responses(catalog(spark, sf_dir).sales_lines())
    out = rep.persuasion_quadrants(resp, segmented_table(spark, sf_dir))
    return finish(out, {"CustomerID": None, "Segment": None, "TreatmentEffect": 10, "BaselineProbability": 10,
                        "Quadrant": None})


@query("dsh12_promotion_targets", with_ctes("segmented") + """
SELECT Segment, count(*) AS TargetCustomers, round(avg(AvgOrderValue), 4) AS AvgOrderValue FROM segmented GROUP BY Segment""")
def dsh12_promotion_targets(spark, sf_dir):
    out = rep.promotion_targets(segmented_table(spark, sf_dir))
    return finish(out, {"Segment": None, "TargetCustomers": None, "AvgOrderValue": 4})


@query("src10_event_coercion", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(props AS DOUBLE) AS props_number,
       TRY_CAST(event_type AS DOUBLE) AS type_number FROM events""")
def src10_event_coercion(spark, sf_dir):
    """Texts as numbers where they are some, else NULL."""
    from ledgerlens.sources.extracts import coerce
    return catalog(spark, sf_dir).events().select(
        "event_id", coerce(F.get_json_object("props", "$.k"), "bigint").alias("k"),
        coerce(F.col("props"), "double").alias("props_number"), coerce(F.col("event_type"), "double").alias("type_number"))


@query("src5_territories", """
SELECT CAST(n.n_nationkey AS BIGINT) AS TerritoryID, n.n_name AS Name, CAST(n.n_regionkey AS VARCHAR) AS CountryRegionCode,
       r.r_name AS "Group", round(coalesce(s.ytd, 0.0), 2) AS SalesYTD, round(coalesce(s.ly, 0.0), 2) AS SalesLastYear
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT c.c_nationkey,
                  sum(CASE WHEN year(o.o_orderdate) = year(m.m) THEN o.o_totalprice ELSE 0.0 END) AS ytd,
                  sum(CASE WHEN year(o.o_orderdate) = year(m.m) - 1 THEN o.o_totalprice ELSE 0.0 END) AS ly
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey, (SELECT max(o_orderdate) AS m FROM orders) m
           WHERE dayofyear(o.o_orderdate) <= dayofyear(m.m) AND year(o.o_orderdate) IN (year(m.m), year(m.m) - 1)
           GROUP BY c.c_nationkey) s ON n.n_nationkey = s.c_nationkey""")
def src5_territories(spark, sf_dir):
    return finish(catalog(spark, sf_dir).territories(), {
        "TerritoryID": None, "Name": None, "CountryRegionCode": None, "Group": None, "SalesYTD": 2,
        "SalesLastYear": 2})


@query("dsh13_territory_customers", with_ctes("customers") + """
SELECT n.n_name AS Territory, count(DISTINCT k.CustomerID) AS CustomerCount
FROM customers k JOIN nation n ON k.TerritoryID = n.n_nationkey GROUP BY n.n_name""")
def dsh13_territory_customers(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    return rep.territory_customer_counts(cat.customers(), cat.territories())


@query("dsh14_territory_pick_list", with_ctes("customers") + """
SELECT DISTINCT TerritoryName FROM customers WHERE TerritoryName IS NOT NULL""")
def dsh14_territory_pick_list(spark, sf_dir):
    return rep.territory_pick_list(catalog(spark, sf_dir).customers())


@query("src3_customers", with_ctes("customers") + """SELECT * FROM customers""")
def src3_customers(spark, sf_dir):
    return catalog(spark, sf_dir).customers().select(
        "CustomerID", "PersonID", "StoreID", "TerritoryID", "AccountNumber", "Segment", "AccountBalance",
        "TerritoryName", "TerritoryGroup")


@query("src2_sales_lines", with_ctes("sales") + """
SELECT SalesOrderID, LineNumber, OrderDate, ShipDate, Status, CustomerID, ProductID, SupplierID, OrderQty,
       round(UnitPrice, 6) AS UnitPrice, UnitPriceDiscount, round(LineTotal, 6) AS LineTotal, round(TaxAmt, 4) AS TaxAmt,
       TotalDue, ProductName, SubcategoryName, CategoryName FROM sales""")
def src2_sales_lines(spark, sf_dir):
    s = catalog(spark, sf_dir).sales_lines()
    spec = {c: None for c in s.columns}
    spec.update({"UnitPrice": 6, "LineTotal": 6, "TaxAmt": 4})
    return finish(s, spec)


@query("top1_sales_by_date", with_ctes("sales") + """
SELECT SalesOrderID, LineNumber, OrderDate, CustomerID, ProductID, TotalDue FROM sales
ORDER BY OrderDate DESC, SalesOrderID, LineNumber, ProductID""")
def top1_sales_by_date(spark, sf_dir):
    return catalog(spark, sf_dir).sales_lines().select(
        "SalesOrderID", "LineNumber", "OrderDate", "CustomerID", "ProductID", "TotalDue").orderBy(
        F.desc("OrderDate"), "SalesOrderID", "LineNumber", "ProductID")


@query("top2_top5pct_revenue", with_ctes("clv") + f"""
SELECT count(*) AS Customers, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS TopK,
       round({_top_sum_sql('clv', 'Monetary', 0.05)}, 2) AS TopValue, round(sum(Monetary), 2) AS TotalValue,
       round(CASE WHEN sum(Monetary) > 0 THEN {_top_sum_sql('clv', 'Monetary', 0.05)} / sum(Monetary) * 100.0
             ELSE 0.0 END, 6) AS TopSharePct
FROM clv""")
def top2_top5pct_revenue(spark, sf_dir):
    out = rep.top_share(clv_table(spark, sf_dir), "Monetary", 0.05)
    return finish(out, {"Customers": None, "TopK": None, "TopValue": 2, "TotalValue": 2, "TopSharePct": 6})


@query("top8_product_pick_list", with_ctes("sales") + """
SELECT DISTINCT ProductName FROM sales WHERE ProductName IS NOT NULL ORDER BY ProductName LIMIT 50""")
def top8_product_pick_list(spark, sf_dir):
    return rep.product_pick_list(catalog(spark, sf_dir).sales_lines())


@query("top8_customer_pick_list", with_ctes("rfm") + """
SELECT CustomerID FROM rfm ORDER BY CustomerID LIMIT 100""")
def top8_customer_pick_list(spark, sf_dir):
    return rep.customer_pick_list(rfm_table(spark, sf_dir))


@query("flt1_territory_filter", with_ctes("rfm", "customers") + f"""
SELECT r.CustomerID, r.Recency, r.Frequency, round(r.Monetary, 4) AS Monetary FROM rfm r
WHERE r.CustomerID IN (SELECT CustomerID FROM customers WHERE TerritoryName = '{FILTER_TERRITORY}')""")
def flt1_territory_filter(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    rfm = rfm_table(spark, sf_dir)
    _, _, r = rep.apply_filters(rfm, rfm, rfm, cat.customers(), territory=FILTER_TERRITORY)
    return finish(r, {"CustomerID": None, "Recency": None, "Frequency": None, "Monetary": 4})


@query("flt2_customer_type_filter", with_ctes("clv", "customers") + """
SELECT c.CustomerID, round(c.PredictedCLV, 4) AS PredictedCLV FROM clv c
WHERE c.CustomerID IN (SELECT CustomerID FROM customers WHERE StoreID IS NOT NULL)""")
def flt2_customer_type_filter(spark, sf_dir):
    clv = clv_table(spark, sf_dir)
    m, _, _ = rep.apply_filters(clv, clv, clv, catalog(spark, sf_dir).customers(), customer_type="Store")
    return finish(m, {"CustomerID": None, "PredictedCLV": 4})


@query("flt3_segment_filter", with_ctes("segmented", "rfm") + """
SELECT r.CustomerID, r.Recency, r.Frequency FROM rfm r
WHERE r.CustomerID IN (SELECT CustomerID FROM segmented WHERE Segment = 'Occasional')""")
def flt3_segment_filter(spark, sf_dir):
    seg = segmented_table(spark, sf_dir)
    rfm = rfm_table(spark, sf_dir)
    _, _, r = rep.apply_filters(rfm, seg, rfm, catalog(spark, sf_dir).customers(), segment="Occasional")
    return r.select("CustomerID", "Recency", "Frequency")


@query("flt5_recency_flags", with_ctes("rfm") + """
SELECT CustomerID, Recency <= 90 AS IsActive, Recency > 365 AS IsChurned FROM rfm""")
def flt5_recency_flags(spark, sf_dir):
    return rfm_table(spark, sf_dir).select("CustomerID", (F.col("Recency") <= 90).alias("IsActive"),
                                           (F.col("Recency") > 365).alias("IsChurned"))


@query("flt8_date_range", with_ctes("sales") + """
SELECT CustomerID, count(*) AS Lines, round(CAST(sum(CAST(LineTotal AS DECIMAL(18,4))) AS DOUBLE), 4) AS Revenue
FROM sales WHERE OrderDate >= TIMESTAMP '2000-01-01' AND OrderDate <= TIMESTAMP '2000-12-31 23:59:59.999999'
GROUP BY CustomerID""")
def flt8_date_range(spark, sf_dir):
    lines = rep.date_range(catalog(spark, sf_dir).sales_lines(), dt.date(2000, 1, 1), dt.date(2000, 12, 31))
    out = lines.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("Lines"), money_sum("LineTotal").alias("Revenue"))
    return finish(out, {"CustomerID": None, "Lines": None, "Revenue": 4})


@query("top9_rfm_sample", with_ctes("rfm") + """
SELECT CustomerID, Recency, Frequency, round(Monetary, 4) AS Monetary FROM rfm
ORDER BY ('0x' || substr(md5(CAST(CustomerID AS VARCHAR)), 1, 8))::BIGINT, CustomerID LIMIT 500""")
def top9_rfm_sample(spark, sf_dir):
    out = rep.hash_sample(rfm_table(spark, sf_dir), "CustomerID", 500)
    return finish(out, {"CustomerID": None, "Recency": None, "Frequency": None, "Monetary": 4})


@query("src1_parametrized_sql", with_ctes("sales") + """
SELECT CustomerID, count(DISTINCT SalesOrderID) AS Orders,
       round(CAST(sum(CAST(LineTotal AS DECIMAL(18,4))) AS DOUBLE), 4) AS Revenue
FROM sales WHERE OrderDate >= TIMESTAMP '1999-01-01' AND CategoryName = 'ECONOMY' GROUP BY CustomerID""")
def src1_parametrized_sql(spark, sf_dir):
    from ledgerlens.sources.extracts import run_sql
    view = f"sales_lines_{abs(hash(sf_dir)) % 10**8}"
    catalog(spark, sf_dir).sales_lines().createOrReplaceTempView(view)
    out = run_sql(spark, f"""
        SELECT CustomerID, count(DISTINCT SalesOrderID) AS Orders,
               CAST(sum(CAST(LineTotal AS DECIMAL(18,4))) AS DOUBLE) AS Revenue
        FROM {view} WHERE OrderDate >= :since AND CategoryName = :category GROUP BY CustomerID""",
                  {"since": dt.datetime(1999, 1, 1), "category": "ECONOMY"})
    return finish(out, {"CustomerID": None, "Orders": None, "Revenue": 4})
