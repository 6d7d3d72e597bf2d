"""Registered queries: customer, behavioural and survival feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as feat
from ledgerlens.operators import value as val
from ledgerlens.operators.trends import theil_sen_trends
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import rfm_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes
from ledgerlens.session import stored
from ledgerlens.sources.tables import LINE_ORDER

CUS1_SPEC = {
    "CustomerID": None, "NumOrders": None, "FirstOrder": None, "LastOrder": None, "OrderDateStd": 3,
    "TotalSpend": 4, "AvgOrderValue": 6, "SpendStd": 4, "MinOrder": 4, "MaxOrder": 4, "TotalItems": 4,
    "AvgItemsPerOrder": 8, "AvgDiscount": 8, "UniqueProducts": None, "RecencyDays": None,
    "CustomerLifetimeDays": None, "PurchaseFrequency": 8, "AvgDaysBetweenOrders": 8, "SpendVelocity": 6,
    "OrderConsistency": 6, "VolumeTrend": 8, "CV_Spend": 8, "DiscountDependency": 6, "HighDiscountBuyer": None,
    "ProductEntropy": 8, "CategoryPenetration": None, "TerritoryID": None, "PersonID": None, "StoreID": None,
    "IsIndividual": None, "IsStore": None,
}


def _sql_select(spec, alias="f"):
    return ", ".join(f"round({alias}.{c}, {d}) AS {c}" if d is not None else f"{alias}.{c}" for c, d in spec.items())


@query("cus1_customer_features", with_ctes("cust_feats", "customers") + f"""
SELECT {_sql_select({k: v for k, v in CUS1_SPEC.items() if k not in ('TerritoryID', 'PersonID', 'StoreID', 'IsIndividual', 'IsStore')})},
       k.TerritoryID, k.PersonID, k.StoreID,
       CAST(k.PersonID IS NOT NULL AS INTEGER) AS IsIndividual, CAST(k.StoreID IS NOT NULL AS INTEGER) AS IsStore
FROM cust_feats f LEFT JOIN customers k ON f.CustomerID = k.CustomerID""")
def cus1_customer_features(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    return finish(feat.engineer_customer_features(cat.sales_lines(), cat.customers()), CUS1_SPEC)


@query("cus2_volume_trend", with_ctes("trends") + """
SELECT CustomerID, round(VolumeTrend, 8) AS VolumeTrend FROM trends""")
def cus2_volume_trend(spark, sf_dir):
    sales = catalog(spark, sf_dir).sales_lines()
    return finish(theil_sen_trends(sales, {"VolumeTrend": "OrderQty"}, list(LINE_ORDER)),
                  {"CustomerID": None, "VolumeTrend": 8})


CUS3_SPEC = {"CustomerID": None, "Frequency": None, "Monetary_Total": 4, "Monetary_Avg": 6, "Monetary_Std": 4,
             "TotalQty": 4, "Discount_Avg": 8, "Discount_Std": 8, "LifetimeDays": None, "Monetary_CV": 8,
             "ItemsPerOrder": 8, "WeekendRatio": 8, "SpendTrend": 6}


@query("cus3_behavioral_features", with_ctes("trends") + f"""
SELECT {_sql_select(CUS3_SPEC, 'b')} FROM (
  SELECT a.*, a.Monetary_Std / a.Monetary_Avg AS Monetary_CV, a.TotalQty / a.Frequency AS ItemsPerOrder,
         t.SpendTrend
  FROM (SELECT CustomerID, count(DISTINCT SalesOrderID) AS Frequency,
               CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS Monetary_Total,
               CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) / count(TotalDue) AS Monetary_Avg,
               stddev_samp(TotalDue) AS Monetary_Std, sum(OrderQty) AS TotalQty,
               avg(UnitPriceDiscount) AS Discount_Avg, stddev_samp(UnitPriceDiscount) AS Discount_Std,
               datesub('day', min(OrderDate), max(OrderDate)) AS LifetimeDays,
               avg(CASE WHEN isodow(OrderDate) IN (6, 7) THEN 1 ELSE 0 END) AS WeekendRatio
        FROM sales GROUP BY CustomerID) a LEFT JOIN trends t ON a.CustomerID = t.CustomerID) b""")
def cus3_behavioral_features(spark, sf_dir):
    return finish(feat.behavioral_features(catalog(spark, sf_dir).sales_lines()), CUS3_SPEC)


CHN1_SPEC = {"CustomerID": None, "LastOrderDate": None, "DaysSinceLastOrder": None, "Churned": None,
             "HighChurn": None, "Time": None, **{k: v for k, v in CUS1_SPEC.items()
                                                 if k not in ("CustomerID", "TerritoryID", "PersonID", "StoreID",
                                                              "IsIndividual", "IsStore")}}


@query("chn1_survival_features", with_ctes("cust_feats") + f"""
SELECT {_sql_select(CHN1_SPEC)} FROM (
  SELECT f.*, f.LastOrder AS LastOrderDate, f.RecencyDays AS DaysSinceLastOrder,
         CAST(f.RecencyDays > 365 AS INTEGER) AS Churned, CAST(f.RecencyDays > 730 AS INTEGER) AS HighChurn,
         f.RecencyDays AS Time
  FROM cust_feats f) f""")
def chn1_survival_features(spark, sf_dir):
    return finish(feat.survival_features(catalog(spark, sf_dir).sales_lines()), CHN1_SPEC)


@query("win1_order_consistency", with_ctes("consistency") + """
SELECT CustomerID, round(OrderConsistency, 6) AS OrderConsistency FROM consistency""")
def win1_order_consistency(spark, sf_dir):
    return finish(feat.order_consistency(catalog(spark, sf_dir).sales_lines()),
                  {"CustomerID": None, "OrderConsistency": 6})


@query("agg4_category_entropy", with_ctes("mix") + """
SELECT CustomerID, round(ProductEntropy, 8) AS ProductEntropy, CategoryPenetration FROM mix""")
def agg4_category_entropy(spark, sf_dir):
    return finish(feat.category_mix(catalog(spark, sf_dir).sales_lines()),
                  {"CustomerID": None, "ProductEntropy": 8, "CategoryPenetration": None})


def _qcut_sql(c: str, labels: list[str]) -> str:
    return (f"CASE WHEN {c} >= q.{c}0 AND {c} <= q.{c}1 THEN '{labels[0]}' "
            f"WHEN {c} > q.{c}1 AND {c} <= q.{c}2 THEN '{labels[1]}' "
            f"WHEN {c} > q.{c}2 AND {c} <= q.{c}3 THEN '{labels[2]}' "
            f"WHEN {c} > q.{c}3 AND {c} <= q.{c}4 THEN '{labels[3]}' END")


def _quantiles_sql(c: str) -> str:
    return ", ".join(f"quantile_cont({c}, {p}) AS {c}{i}" for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))


# Edges are distinct on this data, so the qcut branch applies; the rank
# fallback is covered by unit tests.
@query("cus8_quartiles", with_ctes("rfm") + f"""
SELECT CustomerID,
       {_qcut_sql('Recency', val.RECENCY_QUARTILE_LABELS)} AS R_Quartile,
       {_qcut_sql('Frequency', val.VALUE_QUARTILE_LABELS)} AS F_Quartile,
       {_qcut_sql('Monetary', val.VALUE_QUARTILE_LABELS)} AS M_Quartile
FROM rfm, (SELECT {_quantiles_sql('Recency')}, {_quantiles_sql('Frequency')}, {_quantiles_sql('Monetary')} FROM rfm) q""")
def cus8_quartiles(spark, sf_dir):
    out = val.quartile_labels(rfm_table(spark, sf_dir))
    return out.select("CustomerID", "R_Quartile", "F_Quartile", "M_Quartile")


def _rank_cut_sql(c: str, labels: list[str]) -> str:
    edge = lambda i: f"({c}_lo + ({c}_hi - {c}_lo) * {i} / 4)"
    return (f"CASE WHEN {c}_p > {c}_lo - ({c}_hi - {c}_lo) * 0.001::DOUBLE AND {c}_p <= {edge(1)} THEN '{labels[0]}' "
            + " ".join(f"WHEN {c}_p > {edge(i)} AND {c}_p <= {edge(i + 1)} THEN '{labels[i]}'" for i in (1, 2, 3)) + " END")


_RANKED = ", ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / CAST(count(*) OVER () AS DOUBLE) AS {c}_p"
                    for c in ("Recency", "Frequency", "Monetary"))
_ENDS = ", ".join(f"min({c}_p) OVER () AS {c}_lo, max({c}_p) OVER () AS {c}_hi" for c in ("Recency", "Frequency", "Monetary"))


# Orders of one year: most customers have one to three, so edges repeat and all columns are cut by rank.
@query("prj5_rank_quartiles", with_ctes("og") + f""",
m AS (SELECT max(OrderDate) AS ref FROM og),
y AS (SELECT og.* FROM og, m WHERE OrderDate > ref - INTERVAL 365 DAY),
r AS (SELECT CustomerID, datesub('day', max(OrderDate), (SELECT ref FROM m)) AS Recency, count(DISTINCT SalesOrderID) AS Frequency,
             CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS Monetary FROM y GROUP BY CustomerID),
p AS (SELECT CustomerID, {_RANKED} FROM r), e AS (SELECT *, {_ENDS} FROM p)
SELECT CustomerID, {_rank_cut_sql('Recency', val.RECENCY_QUARTILE_LABELS)} AS R_Quartile,
       {_rank_cut_sql('Frequency', val.VALUE_QUARTILE_LABELS)} AS F_Quartile,
       {_rank_cut_sql('Monetary', val.VALUE_QUARTILE_LABELS)} AS M_Quartile FROM e""")
def prj5_rank_quartiles(spark, sf_dir):
    og = catalog(spark, sf_dir).order_grain()
    ref = og.agg(F.max("OrderDate")).scalar()
    year = og.where(F.col("OrderDate") > ref - F.expr("INTERVAL 365 DAY"))
    out = val.quartile_labels(stored(val.calculate_rfm(year), "rfm"))
    return out.select("CustomerID", "R_Quartile", "F_Quartile", "M_Quartile")


@query("cus9_health_scalar", with_ctes("health") + """
SELECT CustomerID, round(least(greatest(0.4 * (rs * 100.0) + 0.3 * (fs * 100.0) + 0.3 * (ms * 100.0), 0.0), 100.0), 6)
       AS ScalarHealth FROM health""")
def cus9_health_scalar(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    h = val.health_score(val.calculate_rfm(cat.order_grain()), feat.order_consistency(cat.sales_lines()))
    out = h.select("CustomerID", val.scalar_health_score(
        F.col("Recency_Score") * 100.0, F.col("Frequency_Score") * 100.0,
        F.col("Monetary_Score") * 100.0).alias("ScalarHealth"))
    return finish(out, {"CustomerID": None, "ScalarHealth": 6})
