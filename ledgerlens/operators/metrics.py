"""Customer metrics by period (MET-1..7).

The reference's metric functions take ready scalars; here the inputs are
computed per month from the line fact and the formula is applied per row.
Customer-by-month activity is one aggregation; "previous month" is an
equi-join on (customer, month - 1), not a per-customer window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import inf_div, money_sum, month_index, month_start, safe_div


def customer_months(sales: DataFrame, value_col: str = "TotalDue") -> DataFrame:
    """(CustomerID, MonthIdx, Month, Revenue) with revenue summed exactly."""
    return sales.groupBy("CustomerID", month_index(F.col("OrderDate")).alias("MonthIdx")) \
        .agg(money_sum(value_col).alias("Revenue"), F.min(month_start(F.col("OrderDate"))).alias("Month"))


def first_months(cm: DataFrame) -> DataFrame:
    return cm.groupBy("CustomerID").agg(F.min("MonthIdx").alias("CohortIdx"))


def acquisition_cost(sales: DataFrame, monthly_spend: float = 10000.0) -> DataFrame:
    """MET-1: spend / new customers per month (+Infinity when none)."""
    cm = customer_months(sales)
    months = cm.select("MonthIdx", "Month").distinct()
    new = first_months(cm).groupBy(F.col("CohortIdx").alias("MonthIdx")).agg(
        F.count(F.lit(1)).alias("NewCustomers"))
    out = months.join(new, "MonthIdx", "left").withColumn("NewCustomers", F.coalesce("NewCustomers", F.lit(0)))
    return out.withColumn("MarketingSpend", F.lit(float(monthly_spend))).withColumn(
        "CAC", inf_div(F.col("MarketingSpend"), F.col("NewCustomers")))


def retention_rates(sales: DataFrame) -> DataFrame:
    """MET-2 / MET-3 per month m (customers and revenue of month m-1 as start):
    retention = (active_m - new_m) / active_{m-1} * 100 (0 if no start);
    NRR = (start + expansion - churned) / start * 100 (0 if start <= 0),
    expansion / churned = positive / negative revenue change of the start customers."""
    cm = customer_months(sales)
    fm = first_months(cm)
    active = cm.groupBy("MonthIdx").agg(F.count(F.lit(1)).alias("Active"), F.min("Month").alias("Month"))
    new = fm.groupBy(F.col("CohortIdx").alias("MonthIdx")).agg(F.count(F.lit(1)).alias("New"))
    prev = cm.select("CustomerID", (F.col("MonthIdx") + 1).alias("MonthIdx"), F.col("Revenue").alias("PrevRevenue"))
    cur = cm.select("CustomerID", "MonthIdx", "Revenue")
    pairs = prev.join(cur, ["CustomerID", "MonthIdx"], "left")
    delta = F.coalesce(F.col("Revenue"), F.lit(0.0)) - F.col("PrevRevenue")
    rev = pairs.groupBy("MonthIdx").agg(
        F.count(F.lit(1)).alias("StartCustomers"),
        F.sum("PrevRevenue").alias("RevenueStart"),
        F.sum(F.greatest(delta, F.lit(0.0))).alias("Expansion"),
        F.sum(F.greatest(-delta, F.lit(0.0))).alias("Churned"))
    out = active.join(new, "MonthIdx", "left").join(rev, "MonthIdx", "left").fillna(
        0, subset=["New", "StartCustomers"])
    retention = F.when(F.col("StartCustomers") == 0, F.lit(0.0)).otherwise(
        (F.col("Active") - F.col("New")) / F.col("StartCustomers") * F.lit(100.0))
    nrr = F.when(F.coalesce(F.col("RevenueStart"), F.lit(0.0)) > 0,
                 (F.col("RevenueStart") + F.col("Expansion") - F.col("Churned")) / F.col("RevenueStart") * 100.0
                 ).otherwise(F.lit(0.0))
    return out.withColumn("RetentionRate", retention).withColumn("NetRevenueRetention", nrr)


def cohort_table(sales: DataFrame, value_col: str = "TotalDue") -> DataFrame:
    """AGG-9: per (cohort month, period) exact value sum and distinct customers.

    The cohort (first order month) is an aggregate joined back on
    CustomerID; distinct customers per cell come from the (customer, month)
    table, so no line-level distinct aggregation is needed."""
    cm = customer_months(sales, value_col)
    cells = cm.join(first_months(cm), "CustomerID", "inner").withColumn(
        "Period", F.col("MonthIdx") - F.col("CohortIdx"))
    return cells.groupBy("CohortIdx", "Period").agg(
        F.sum("Revenue").alias("Value"), F.count(F.lit(1)).alias("Customers"))


def cohort_retention(sales: DataFrame, measure: str = "Value") -> DataFrame:
    """MET-4 (measure='Value') / MET-5 (measure='Customers'): each cell divided
    by the cohort's period-0 cell x 100 (SET-6), long form.  Cohorts are
    months, so the per-cohort divisor table is bounded by the calendar."""
    cells = cohort_table(sales)
    base = cells.where(F.col("Period") == 0).select("CohortIdx", F.col(measure).alias("_base"))
    out = cells.join(F.broadcast(base), "CohortIdx", "left").withColumn(
        "Retention", safe_div(F.col(measure).cast("double") * 100.0, F.col("_base").cast("double")))
    out = out.withColumn("CohortMonth", F.make_date(
        ((F.col("CohortIdx") - 1) / 12).cast("int"), ((F.col("CohortIdx") - 1) % 12 + 1).cast("int"), F.lit(1)))
    return out.select("CohortMonth", "Period", F.col(measure).alias(measure), "Retention")


def cohort_matrix(long: DataFrame, periods: list[int] | None = None) -> DataFrame:
    """SET-5: pivot the long cohort table to one column per period (months, so
    bounded by the calendar); missing cells stay NULL.  ``periods`` fixes the
    columns; without it they are the periods that occur."""
    if periods is None:
        periods = sorted(r["Period"] for r in long.select("Period").distinct().collect())
    return long.groupBy("CohortMonth").agg(*[F.max(F.when(F.col("Period") == p, F.col("Retention"))).alias(str(p)) for p in periods])


def migration_matrix(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """MET-6 / AGG-10: crosstab of previous x current segment, row-normalised %."""
    pairs = prev.select("CustomerID", F.col("Segment").alias("PreviousSegment")).join(
        cur.select("CustomerID", F.col("Segment").alias("CurrentSegment")), "CustomerID", "inner")
    counts = pairs.groupBy("PreviousSegment", "CurrentSegment").agg(F.count(F.lit(1)).alias("Customers"))
    row_total = F.sum("Customers").over(Window.partitionBy("PreviousSegment"))
    return counts.withColumn("Percent", F.col("Customers") / row_total * F.lit(100.0))


def share_of_wallet(sales: DataFrame) -> DataFrame:
    """MET-7: customer spend in a category / category total x 100 (0 if total <= 0).
    Line value = LineTotal.  The category total is a groupBy joined back
    (categories are few; AQE broadcasts the small side)."""
    cc = sales.where(F.col("CategoryName").isNotNull()).groupBy("CustomerID", "CategoryName").agg(
        money_sum("LineTotal").alias("CustomerSpend"))
    tot = cc.groupBy("CategoryName").agg(F.sum("CustomerSpend").alias("CategoryTotal"))
    out = cc.join(tot, "CategoryName", "inner")
    return out.withColumn("ShareOfWallet", F.when(F.col("CategoryTotal") > 0,
                                                 F.col("CustomerSpend") / F.col("CategoryTotal") * 100.0)
                          .otherwise(F.lit(0.0)))
