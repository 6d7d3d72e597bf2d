"""Customer feature tables (CUS-1, CUS-3) and the survival table (CHN-1).

The narrow line columns are stored once, a customer's lines side by side, and
every aggregate reads them, so the line fact and its joins are computed one
time.  Everything per customer is produced by aggregations keyed on CustomerID
(partial aggregation first: a task's part of the stored lines holds whole
customers, so about one row for each customer is shuffled, and a customer
holding a large share of the lines, whose lines are dealt over several parts,
is pre-reduced in every map task).
The only ordered computation, the interval consistency, runs over ranges of
(customer, date) whose states merge, so neither a hot customer nor dates with
times of day gather anything in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import is_weekend, money_sum, safe_div, whole_days
from ledgerlens.operators.trends import theil_sen_trends
from ledgerlens.session import stored
from ledgerlens.sources.tables import LINE_ORDER

# Fixed values (must equal the reference for equal results) -------------
INCOME_MIDPOINTS = {
    "0-30000": 15000, "30001-60000": 45000, "60001-100000": 80000,
    "100001-150000": 125000, "150001+": 200000,
}
ENTROPY_EPS = 1e-10
HIGH_DISCOUNT = 0.1
# Lines that are tied up to the quantity have the same one: what follows orders no quantities.
QTY_ORDER = LINE_ORDER[:LINE_ORDER.index("OrderQty") + 1]
# -----------------------------------------------------------------------


def order_consistency(sales: DataFrame) -> DataFrame:
    """WIN-1: sample std of day intervals between a customer's consecutive
    lines (sorted by date), for customers with at least 3 lines, else 0.

    Lines on the same date contribute zero intervals, so the interval
    multiset is (lines - distinct dates) zeros plus the gaps between
    consecutive distinct dates.
    """
    per_date = sales.groupBy("CustomerID", "OrderDate").agg(F.count(F.lit(1)).alias("c"))
    states = gap_states(per_date)
    m = F.col("n") - 1
    var = (F.col("q") - F.col("s") * F.col("s") / m) / (m - 1)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return states.select("CustomerID", F.when(F.col("n") >= 3, std).otherwise(F.lit(0.0)).alias("OrderConsistency"))


def gap_states(per_date: DataFrame, key: str = "CustomerID", date: str = "OrderDate", num_partitions: int | None = None) -> DataFrame:
    """key, n, s, q: the summed counts ``c`` of a key's distinct dates, and the
    sums of the day gaps between consecutive dates and of their squares.

    Rows are range partitioned by (key, date).  A range holds one state (first,
    last, n, s, q) for each of its keys, and a key's states, at most one per
    range, merge in order: the gap between two ranges is that of the dates
    where they meet.
    """
    n_parts = num_partitions or int(per_date.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = per_date.where(F.col(date).isNotNull()).repartitionByRange(n_parts, key, date).withColumn("_range", F.spark_partition_id())
    before = F.lag(date).over(Window.partitionBy("_range", key).orderBy(date))  # one range's dates of a key
    gap = F.coalesce(whole_days(before, F.col(date)).cast("double"), F.lit(0.0))
    states = stored(dated, "dates").withColumn("_gap", gap).groupBy(key, "_range").agg(
        F.min(date).alias("first"), F.max(date).alias("last"), F.sum("c").alias("n"),
        F.sum("_gap").alias("s"), F.sum(F.col("_gap") * F.col("_gap")).alias("q"))
    ordered = states.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_range", "first", "last", "n", "s", "q"))).alias("x"))

    def merged(acc, x):
        between = whole_days(acc["last"], x["first"]).cast("double")
        return F.struct(x["last"].alias("last"), (acc["n"] + x["n"]).alias("n"), (acc["s"] + x["s"] + between).alias("s"),
                        (acc["q"] + x["q"] + between * between).alias("q"))

    head = F.col("x")[0]
    start = F.struct(head["last"].alias("last"), head["n"].alias("n"), head["s"].alias("s"), head["q"].alias("q"))
    total = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), start, merged)
    return ordered.select(key, total.alias("t")).select(key, "t.n", "t.s", "t.q")


def category_mix(sales: DataFrame) -> DataFrame:
    """AGG-4 / AGG-5: Shannon entropy of the category quantity mix and the
    number of categories bought.  NULL categories are left out; a zero total
    gives NULL entropy.  The window is over one customer's categories only."""
    mix = (sales.where(F.col("CategoryName").isNotNull())
           .groupBy("CustomerID", "CategoryName").agg(F.sum("OrderQty").alias("q")))
    total = F.sum("q").over(Window.partitionBy("CustomerID"))
    p = safe_div(F.col("q"), total)
    return (mix.withColumn("p", p)
            .groupBy("CustomerID").agg(
                (-F.sum(F.col("p") * F.ln(F.col("p") + F.lit(ENTROPY_EPS)))).alias("ProductEntropy"),
                F.count(F.lit(1)).alias("CategoryPenetration")))


def customer_order(lines: DataFrame) -> DataFrame:
    """The lines dealt out by customer, many lines of a customer over several partitions, and sorted."""
    return lines.hint("rebalance", "CustomerID").sortWithinPartitions("CustomerID")


def engineer_customer_features(sales: DataFrame, customers: DataFrame | None = None,
                               demographics: DataFrame | None = None,
                               with_trend: bool = True) -> DataFrame:
    """CUS-1: the customer feature table (line grain, reference parity)."""
    # the columns of the order side by side, which packs the lines of an order well
    columns = dict.fromkeys(["CustomerID", "OrderDate", "SalesOrderID", "TotalDue", "CategoryName", "UnitPriceDiscount", *QTY_ORDER])
    sales = stored(sales.select(*[c for c in columns if c in sales.columns]), "joined")  # the joins' shuffles go before the next one
    sales = stored(customer_order(sales), "lines")
    agg = sales.groupBy("CustomerID").agg(
        F.min("OrderDate").alias("FirstOrder"),
        F.max("OrderDate").alias("LastOrder"),
        F.stddev_samp(F.unix_micros(F.col("OrderDate").cast("timestamp")) / F.lit(1e6)).alias("OrderDateStd"),
        money_sum("TotalDue").alias("TotalSpend"),
        F.count("TotalDue").alias("_n_total"),
        F.stddev_samp("TotalDue").alias("SpendStd"),
        F.min("TotalDue").alias("MinOrder"),
        F.max("TotalDue").alias("MaxOrder"),
        F.sum("OrderQty").alias("TotalItems"),
        F.avg("OrderQty").alias("AvgItemsPerOrder"),
        F.avg("UnitPriceDiscount").alias("AvgDiscount"),
    )
    # apart from the other aggregates, whose states would go along with every distinct value
    distinct = {"NumOrders": "SalesOrderID", "UniqueProducts": "ProductID"}
    if with_trend:
        trend = theil_sen_trends(sales, {"VolumeTrend": "OrderQty"}, list(QTY_ORDER), distinct=distinct)
        nobody = sales.where(F.col("CustomerID").isNull())  # lines of no customer have counts but no trend
        agg = agg.join(trend, on="CustomerID", how="left").withColumns({
            out: F.coalesce(out, nobody.agg(F.countDistinct(c)).scalar()) for out, c in distinct.items()})
    else:
        counts = sales.groupBy(F.col("CustomerID").alias("_customer")).agg(*[F.countDistinct(c).alias(out) for out, c in distinct.items()])
        agg = agg.join(counts, F.col("CustomerID").eqNullSafe(F.col("_customer"))).drop("_customer")
    ref = sales.agg(F.max("OrderDate").cast("timestamp")).scalar()
    lifetime = F.greatest(whole_days(F.col("FirstOrder"), F.col("LastOrder")), F.lit(1))
    feats = agg.withColumn("AvgOrderValue", safe_div(F.col("TotalSpend"), F.col("_n_total"))).drop("_n_total")
    feats = feats.withColumns({
        "RecencyDays": whole_days(F.col("LastOrder"), ref),
        "CustomerLifetimeDays": lifetime,
    }).withColumns({
        "PurchaseFrequency": F.col("NumOrders") / F.col("CustomerLifetimeDays") * F.lit(30.0),
        "AvgDaysBetweenOrders": F.col("CustomerLifetimeDays") / F.col("NumOrders"),
        "SpendVelocity": F.col("TotalSpend") / F.col("CustomerLifetimeDays") * F.lit(30.0),
    })
    feats = feats.join(order_consistency(sales), on="CustomerID", how="left") \
        .withColumn("OrderConsistency", F.coalesce("OrderConsistency", F.lit(0.0)))
    feats = feats.withColumns({
        "CV_Spend": F.coalesce(safe_div(F.col("SpendStd"), F.col("AvgOrderValue")), F.lit(0.0)),
        "DiscountDependency": F.col("AvgDiscount") * F.lit(100.0),
        "HighDiscountBuyer": (F.col("AvgDiscount") > F.lit(HIGH_DISCOUNT)).cast("int"),
    })
    mix = category_mix(sales)
    feats = feats.join(mix, on="CustomerID", how="left") \
        .withColumn("CategoryPenetration", F.coalesce("CategoryPenetration", F.lit(0)).cast("bigint"))
    if customers is not None:
        feats = feats.join(customers.select("CustomerID", "TerritoryID", "PersonID", "StoreID"),
                           on="CustomerID", how="left").withColumns({
            "IsIndividual": F.col("PersonID").isNotNull().cast("int"),
            "IsStore": F.col("StoreID").isNotNull().cast("int"),
        })
        if demographics is not None:
            feats = feats.join(demographics, feats.PersonID == demographics.BusinessEntityID, "left")
            if "YearlyIncome" in demographics.columns:
                feats = feats.withColumn("IncomeNumeric", income_midpoint(F.col("YearlyIncome")))
    return feats


def income_midpoint(band):
    """PRJ-6: income band -> midpoint; unknown bands -> NULL."""
    expr = None
    for k, v in INCOME_MIDPOINTS.items():
        expr = F.when(band == F.lit(k), F.lit(v)) if expr is None else expr.when(band == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(None)).cast("bigint")


def behavioral_features(sales: DataFrame, with_trend: bool = True) -> DataFrame:
    """CUS-3: behavioural segmentation features."""
    agg = sales.groupBy("CustomerID").agg(
        F.countDistinct("SalesOrderID").alias("Frequency"),
        money_sum("TotalDue").alias("Monetary_Total"),
        F.count("TotalDue").alias("_n_total"),
        F.stddev_samp("TotalDue").alias("Monetary_Std"),
        F.sum("OrderQty").alias("TotalQty"),
        F.avg("UnitPriceDiscount").alias("Discount_Avg"),
        F.stddev_samp("UnitPriceDiscount").alias("Discount_Std"),
        whole_days(F.min("OrderDate"), F.max("OrderDate")).alias("LifetimeDays"),
        F.avg(is_weekend(F.col("OrderDate")).cast("int")).alias("WeekendRatio"),
    )
    feats = agg.withColumn("Monetary_Avg", safe_div(F.col("Monetary_Total"), F.col("_n_total"))).drop("_n_total")
    feats = feats.withColumns({
        "Monetary_CV": safe_div(F.col("Monetary_Std"), F.col("Monetary_Avg")),
        "ItemsPerOrder": safe_div(F.col("TotalQty"), F.col("Frequency")),
    })
    if with_trend:
        trend = theil_sen_trends(sales, {"SpendTrend": "TotalDue"}, list(LINE_ORDER))
        feats = feats.join(trend, on="CustomerID", how="left")
    return feats


def survival_features(sales: DataFrame, churn_window_days: int = 365,
                      high_churn_days: int = 730, with_trend: bool = True) -> DataFrame:
    """CHN-1: last order, days since, churn flags, Time, plus CUS-1 features."""
    feats = engineer_customer_features(sales, None, None, with_trend=with_trend)
    days = F.col("RecencyDays")
    flags = {"LastOrderDate": F.col("LastOrder"), "DaysSinceLastOrder": days, "Churned": (days > churn_window_days).cast("int"),
             "HighChurn": (days > high_churn_days).cast("int"), "Time": days}
    return feats.select("CustomerID", *[c.alias(n) for n, c in flags.items()], *[c for c in feats.columns if c != "CustomerID"])
