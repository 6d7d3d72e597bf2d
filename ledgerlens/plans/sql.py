"""DuckDB SQL building blocks for the oracle queries.

Each block is a named CTE body over the pre-registered parquet views; a
query's SQL is ``with_ctes(names) + SELECT ...``.  Money sums go through
DECIMAL so both engines add exactly; every double in a result is rounded
the same way on both sides.
"""

from __future__ import annotations

CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, body: str, deps: list[str] | None = None) -> None:
    CTES[name] = body
    DEPS[name] = deps or []


def with_ctes(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order) + "\n"


cte("sales", """
  SELECT o.o_orderkey AS SalesOrderID, l.l_linenumber AS LineNumber, o.o_orderdate AS OrderDate,
         l.l_shipdate AS ShipDate, o.o_orderstatus AS Status, o.o_custkey AS CustomerID,
         l.l_partkey AS ProductID, l.l_suppkey AS SupplierID, l.l_quantity AS OrderQty,
         CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END AS UnitPrice,
         l.l_discount AS UnitPriceDiscount, l.l_extendedprice * (1.0::DOUBLE - l.l_discount) AS LineTotal,
         l.l_extendedprice * (1.0::DOUBLE - l.l_discount) * l.l_tax AS TaxAmt,
         o.o_totalprice AS TotalDue, p.p_name AS ProductName, p.p_brand AS SubcategoryName,
         p.p_type AS CategoryName
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""")

cte("og", """
  SELECT DISTINCT CustomerID, OrderDate, SalesOrderID, TotalDue FROM sales
  WHERE CustomerID IS NOT NULL AND OrderDate IS NOT NULL AND SalesOrderID IS NOT NULL AND TotalDue IS NOT NULL""",
    ["sales"])

cte("customers", """
  SELECT c.c_custkey AS CustomerID,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN c.c_custkey END AS PersonID,
         CASE WHEN c.c_mktsegment <> 'HOUSEHOLD' THEN c.c_custkey END AS StoreID,
         CAST(c.c_nationkey AS BIGINT) AS TerritoryID, c.c_name AS AccountNumber,
         c.c_mktsegment AS Segment, c.c_acctbal AS AccountBalance,
         n.n_name AS TerritoryName, r.r_name AS TerritoryGroup
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")

cte("rfm", """
  SELECT CustomerID,
         datesub('day', max(OrderDate), (SELECT max(OrderDate) FROM og)) AS Recency,
         count(DISTINCT SalesOrderID) AS Frequency,
         CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS Monetary,
         min(OrderDate) AS FirstPurchase,
         datesub('day', min(OrderDate), (SELECT max(OrderDate) FROM og)) AS Age,
         CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) / count(DISTINCT SalesOrderID) AS AvgOrderValue,
         CASE WHEN datesub('day', min(OrderDate), (SELECT max(OrderDate) FROM og)) = 0 THEN 'inf'::DOUBLE
              ELSE CAST(count(DISTINCT SalesOrderID) AS DOUBLE)
                   / CAST(datesub('day', min(OrderDate), (SELECT max(OrderDate) FROM og)) AS DOUBLE) END
           * 365.0::DOUBLE AS PurchaseFrequency
  FROM og GROUP BY CustomerID""", ["og"])

cte("btyd_par", """
  SELECT CASE WHEN var > mean THEN mean * mean / (var - mean) ELSE mean END AS r,
         CASE WHEN var > mean THEN mean / (var - mean) ELSE 1.0::DOUBLE END AS alpha
  FROM (SELECT s1 / n AS mean, (s2 - s1 * s1 / n) / (n - 1) AS var
        FROM (SELECT count(Frequency) AS n, CAST(sum(Frequency) AS DOUBLE) AS s1,
                     sum(CAST(Frequency AS DOUBLE) * CAST(Frequency AS DOUBLE)) AS s2 FROM rfm))""", ["rfm"])

cte("clv0", """
  SELECT rfm.*, (p.r + Frequency) / (p.alpha + CAST(Age AS DOUBLE) / 365.0::DOUBLE) AS ExpectedFutureTransactions,
         (p.r + Frequency) / (p.alpha + CAST(Age AS DOUBLE) / 365.0::DOUBLE) * AvgOrderValue AS PredictedCLV,
         1.0::DOUBLE / (1.0::DOUBLE + p.alpha / (p.alpha + CAST(Age AS DOUBLE) / 365.0::DOUBLE)) AS ProbAlive
  FROM rfm, btyd_par p""", ["rfm", "btyd_par"])

cte("clv", """
  SELECT c.*, PredictedCLV - 1.96::DOUBLE * s.sd AS CLV_Lower, PredictedCLV + 1.96::DOUBLE * s.sd AS CLV_Upper
  FROM clv0 c, (SELECT stddev_samp(PredictedCLV) AS sd FROM clv0) s""", ["clv0"])

cte("rfm_med", """
  SELECT median(Frequency) AS f_med, median(Monetary) AS m_med, median(Recency) AS r_med FROM rfm""", ["rfm"])

cte("segmented", """
  SELECT c.*, CASE
      WHEN Frequency = 0 THEN 'New'
      WHEN coalesce(ProbAlive, 0.5) < 0.3 AND Monetary > m.m_med THEN 'Lost VIP'
      WHEN coalesce(ProbAlive, 0.5) < 0.3 THEN 'Dormant'
      WHEN Frequency > m.f_med AND Monetary > m.m_med AND Recency < m.r_med THEN 'Enterprise VIP'
      WHEN Frequency > m.f_med AND Monetary > m.m_med THEN 'At Risk VIP'
      WHEN Frequency > m.f_med THEN 'Regular Buyer'
      WHEN Monetary > m.m_med THEN 'Big Spender'
      WHEN Recency < m.r_med THEN 'New Active'
      ELSE 'Occasional' END AS Segment
  FROM clv c, rfm_med m""", ["clv", "rfm_med"])

# line-grain order consistency (std of day gaps between consecutive lines)
cte("consistency", """
  SELECT CustomerID, CASE WHEN count(*) >= 3 THEN coalesce(stddev_samp(gap), 0.0) ELSE 0.0 END AS OrderConsistency
  FROM (SELECT CustomerID,
               CAST(datesub('day', lag(OrderDate) OVER (PARTITION BY CustomerID ORDER BY OrderDate, SalesOrderID,
                    LineNumber, ProductID, SupplierID, OrderQty, UnitPrice), OrderDate) AS DOUBLE) AS gap
        FROM sales)
  GROUP BY CustomerID""", ["sales"])

cte("health", """
  SELECT r.*, (0.25 * rs + 0.25 * fs + 0.25 * ms + 0.25 * cs) * 100.0 AS HealthScore FROM (
    SELECT r.CustomerID,
           exp(-2.0 * CASE WHEN mm.rmax > mm.rmin THEN (r.Recency - mm.rmin) / (mm.rmax - mm.rmin) ELSE 0.0 END) AS rs,
           CASE WHEN mm.fmax > mm.fmin THEN (r.Frequency - mm.fmin) / (mm.fmax - mm.fmin) ELSE 0.0 END AS fs,
           CASE WHEN mm.mmax > mm.mmin THEN (r.Monetary - mm.mmin) / (mm.mmax - mm.mmin) ELSE 0.0 END AS ms,
           CASE WHEN cm.cmax > 0 THEN coalesce(1.0 - c.OrderConsistency / cm.cmax, 0.5) ELSE 0.5 END AS cs
    FROM rfm r
    LEFT JOIN consistency c ON r.CustomerID = c.CustomerID,
    (SELECT min(Recency) rmin, max(Recency) rmax, min(Frequency) fmin, max(Frequency) fmax,
            min(Monetary) mmin, max(Monetary) mmax FROM rfm) mm,
    (SELECT max(c2.OrderConsistency) AS cmax FROM rfm r2 LEFT JOIN consistency c2 ON r2.CustomerID = c2.CustomerID) cm
  ) r""", ["rfm", "consistency"])


def health_category_sql(x: str) -> str:
    return (f"CASE WHEN {x} > 0 AND {x} <= 30 THEN 'Critical' WHEN {x} > 30 AND {x} <= 50 THEN 'At Risk' "
            f"WHEN {x} > 50 AND {x} <= 70 THEN 'Stable' WHEN {x} > 70 AND {x} <= 100 THEN 'Excellent' END")

# line position per customer (total order) and Theil-Sen by brute force pairs
cte("lines_x", """
  SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY OrderDate, SalesOrderID, LineNumber, ProductID,
                               SupplierID, OrderQty, UnitPrice) - 1 AS x,
         count(*) OVER (PARTITION BY CustomerID) AS n_lines
  FROM sales""", ["sales"])

# values as whole millionths: their differences are exact, so a slope at a rounding tie is the same in any engine
cte("whole_x", """
  SELECT CustomerID, x, n_lines, CAST(round(OrderQty * 1e6) AS BIGINT) AS q, CAST(round(TotalDue * 1e6) AS BIGINT) AS t
  FROM lines_x""", ["lines_x"])

cte("trends", """
  SELECT c.CustomerID, coalesce(t.VolumeTrend, 0.0) AS VolumeTrend, coalesce(t.SpendTrend, 0.0) AS SpendTrend
  FROM (SELECT DISTINCT CustomerID FROM sales) c LEFT JOIN (
    SELECT a.CustomerID,
           median((b.q - a.q) / CAST(b.x - a.x AS DOUBLE)) / 1e6 AS VolumeTrend,
           median((b.t - a.t) / CAST(b.x - a.x AS DOUBLE)) / 1e6 AS SpendTrend
    FROM whole_x a JOIN whole_x b ON a.CustomerID = b.CustomerID AND a.x < b.x
    WHERE a.n_lines >= 3 GROUP BY a.CustomerID) t ON c.CustomerID = t.CustomerID""", ["lines_x", "whole_x"])

cte("mix", """
  SELECT CustomerID,
         -sum(p * ln(p + 1e-10)) AS ProductEntropy, count(*) AS CategoryPenetration
  FROM (SELECT CustomerID, CategoryName,
               q / sum(q) OVER (PARTITION BY CustomerID) AS p
        FROM (SELECT CustomerID, CategoryName, sum(OrderQty) AS q FROM sales
              WHERE CategoryName IS NOT NULL GROUP BY CustomerID, CategoryName))
  GROUP BY CustomerID""", ["sales"])

cte("cust_feats", """
  SELECT a.*, datesub('day', a.LastOrder, (SELECT max(OrderDate) FROM sales)) AS RecencyDays,
         greatest(datesub('day', a.FirstOrder, a.LastOrder), 1) AS CustomerLifetimeDays,
         a.NumOrders / CAST(greatest(datesub('day', a.FirstOrder, a.LastOrder), 1) AS DOUBLE) * 30.0 AS PurchaseFrequency,
         greatest(datesub('day', a.FirstOrder, a.LastOrder), 1) / CAST(a.NumOrders AS DOUBLE) AS AvgDaysBetweenOrders,
         a.TotalSpend / CAST(greatest(datesub('day', a.FirstOrder, a.LastOrder), 1) AS DOUBLE) * 30.0 AS SpendVelocity,
         coalesce(c.OrderConsistency, 0.0) AS OrderConsistency, t.VolumeTrend,
         coalesce(a.SpendStd / a.AvgOrderValue, 0.0) AS CV_Spend,
         a.AvgDiscount * 100.0 AS DiscountDependency, CAST(a.AvgDiscount > 0.1 AS INTEGER) AS HighDiscountBuyer,
         m.ProductEntropy, coalesce(m.CategoryPenetration, 0) AS CategoryPenetration
  FROM (SELECT CustomerID, count(DISTINCT SalesOrderID) AS NumOrders, min(OrderDate) AS FirstOrder,
               max(OrderDate) AS LastOrder, stddev_samp(epoch(OrderDate)) AS OrderDateStd,
               CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS TotalSpend,
               CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) / count(TotalDue) AS AvgOrderValue,
               stddev_samp(TotalDue) AS SpendStd, min(TotalDue) AS MinOrder, max(TotalDue) AS MaxOrder,
               sum(OrderQty) AS TotalItems, avg(OrderQty) AS AvgItemsPerOrder,
               avg(UnitPriceDiscount) AS AvgDiscount, count(DISTINCT ProductID) AS UniqueProducts
        FROM sales GROUP BY CustomerID) a
  LEFT JOIN consistency c ON a.CustomerID = c.CustomerID
  LEFT JOIN trends t ON a.CustomerID = t.CustomerID
  LEFT JOIN mix m ON a.CustomerID = m.CustomerID""", ["sales", "consistency", "trends", "mix"])

cte("metrics_h", """
  SELECT c.*, h.HealthScore FROM clv c LEFT JOIN health h ON c.CustomerID = h.CustomerID""", ["clv", "health"])

# previous-period segments for the migration matrix: the same pipeline on
# orders up to one year before the last order, as of that date
cte("prev_ref", """SELECT max(OrderDate) - INTERVAL 365 DAY AS ref FROM og""", ["og"])
cte("og_prev", """SELECT * FROM og WHERE OrderDate <= (SELECT ref FROM prev_ref)""", ["og", "prev_ref"])


def _derive_prev() -> None:
    import re
    rfm_body = CTES["rfm"].replace("(SELECT max(OrderDate) FROM og)", "(SELECT ref FROM prev_ref)")
    rfm_body = re.sub(r"\bFROM og\b", "FROM og_prev", rfm_body)
    cte("rfm_prev", rfm_body, ["og_prev", "prev_ref"])
    for name in ("btyd_par", "clv0", "clv", "rfm_med", "segmented"):
        body = CTES[name]
        for dep in ("rfm", "btyd_par", "clv0", "clv", "rfm_med"):
            body = re.sub(rf"\b{dep}\b", f"{dep}_prev", body)
        cte(f"{name}_prev", body, [f"{d}_prev" for d in DEPS[name]])


_derive_prev()

cte("order_resp", """
  SELECT o.CustomerID, o.SalesOrderID, o.OrderDate, o.AvgDiscount > 0.05 AS Promoted,
         CAST(coalesce(datesub('day', o.OrderDate, d.NextDate) <= 90, false) AS INTEGER) AS Responded
  FROM (SELECT CustomerID, SalesOrderID, OrderDate, avg(UnitPriceDiscount) AS AvgDiscount
        FROM sales GROUP BY CustomerID, SalesOrderID, OrderDate) o
  JOIN (SELECT CustomerID, OrderDate, lead(OrderDate) OVER (PARTITION BY CustomerID ORDER BY OrderDate) AS NextDate
        FROM (SELECT DISTINCT CustomerID, OrderDate FROM sales)) d
    ON o.CustomerID = d.CustomerID AND o.OrderDate = d.OrderDate""", ["sales"])

cte("cust_month", """
  SELECT CustomerID, year(OrderDate) * 12 + month(OrderDate) AS MonthIdx,
         CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS Revenue,
         min(CAST(date_trunc('month', OrderDate) AS DATE)) AS Month
  FROM sales GROUP BY CustomerID, year(OrderDate) * 12 + month(OrderDate)""", ["sales"])

cte("cohort_cells", """
  SELECT f.CohortIdx, m.MonthIdx - f.CohortIdx AS Period, sum(m.Revenue) AS Value, count(*) AS Customers
  FROM cust_month m JOIN (SELECT CustomerID, min(MonthIdx) AS CohortIdx FROM cust_month GROUP BY CustomerID) f
    ON m.CustomerID = f.CustomerID
  GROUP BY f.CohortIdx, m.MonthIdx - f.CohortIdx""", ["cust_month"])
