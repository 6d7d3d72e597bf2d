"""Canonical tables built from the parquet test tables.

The engine works on a sales-line fact and a customer dimension (the
canonical schemas in FIXTURES.md).  This module maps the parquet star
schema onto them with plain joins; Catalyst prunes unused columns and pushes
filters into the scans, AQE decides per join whether a side is small enough
to broadcast (only the fixed-size nation/region tables get an explicit hint).

Mapping (a convention of this repo):
  SalesOrderID/OrderDate/Status/TotalDue/CustomerID <- orders
  ProductID, OrderQty, UnitPriceDiscount, ShipDate   <- lineitem
  UnitPrice = extendedprice / quantity, LineTotal = extendedprice * (1 - discount), TaxAmt = LineTotal * tax
  ProductName/SubcategoryName/CategoryName           <- part name/brand/type
  TerritoryID/TerritoryName/TerritoryGroup            <- nation/region
  PersonID (HOUSEHOLD segment) / StoreID (other segments) <- customer
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import safe_div
from ledgerlens.session import prepare, size_shuffles

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Columns that make the order of a customer's lines total (ties in OrderDate
# are broken by the order, line and product keys, then by the values).
LINE_ORDER = ("OrderDate", "SalesOrderID", "LineNumber", "ProductID", "SupplierID",
              "OrderQty", "UnitPrice")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


class Catalog:
    """Lazy accessors for the canonical tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _facts(self) -> tuple[DataFrame, DataFrame]:
        """Lines and orders, whose joins are sized by their bytes."""
        size_shuffles(self.spark, [table_path(self.sf_dir, name) for name in ("lineitem", "orders")])
        return self.raw("lineitem"), self.raw("orders")

    # -- facts ---------------------------------------------------------
    def sales_lines(self, products_first: bool = False) -> DataFrame:
        """SRC-2: header x detail x product, one row per order line.

        With ``products_first`` the columns of the orders do not go through the
        join with the products, and the lines of an order come out side by side.
        """
        li, o = self._facts()
        p = self.raw("part")
        joins = [(o, li.l_orderkey == o.o_orderkey), (p, li.l_partkey == p.p_partkey)]
        lines = li
        for table, on in reversed(joins) if products_first else joins:
            lines = lines.join(table, on, "inner")
        return lines.select(
            F.col("o_orderkey").alias("SalesOrderID"),
            F.col("l_linenumber").alias("LineNumber"),
            F.col("o_orderdate").alias("OrderDate"),
            F.col("l_shipdate").alias("ShipDate"),
            F.col("o_orderstatus").alias("Status"),
            F.col("o_custkey").alias("CustomerID"),
            F.col("l_partkey").alias("ProductID"),
            F.col("l_suppkey").alias("SupplierID"),
            F.col("l_quantity").alias("OrderQty"),
            safe_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("UnitPrice"),
            F.col("l_discount").alias("UnitPriceDiscount"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("LineTotal"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * F.col("l_tax")).alias("TaxAmt"),
            F.col("o_totalprice").alias("TotalDue"),
            F.col("p_name").alias("ProductName"),
            F.col("p_brand").alias("SubcategoryName"),
            F.col("p_type").alias("CategoryName"),
        )

    def order_grain(self) -> DataFrame:
        """SET-1: one row per (CustomerID, OrderDate, SalesOrderID, TotalDue).

        Rows with a NULL key are dropped (pandas groupby semantics).  Read
        straight from the order header: Catalyst would otherwise have to
        de-duplicate the line fact; only orders that have lines qualify.
        """
        li, o = self._facts()
        li = li.select("l_orderkey", "l_partkey")
        p = self.raw("part").select("p_partkey")
        line_orders = li.join(p, li.l_partkey == p.p_partkey, "left_semi")
        with_lines = o.join(line_orders, o.o_orderkey == line_orders.l_orderkey, "left_semi")
        return (with_lines.select(
            F.col("o_custkey").alias("CustomerID"),
            F.col("o_orderdate").alias("OrderDate"),
            F.col("o_orderkey").alias("SalesOrderID"),
            F.col("o_totalprice").alias("TotalDue"))
            .dropna(subset=["CustomerID", "OrderDate", "SalesOrderID", "TotalDue"])
            .distinct())

    # -- dimensions ----------------------------------------------------
    def territories(self) -> DataFrame:
        """SRC-5: territory with YTD / last-year sales.

        Sales YTD = order totals in the calendar year of the latest order up
        to that order's day-of-year; last year = the same window one year
        earlier.  The test tables carry no cost figures, so the cost columns
        of the reference extract are not produced.
        """
        n = self.raw("nation")
        r = self.raw("region")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        o = self.raw("orders").select("o_custkey", "o_orderdate", "o_totalprice")
        m = F.lit(o.agg(F.max("o_orderdate")).collect()[0][0])
        oc = (o.join(c, o.o_custkey == c.c_custkey, "inner")
              .withColumn("yr", F.year("o_orderdate") - F.year(m))
              .where((F.dayofyear("o_orderdate") <= F.dayofyear(m)) & F.col("yr").isin(0, -1)))
        sales = oc.groupBy("c_nationkey").agg(
            F.sum(F.when(F.col("yr") == 0, F.col("o_totalprice")).otherwise(0.0)).alias("SalesYTD"),
            F.sum(F.when(F.col("yr") == -1, F.col("o_totalprice")).otherwise(0.0)).alias("SalesLastYear"))
        dims = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left"))
        return (dims.join(sales, dims.n_nationkey == sales.c_nationkey, "left")
                .select(F.col("n_nationkey").cast("bigint").alias("TerritoryID"),
                        F.col("n_name").alias("Name"),
                        F.col("n_regionkey").cast("string").alias("CountryRegionCode"),
                        F.col("r_name").alias("Group"),
                        F.coalesce("SalesYTD", F.lit(0.0)).alias("SalesYTD"),
                        F.coalesce("SalesLastYear", F.lit(0.0)).alias("SalesLastYear")))

    def customers(self) -> DataFrame:
        """SRC-3: customer dimension, exactly one row per CustomerID.

        nation/region are fixed-size (25/5 rows) and broadcast; the
        customer table itself is never broadcast.  The guard keeps the first
        row per key in a deterministic order should a source repeat a key.
        """
        c = self.raw("customer")
        geo = F.broadcast(self.raw("nation").join(F.broadcast(self.raw("region")),
                                                 F.col("n_regionkey") == F.col("r_regionkey"), "left"))
        joined = c.join(geo, c.c_nationkey == geo.n_nationkey, "left")
        household = F.col("c_mktsegment") == F.lit("HOUSEHOLD")
        out = joined.select(
            F.col("c_custkey").alias("CustomerID"),
            F.when(household, F.col("c_custkey")).alias("PersonID"),
            F.when(~household, F.col("c_custkey")).alias("StoreID"),
            F.col("c_nationkey").cast("bigint").alias("TerritoryID"),
            F.col("c_name").alias("AccountNumber"),
            F.col("c_mktsegment").alias("Segment"),
            F.col("c_acctbal").alias("AccountBalance"),
            F.col("n_name").alias("TerritoryName"),
            F.col("r_name").alias("TerritoryGroup"),
        )
        return dedupe_first(out, ["CustomerID"], ["TerritoryID", "AccountNumber"])

    def events(self) -> DataFrame:
        return self.raw("events")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest row by ``order`` (min_by on a struct).

    An aggregate, not a window: partial aggregation keeps a repeated key
    from landing whole in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order + [c for c in others if c not in order]])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_s"))
    return agg.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in others])

