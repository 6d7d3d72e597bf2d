"""Source operators beyond the parquet mapping (SRC-1, SRC-4, SRC-6..10).

The reference reads a relational database through SQL extracts.  Here an
extract is a DataFrame: named SQL runs through ``spark.sql`` with bound
parameters (Catalyst parses and optimises it), JDBC sources use Spark's
partitioned JDBC reader, and the auxiliary extracts are plain projections
and joins over whatever tables the caller registers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_sql(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """SRC-1: SQL text with optional named parameters (``:name``) -> DataFrame."""
    return spark.sql(query, args=params) if params else spark.sql(query)


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              properties: dict | None = None) -> DataFrame:
    """SRC-1 (database source): partitioned JDBC read of a query."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        reader = reader.option("query", query)
    return reader.load()


DEMOGRAPHIC_COLUMNS = ["BusinessEntityID", "TotalPurchaseYTD", "DateFirstPurchase", "BirthDate", "MaritalStatus",
                       "YearlyIncome", "Gender", "TotalChildren", "NumberChildrenAtHome", "Education", "Occupation",
                       "HomeOwnerFlag", "NumberCarsOwned"]


def demographics(source: DataFrame) -> DataFrame:
    """SRC-4: the 13-column demographics projection with canonical types."""
    typed = {"BusinessEntityID": "bigint", "TotalPurchaseYTD": "double", "DateFirstPurchase": "timestamp",
             "BirthDate": "timestamp", "TotalChildren": "int", "NumberChildrenAtHome": "int",
             "HomeOwnerFlag": "boolean", "NumberCarsOwned": "int"}
    return source.select(*[coerce(F.col(c), typed[c]).alias(c) if c in typed else F.col(c)
                           for c in DEMOGRAPHIC_COLUMNS])


def special_offers(offers: DataFrame, offer_products: DataFrame) -> DataFrame:
    """SRC-6: offers left-joined to their product links."""
    return offers.join(offer_products.select("SpecialOfferID", "ProductID"), "SpecialOfferID", "left")


def sales_reasons(order_reasons: DataFrame, reasons: DataFrame) -> DataFrame:
    """SRC-7: order -> sales reason (inner join)."""
    return order_reasons.join(reasons, "SalesReasonID", "inner").select(
        "SalesOrderID", F.col("Name").alias("SalesReason"), "ReasonType")


def sales_persons(persons: DataFrame, people: DataFrame, employees: DataFrame) -> DataFrame:
    """SRC-8: salesperson x person x employee (inner joins)."""
    return persons.join(people, "BusinessEntityID", "inner").join(employees, "BusinessEntityID", "inner").select(
        "BusinessEntityID", "TerritoryID", "SalesQuota", "Bonus", "CommissionPct", "SalesYTD", "SalesLastYear",
        "FirstName", "LastName", "JobTitle")


def coerce(c, to: str):
    """SRC-10 / S14: failed numeric or date coercion becomes NULL (never raises)."""
    if to == "timestamp":
        return F.try_to_timestamp(c.cast("string"))
    return c.try_cast(to)


class Bundle:
    """SRC-9: the loaded extracts, persisted once and released explicitly
    (no time-to-live: Spark caches are released with ``unpersist``)."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = {k: v.persist() for k, v in tables.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def unpersist(self) -> None:
        for v in self.tables.values():
            v.unpersist()


def load_bundle(catalog, **others: DataFrame) -> Bundle:
    """Sales lines, customers and territories of the catalog, and extracts the
    caller has tables for: demographics, special_offers, sales_reasons, ..."""
    return Bundle({"sales_orders": catalog.sales_lines(), "customers": catalog.customers(),
                   "territories": catalog.territories(), **others})
