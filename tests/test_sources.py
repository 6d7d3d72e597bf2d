import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import basket as mb
from ledgerlens.operators import charts as chx
from ledgerlens.operators import features as feat
from ledgerlens.sources import extracts as ex
from ledgerlens.sources.tables import Catalog, dedupe_first

SMOKE = "/root/testdata/sf0.001"


def test_one_row_per_customer_x16(spark):
    df = spark.createDataFrame([(1, "b-addr"), (1, "a-addr"), (2, "c")], "CustomerID long, City string")
    rows = dedupe_first(df, ["CustomerID"], ["City"]).orderBy("CustomerID").collect()
    assert [(r.CustomerID, r.City) for r in rows] == [(1, "a-addr"), (2, "c")]
    cat = Catalog(spark, SMOKE)
    c = cat.customers()
    assert c.count() == c.select("CustomerID").distinct().count()


def test_demographics_join_and_income(spark):
    demo = spark.createDataFrame(
        [(10, 1.0, "2020-01-01", "1980-05-05", "M", "30001-60000", "F", 2, 1, "B", "P", 1, 0)],
        "BusinessEntityID long, TotalPurchaseYTD double, DateFirstPurchase string, BirthDate string, "
        "MaritalStatus string, YearlyIncome string, Gender string, TotalChildren int, NumberChildrenAtHome int, "
        "Education string, Occupation string, HomeOwnerFlag int, NumberCarsOwned int")
    d = ex.demographics(demo)
    assert d.collect()[0]["BirthDate"] == dt.datetime(1980, 5, 5)
    sales = spark.createDataFrame([(1, 100, dt.datetime(2020, 1, 1), 1.0, 5.0, "a", 1, 1, 1, 0.0, 1.0)],
                                  "CustomerID long, SalesOrderID long, OrderDate timestamp, OrderQty double, "
                                  "TotalDue double, CategoryName string, ProductID long, LineNumber int, "
                                  "SupplierID long, UnitPriceDiscount double, UnitPrice double")
    cust = spark.createDataFrame([(1, 10, None, 3)], "CustomerID long, PersonID long, StoreID long, TerritoryID long")
    f = feat.engineer_customer_features(sales, cust, d, with_trend=False).collect()[0]
    assert f["IsIndividual"] == 1 and f["IsStore"] == 0 and f["IncomeNumeric"] == 45000


def test_extract_joins(spark):
    offers = spark.createDataFrame([(1, "promo"), (2, "none")], "SpecialOfferID long, Description string")
    links = spark.createDataFrame([(1, 7)], "SpecialOfferID long, ProductID long")
    assert ex.special_offers(offers, links).count() == 2
    orr = spark.createDataFrame([(100, 1), (101, 9)], "SalesOrderID long, SalesReasonID long")
    rs = spark.createDataFrame([(1, "Price", "Other")], "SalesReasonID long, Name string, ReasonType string")
    assert [r.SalesReason for r in ex.sales_reasons(orr, rs).collect()] == ["Price"]


def test_run_sql_with_params(spark):
    spark.createDataFrame([(1, 5.0), (2, 7.0)], "k long, v double").createOrReplaceTempView("t_params")
    out = ex.run_sql(spark, "SELECT sum(v) AS s FROM t_params WHERE k >= :lo", {"lo": 2}).collect()[0]
    assert out["s"] == 7.0


def test_bundle_persists(spark):
    b = ex.load_bundle(Catalog(spark, SMOKE))
    assert b["customers"].count() > 0
    b.unpersist()


def test_geo_density_x(spark):
    df = spark.createDataFrame([(10.1, 20.1), (10.2, 20.2), (40.0, -3.0)], "lat double, lon double")
    cells, centre = chx.geo_density(df, "lat", "lon", cell_deg=1.0)
    w = {(r["lat"], r["lon"]): r["weight"] for r in cells.collect()}
    assert w[(10.0, 20.0)] == 2.0 and w[(40.0, -3.0)] == 1.0
    assert centre[0] == pytest.approx(20.1)


def test_filter_rules(spark):
    rules = spark.createDataFrame([(["ring"], ["bolt x"], 1.5, 0.4), (["nut"], ["ring"], 0.9, 0.2)],
                                  "antecedents array<string>, consequents array<string>, lift double, confidence double")
    assert mb.filter_rules(rules, min_lift=1.0).count() == 1
    assert mb.filter_rules(rules, antecedent_item="nut").count() == 1
    assert mb.filter_rules(rules, item_substring="bolt").count() == 1


def test_shuffles_are_sized_by_the_tables(spark, tmp_path):
    """The partitions of a shuffle grow with the tables' bytes; a caller's own settings are not lowered or replaced."""
    from ledgerlens import session
    path = str(tmp_path / "lineitem.parquet")
    spark.range(1000).write.parquet(path)
    s = spark.newSession()
    s.conf.set(session.ADVISORY, "16k")
    s.conf.set("spark.sql.shuffle.partitions", 3)
    session.size_shuffles(s, [path])
    assert s.conf.get(session.ADVISORY) == "16k" and s.conf.get(session.INITIAL, None) is None
    old, session.TABLE_BYTES = session.TABLE_BYTES, 100
    try:
        session.size_shuffles(s, [path])
    finally:
        session.TABLE_BYTES = old
    held = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    assert int(s.conf.get(session.INITIAL)) == -(-held // 100) > 3
    fresh = spark.newSession()
    session.size_shuffles(fresh, [path])
    assert fresh.conf.get(session.ADVISORY, None) == str(session.TASK_BYTES)


def test_scans_are_sized_too(spark, tmp_path):
    """One task of a scan, which combines the keys of its part, gets a bounded part of a file; a caller's own size stays."""
    from ledgerlens import session
    path = str(tmp_path / "lineitem.parquet")
    spark.range(4000).repartition(4).write.parquet(path)
    s = spark.newSession()
    held, open_cost = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet")), "spark.sql.files.openCostInBytes"
    old, session.SCAN_BYTES = session.SCAN_BYTES, held // 2
    try:
        s.conf.set(open_cost, 0)
        s.conf.set("spark.sql.files.minPartitionNum", 1)
        session.size_shuffles(s, [path])
    finally:
        session.SCAN_BYTES = old
    assert s.read.parquet(path).rdd.getNumPartitions() >= 2
    own = spark.newSession()
    own.conf.set(session.SCAN, "1m")
    session.size_shuffles(own, [path])
    assert own.conf.get(session.SCAN) == "1m"


def test_stored_rows_leave_no_shuffle_files(spark):
    """The shuffles of stored rows go when they are written, and the caller's setting stays."""
    import time

    from ledgerlens.session import CLEANUP, stored
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().endswith(".data")}

    before = files()
    kept = spark.conf.get(CLEANUP)
    out = stored(spark.range(5000).selectExpr("id % 100 AS k").groupBy("k").count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 100 and spark.conf.get(CLEANUP) == kept


def test_join_order_changes_no_lines(spark):
    cat = Catalog(spark, "/root/testdata/sf0.001")
    one, other = cat.sales_lines(), cat.sales_lines(products_first=True)
    assert one.columns == other.columns and one.count() == other.count() > 0
    assert one.exceptAll(other).isEmpty()
