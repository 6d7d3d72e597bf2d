import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import features as feat
from ledgerlens.operators.trends import _median_slopes, theil_sen_trends

D0 = dt.datetime(2020, 1, 1)


def lines(spark, rows):
    """rows: (customer, day offset, qty, total, category)"""
    data = [(c, i, D0 + dt.timedelta(days=d), q, t, cat, 100 + i, i, 1, q, 1.0)
            for i, (c, d, q, t, cat) in enumerate(rows)]
    return spark.createDataFrame(data, "CustomerID long, SalesOrderID long, OrderDate timestamp, OrderQty double, "
                                       "TotalDue double, CategoryName string, ProductID long, LineNumber int, "
                                       "SupplierID long, UnitPriceDiscount double, UnitPrice double")


def test_theil_sen_x7(spark):
    df = lines(spark, [(1, 0, 1.0, 1.0, "a"), (1, 1, 3.0, 1.0, "a"), (1, 2, 2.0, 1.0, "a"), (1, 3, 10.0, 1.0, "a"),
                       (2, 0, 1.0, 1.0, "a"), (2, 1, 5.0, 1.0, "a")])
    order = ["OrderDate", "SalesOrderID", "LineNumber", "ProductID", "SupplierID", "OrderQty", "UnitPrice"]
    got = {r["CustomerID"]: r["t"] for r in theil_sen_trends(df, {"t": "OrderQty"}, order).collect()}
    assert got == {1: 2.5, 2: 0.0}


def brute_theil(y):
    s = [(y[j] - y[i]) / (j - i) for i, j in itertools.combinations(range(len(y)), 2)]
    return float(np.median(s)) if len(y) >= 3 else 0.0


def test_theil_sen_heavy_path_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c, n in ((1, 23), (2, 17), (3, 2)):
        for i in range(n):
            rows.append((c, i, float(rng.integers(1, 20)), round(float(rng.normal(0, 1e4)), 2), "a"))
    df = lines(spark, rows)
    order = ["OrderDate", "SalesOrderID", "LineNumber", "ProductID", "SupplierID", "OrderQty", "UnitPrice"]
    both = {"q": "OrderQty", "t": "TotalDue"}
    heavy = {r["CustomerID"]: (r["q"], r["t"]) for r in theil_sen_trends(df, both, order, local_max=0).collect()}
    light = {r["CustomerID"]: (r["q"], r["t"]) for r in theil_sen_trends(df, both, order).collect()}
    assert heavy == light  # bit by bit
    for c in (1, 2, 3):
        assert light[c][0] == pytest.approx(brute_theil([r[2] for r in rows if r[0] == c]), abs=1e-9)
        assert light[c][1] == pytest.approx(brute_theil([r[3] for r in rows if r[0] == c]), abs=1e-9)


def test_consistency_x8(spark):
    df = lines(spark, [(1, 0, 1.0, 1.0, "a"), (1, 0, 1.0, 1.0, "a"), (1, 10, 1.0, 1.0, "a"), (1, 30, 1.0, 1.0, "a"),
                       (2, 0, 1.0, 1.0, "a"), (2, 5, 1.0, 1.0, "a")])
    got = {r["CustomerID"]: r["OrderConsistency"] for r in feat.order_consistency(df).collect()}
    assert got[1] == pytest.approx(10.0) and got[2] == 0.0


def test_entropy_x6_and_null_category_x15(spark):
    df = lines(spark, [(1, 0, 3.0, 1.0, "a"), (1, 1, 1.0, 1.0, "b"), (1, 2, 5.0, 1.0, None),
                       (2, 0, 2.0, 1.0, None)])
    f = {r["CustomerID"]: r for r in feat.engineer_customer_features(df, with_trend=False).collect()}
    assert f[1]["ProductEntropy"] == pytest.approx(0.562335, abs=1e-6)
    assert f[1]["CategoryPenetration"] == 2
    assert f[2]["ProductEntropy"] is None and f[2]["CategoryPenetration"] == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_gap_states_of_a_hot_customer_with_times_of_day(spark, parts):
    """A third of all rows on one customer, dates to the microsecond, cut into ranges."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for c in [1] * 400 + r.integers(2, 300, 800).tolist():
        rows.append((int(c), D0 + dt.timedelta(microseconds=int(r.integers(0, 10**15)))))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "CustomerID long, OrderDate timestamp")
    per_date = df.groupBy("CustomerID", "OrderDate").count().withColumnRenamed("count", "c")
    for c in {c for c, _ in rows}:
        own = sorted(d for k, d in rows if k == c)
        gaps = [(b - a) // dt.timedelta(days=1) for a, b in zip(own, own[1:])]
        want[c] = (len(own), float(sum(gaps)), float(sum(g * g for g in gaps)))
    got = {x[0]: (x[1], x[2], x[3]) for x in feat.gap_states(per_date, num_partitions=parts).collect()}
    assert got == want


def test_theil_sen_refuses_values_that_it_would_round(spark):
    order = ["OrderDate", "SalesOrderID", "LineNumber", "ProductID", "SupplierID", "OrderQty", "UnitPrice"]
    for bad in (1.00000005, 1e10):
        df = lines(spark, [(1, d, 1.0, v, "a") for d, v in enumerate([1.5, bad, 2.25])])
        with pytest.raises(ValueError):
            theil_sen_trends(df, {"t": "TotalDue"}, order)
    df = lines(spark, [(1, d, 1.0, v, "a") for d, v in enumerate([0.1, 0.3, 123456789.123456])])
    assert theil_sen_trends(df, {"t": "TotalDue"}, order).count() == 1


def test_stored_lines_hold_customers_side_by_side(spark, monkeypatch):
    """A task's part of the stored lines holds whole customers, so that partial aggregates shrink them before a shuffle."""
    tables = {}
    keep = feat.stored
    monkeypatch.setattr(feat, "stored", lambda df, name="table": tables.setdefault(name, keep(df, name)))
    df = lines(spark, [(c, d, 1.0 + c, 1.0, "a") for d in range(6) for c in range(40)]).repartition(5)
    feat.engineer_customer_features(df, with_trend=False)
    parts = tables["lines"].selectExpr("input_file_name() AS part", "CustomerID").collect()
    assert len(parts) == 240 and len({(r.part, r.CustomerID) for r in parts}) == 40
    for part in {r.part for r in parts}:
        own = [r.CustomerID for r in parts if r.part == part]
        assert own == sorted(own)
    assert "UnitPrice" not in tables["lines"].columns  # orders no quantities


@pytest.mark.parametrize("with_trend", [True, False])
def test_different_orders_and_products(spark, with_trend, monkeypatch):
    """Counted beside the trends for customers with few and with many lines, also for lines of no customer."""
    from ledgerlens.operators import trends
    monkeypatch.setattr(trends, "LOCAL_MAX", 4)
    rows = [(1, 5, 9), (1, 5, 9), (1, 6, 8), (2, 7, 9), (None, 8, 1), (None, 8, 2), (None, 9, None)] + [(3, 10 + k % 4, k % 6) for k in range(12)]
    df = spark.createDataFrame([(c, o, D0 + dt.timedelta(days=o), 1.0 + k % 3, 2.0, "a", p, k, 1, 0.0, 1.0) for k, (c, o, p) in enumerate(rows)],
                               lines(spark, [(1, 1, 1.0, 1.0, "a")]).schema)
    got = {r.CustomerID: (r.NumOrders, r.UniqueProducts) for r in feat.engineer_customer_features(df, with_trend=with_trend).collect()}
    assert got == {1: (2, 2), 2: (1, 1), 3: (4, 6), None: (2, 2)}


def test_slopes_of_arrays_of_equal_length_together():
    r = np.random.default_rng(5)
    ys = pd.Series([r.integers(1, 50, n) * 10**6 for n in (7, 0, 1, 2, 3, 40, 7, 3, 130, 40)])
    assert _median_slopes(ys).tolist() == [brute_theil([float(v) for v in y]) / 1e6 for y in ys]
