import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import reports as rep
from ledgerlens.operators import value as val


def rfm_rows(spark, freqs, age=365, aov=1.0):
    rows = [(i, 0, f, f * aov, age, aov) for i, f in enumerate(freqs)]
    return spark.createDataFrame(rows, "CustomerID long, Recency long, Frequency long, Monetary double, "
                                       "Age long, AvgOrderValue double")


def test_btyd_moments_x3(spark):
    clv, p = val.fit_btyd(rfm_rows(spark, [1, 2, 9]))
    assert p.r == pytest.approx(16 / 15) and p.alpha == pytest.approx(4 / 15)
    got = {r["CustomerID"]: r for r in clv.collect()}
    assert got[0]["ExpectedFutureTransactions"] == pytest.approx(31 / 19)
    assert got[1]["ExpectedFutureTransactions"] == pytest.approx(46 / 19)
    assert got[2]["ExpectedFutureTransactions"] == pytest.approx(151 / 19)
    assert got[0]["ProbAlive"] == pytest.approx(19 / 23)


def test_btyd_low_variance_x4(spark):
    p = val.btyd_parameters(rfm_rows(spark, [1, 1, 1]))
    assert (p.r, p.alpha) == (1.0, 1.0)


def test_rfm_age_zero_x5(spark):
    t = dt.datetime(2024, 5, 1)
    df = spark.createDataFrame([(7, t, 100, 50.0)], "CustomerID long, OrderDate timestamp, SalesOrderID long, TotalDue double")
    r = val.calculate_rfm(df).collect()[0]
    assert r["Age"] == 0 and math.isinf(r["PurchaseFrequency"])


def test_health_score_x26(spark):
    df = spark.createDataFrame([(i, float(v), v, float(v)) for i, v in enumerate([0, 5, 10])],
                               "CustomerID long, Recency double, Frequency long, Monetary double")
    h = {r["CustomerID"]: r["HealthScore"] for r in val.health_score(df).collect()}
    assert h[1] == pytest.approx(45.375780, abs=1e-6)


def test_top_share_k_x29(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "CustomerID long, Monetary double")
    r = rep.top_share(df, "Monetary", 0.05).collect()[0]
    assert r["TopK"] == 1 and r["TopValue"] == 29.0


def test_segments_cover_all_rows(spark):
    df = rfm_rows(spark, [1, 2, 3, 4, 5, 6, 7, 8])
    clv, _ = val.fit_btyd(df)
    seg = val.segment_customers(clv)
    rows = seg.collect()
    assert len(rows) == 8
    assert sum(r["SegmentSize"] for r in seg.dropDuplicates(["Segment"]).collect()) == 8
