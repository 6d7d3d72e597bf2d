import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as E
from ledgerlens.operators import churn as ch
from ledgerlens.operators import features as feat
from ledgerlens.operators import reports as rep
from ledgerlens.operators import value as val


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_health_bins_x1(spark):
    xs = [0.0, 0.01, 30.0, 30.01, 50.0, 70.0, 100.0, 100.01]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = col_values(df.select(val.health_category(F.col("x")).alias("c")), "c")
    assert got == [None, "Critical", "Critical", "At Risk", "At Risk", "Stable", "Excellent", None]


def test_discount_bins_x2(spark):
    xs = [0.0, 0.05, 0.10, 0.11, 0.30, 0.50, 0.51]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    c = E.right_closed_bins(F.col("x") * 100.0, rep.DISCOUNT_EDGES, rep.DISCOUNT_LABELS)
    assert col_values(df.select(c.alias("c")), "c") == [None, "0-10%", "0-10%", "10-20%", "20-30%", "30-50%", "50%+"]


def test_whole_days_x9(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))], "a timestamp, b timestamp")
    assert df.select(E.whole_days("a", "b").alias("d")).collect()[0]["d"] == 0


def test_week_end_and_weekend_x10(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7),), (dt.datetime(2024, 1, 8),)], "d timestamp")
    rows = df.select(E.week_end_sunday("d").alias("w"), E.is_weekend("d").alias("we")).collect()
    assert [r["w"] for r in rows] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]
    assert [r["we"] for r in rows] == [True, False]


def test_risk_score_x22(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.0), (None, 0.0, 0.0)], "p double, v double, r double")
    got = col_values(df.select(ch.churn_risk_score(F.col("p"), F.col("v"), F.col("r")).alias("s")), "s")
    assert got[0] == pytest.approx(40.0)
    assert got[1] is None


def test_risk_segments_x24(spark):
    df = spark.createDataFrame([(0.7,), (0.3,), (0.29,), (None,)], "p double")
    assert col_values(df.select(ch.risk_segment(F.col("p")).alias("s")), "s") == [
        "High Risk", "Medium Risk", "Low Risk", "Unknown"]


def test_retention_impact_x23(spark):
    df = spark.createDataFrame([(1, 0.15, 50000.0), (2, 0.15, 0.0)], "CustomerID int, p double, clv double")
    out = {(r["CustomerID"], r["RetentionCost"]): r for cost in (5000.0, 0.0) for r in
           ch.retention_impact(df, "p", "clv", cost).collect()}
    r = out[(1, 5000.0)]
    assert r["ExpectedLoss"] == pytest.approx(7500.0)
    assert r["RetentionROI"] == pytest.approx(50.0)
    assert r["ShouldRetain"] is True
    assert r["BreakEvenProbability"] == pytest.approx(0.1)
    assert math.isinf(out[(1, 0.0)]["RetentionROI"])
    assert out[(2, 5000.0)]["BreakEvenProbability"] == 1.0


def test_income_midpoint_x28(spark):
    df = spark.createDataFrame([("30001-60000",), ("150001+",), ("unknown",)], "b string")
    assert col_values(df.select(feat.income_midpoint(F.col("b")).alias("m")), "m") == [45000, 200000, None]


def test_quadrants_x27(spark):
    df = spark.createDataFrame([(0.1, 0.3), (0.05, 0.5), (-0.1, 0.5), (0.1, 0.5)], "e double, b double")
    got = col_values(df.select(rep.quadrant_label(F.col("e"), F.col("b")).alias("q")), "q")
    assert got == ["Persuadables", "Sure Things", "Sleeping Dogs", "Lost Causes"]


def test_segment_rule_x14(spark):
    df = spark.createDataFrame([(0, 10.0, 5.0, 0.9), (3, 200.0, 5.0, 0.2), (3, 50.0, 5.0, 0.2),
                                (1, 50.0, 50.0, None)],
                               "Frequency long, Monetary double, Recency double, ProbAlive double")
    seg = val.segment_rule(F.col("Frequency"), F.col("Monetary"), F.col("Recency"), F.col("ProbAlive"),
                           2.0, 100.0, 10.0)
    assert col_values(df.select(seg.alias("s")), "s") == ["New", "Lost VIP", "Dormant", "Occasional"]


def test_safe_div_and_finite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("inf"), 1.0)], "a double, b double")
    rows = df.select(E.safe_div("a", "b").alias("d"), E.finite_or(F.col("a")).alias("f")).collect()
    assert rows[0]["d"] is None and rows[1]["f"] == 1e6
