"""Registered queries: churn and survival (CHN-2..11, SNK-1)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from ledgerlens.operators import churn as ch
from ledgerlens.operators import features as feat
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import clv_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes
from ledgerlens.session import ensure_checkpoint_dir, stored

COX_FEATURES = ["NumOrders", "AvgOrderValue", "AvgDiscount", "UniqueProducts", "OrderConsistency",
                "CategoryPenetration", "ProductEntropy"]
CHN11_FEATURES = ["DaysSinceLastOrder", "Time", "NumOrders", "TotalSpend", "AvgOrderValue", "SpendStd", "MinOrder",
                  "MaxOrder", "TotalItems", "AvgItemsPerOrder", "AvgDiscount", "UniqueProducts", "RecencyDays",
                  "CustomerLifetimeDays", "PurchaseFrequency", "AvgDaysBetweenOrders", "SpendVelocity",
                  "OrderConsistency", "VolumeTrend", "CV_Spend", "DiscountDependency", "HighDiscountBuyer",
                  "ProductEntropy", "CategoryPenetration"]


def survival(spark, sf_dir, with_trend: bool = True):
    return feat.survival_features(catalog(spark, sf_dir).sales_lines(products_first=True), with_trend=with_trend)


@query("chn4_kaplan_meier", with_ctes("cust_feats") + """
SELECT time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events,
       CAST(censored AS BIGINT) AS censored,
       round(CASE WHEN zero > 0 THEN 0.0 ELSE exp(lg) END, 12) AS survival FROM (
  SELECT *, sum(CASE WHEN events < at_risk THEN ln(1.0 - events / at_risk) ELSE 0.0 END)
              OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lg,
            sum(CASE WHEN events >= at_risk THEN 1 ELSE 0 END)
              OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zero
  FROM (SELECT time, removed - events AS censored, events,
               sum(removed) OVER (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk,
               removed
        FROM (SELECT RecencyDays AS time, count(*) AS removed, sum(CAST(RecencyDays > 365 AS BIGINT)) AS events
              FROM cust_feats GROUP BY RecencyDays)))""")
def chn4_kaplan_meier(spark, sf_dir):
    out = ch.kaplan_meier(survival(spark, sf_dir, with_trend=False), "Time", "Churned")
    return finish(out, {"time": None, "at_risk": None, "events": None, "censored": None, "survival": 12})


@query("chn2_cox_model")
def chn2_cox_model(spark, sf_dir):
    res = ch.fit_cox(survival(spark, sf_dir), "Time", "Churned", COX_FEATURES, penalizer=0.0)
    return res.summary.withColumn("concordance_index", F.lit(res.concordance_index)) \
        .withColumn("log_likelihood", F.lit(res.log_likelihood))


@query("chn3_concordance", with_ctes("clv") + """,
d AS (SELECT CAST(Recency AS DOUBLE) AS t, CAST(Recency > 365 AS INTEGER) AS e, PredictedCLV AS r FROM clv)
SELECT round(sum(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0.0 END) / count(*), 12) AS concordance
FROM d a JOIN d b ON a.e = 1 AND b.t > a.t""")
def chn3_concordance(spark, sf_dir):
    clv = clv_table(spark, sf_dir).withColumn("Churned", (F.col("Recency") > 365).cast("int"))
    c = ch.concordance_index(clv, "Recency", "PredictedCLV", "Churned")
    return finish(spark.createDataFrame([(float(c),)], "concordance double"), {"concordance": 12})


@lru_cache(maxsize=8)
def _customers(spark, sf_dir):
    """What the classifiers read of all customers, made once for fits and scores."""
    return stored(survival(spark, sf_dir).select("CustomerID", "Churned", *ch.CHURN_FEATURES), "customers")


@lru_cache(maxsize=8)
def _classifier_metrics(spark, sf_dir, kind):
    """One fit serves all the queries of a session that read it."""
    model = ch.ChurnClassifier(kind)
    res = model.fit(_customers(spark, sf_dir), "Churned")
    return model, res


@query("chn5_rf_metrics")
def chn5_rf_metrics(spark, sf_dir):
    _, res = _classifier_metrics(spark, sf_dir, "random_forest")
    return spark.createDataFrame([(float(res["accuracy"]), float(res["roc_auc"]))], "accuracy double, roc_auc double")


@query("chn5_rf_report")
def chn5_rf_report(spark, sf_dir):
    _, res = _classifier_metrics(spark, sf_dir, "random_forest")
    return res["classification_report"]


@query("chn5_rf_confusion")
def chn5_rf_confusion(spark, sf_dir):
    _, res = _classifier_metrics(spark, sf_dir, "random_forest")
    return res["confusion_matrix"]


@query("chn5_rf_importance")
def chn5_rf_importance(spark, sf_dir):
    _, res = _classifier_metrics(spark, sf_dir, "random_forest")
    return res["feature_importance"]


@query("chn6_gbt_metrics")
def chn6_gbt_metrics(spark, sf_dir):
    _, res = _classifier_metrics(spark, sf_dir, "gbt")
    return spark.createDataFrame([(float(res["accuracy"]), float(res["roc_auc"]))], "accuracy double, roc_auc double")


@query("chn7_churn_probability")
def chn7_churn_probability(spark, sf_dir):
    """Fit, save to the shared checkpoint folder (SNK-1), reload, score all customers."""
    model, _ = _classifier_metrics(spark, sf_dir, "random_forest")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/churn_rf-{uuid.uuid4().hex}"
    model.save(path)
    reloaded = ch.ChurnClassifier("random_forest")
    reloaded.load(path)
    probs = reloaded.predict_proba(_customers(spark, sf_dir))
    return probs.withColumn("RiskSegment", ch.risk_segment(F.col("ChurnProbability")))


def _risk_inputs(spark, sf_dir):
    return clv_table(spark, sf_dir).withColumn("ChurnProbability", F.lit(1.0) - F.col("ProbAlive"))


@query("chn8_risk_score", with_ctes("clv") + """
SELECT CustomerID, round(CASE WHEN s IS NULL THEN NULL ELSE least(s, 100.0) END, 8) AS RiskScore FROM (
  SELECT CustomerID, 0.5 * (1.0 - ProbAlive) * 100.0 + 0.3 * (1.0 / (1.0 + exp(-(Recency / 180.0)))) * 100.0
         + 0.2 * (ln(1.0 + PredictedCLV) / ln(1.0 + 100000.0)) * 100.0 AS s FROM clv)""")
def chn8_risk_score(spark, sf_dir):
    df = _risk_inputs(spark, sf_dir)
    out = df.select("CustomerID", ch.churn_risk_score(F.col("ChurnProbability"), F.col("PredictedCLV"),
                                                      F.col("Recency")).alias("RiskScore"))
    return finish(out, {"CustomerID": None, "RiskScore": 8})


@query("chn9_risk_segments", with_ctes("clv") + """
SELECT CustomerID, CASE WHEN p >= 0.7 THEN 'High Risk' WHEN p >= 0.3 AND p < 0.7 THEN 'Medium Risk'
                        WHEN p < 0.3 THEN 'Low Risk' ELSE 'Unknown' END AS RiskSegment
FROM (SELECT CustomerID, 1.0 - ProbAlive AS p FROM clv)""")
def chn9_risk_segments(spark, sf_dir):
    return _risk_inputs(spark, sf_dir).select("CustomerID", ch.risk_segment(F.col("ChurnProbability")).alias("RiskSegment"))


@query("chn10_expected_loss", with_ctes("clv") + """
SELECT CASE WHEN p >= 0.7 THEN 'High Risk' WHEN p >= 0.3 AND p < 0.7 THEN 'Medium Risk' WHEN p < 0.3 THEN 'Low Risk' ELSE 'Unknown' END AS RiskSegment,
       count(*) AS Customers, round(avg(p), 10) AS AvgProbability, round(sum(p * PredictedCLV), 2) AS ExpectedLoss
FROM (SELECT 1.0 - ProbAlive AS p, PredictedCLV FROM clv) GROUP BY 1""")
def chn10_expected_loss(spark, sf_dir):
    out = ch.expected_loss(_risk_inputs(spark, sf_dir), "ChurnProbability", "PredictedCLV")
    return finish(out, {"RiskSegment": None, "Customers": None, "AvgProbability": 10, "ExpectedLoss": 2})


@query("chn11_risk_factors", with_ctes("cust_feats") + ", s AS (SELECT *, RecencyDays AS DaysSinceLastOrder, "
       "RecencyDays AS Time, CAST(RecencyDays > 365 AS INTEGER) AS Churned FROM cust_feats)\n"
       "SELECT Feature, round(Correlation, 10) AS Correlation FROM (\n" + "\nUNION ALL ".join(
           f"SELECT '{c}' AS Feature, abs(covar_samp({c}, Churned) / (stddev_samp({c}) * stddev_samp(Churned))) "
           f"AS Correlation FROM s WHERE {c} IS NOT NULL" for c in CHN11_FEATURES) +
       ") WHERE Correlation IS NOT NULL AND NOT isnan(Correlation) ORDER BY Correlation DESC, Feature LIMIT 10")
def chn11_risk_factors(spark, sf_dir):
    s = survival(spark, sf_dir).select("CustomerID", "Churned", "HighChurn", *CHN11_FEATURES)
    return finish(ch.risk_factors(s), {"Feature": None, "Correlation": 10})
