"""Registered queries: standardisation, projection, clustering, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as feat
from ledgerlens.operators import segments as sg
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import clv_table, segmented_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes
from ledgerlens.session import stored

PROFILE_FEATURES = ["TotalSpend", "Frequency", "RecencyDays"]


def _finite_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 WHEN {c} = 'inf'::DOUBLE THEN 1e6 "
            f"WHEN {c} = '-inf'::DOUBLE THEN -1e6 ELSE CAST({c} AS DOUBLE) END")


@query("prj9_standardized_features", with_ctes("clv") + ", f AS (SELECT CustomerID, " + ", ".join(
    f"{_finite_sql(c)} AS {c}" for c in sg.GENOME_FEATURES) + " FROM clv)\nSELECT CustomerID, " + ", ".join(
    f"round(CASE WHEN (SELECT stddev_pop({c}) FROM f) > 0 THEN ({c} - (SELECT avg({c}) FROM f)) / "
    f"(SELECT stddev_pop({c}) FROM f) ELSE 0.0 END, 8) AS {c}" for c in sg.GENOME_FEATURES) + " FROM f")
def prj9_standardized_features(spark, sf_dir):
    out = sg.standardize(clv_table(spark, sf_dir), sg.GENOME_FEATURES)
    return finish(out, {"CustomerID": None, **{c: 8 for c in sg.GENOME_FEATURES}})


@query("seg1_pca_projection")
def seg1_pca_projection(spark, sf_dir):
    seg = segmented_table(spark, sf_dir)
    proj = sg.pca_projection(seg)
    return proj.join(seg.select("CustomerID", "Segment", "PredictedCLV"), "CustomerID", "left")


@query("seg2_density_clusters")
def seg2_density_clusters(spark, sf_dir):
    proj = sg.pca_projection(clv_table(spark, sf_dir))
    return sg.grid_density_clusters(proj, cell=sg.density_cell(proj), min_samples=10, min_cluster_size=30)


@query("seg2_density_report")
def seg2_density_report(spark, sf_dir):
    proj = stored(sg.pca_projection(clv_table(spark, sf_dir)), "projection")
    labels = stored(sg.grid_density_clusters(proj, cell=sg.density_cell(proj), min_samples=10, min_cluster_size=30), "labels")
    return sg.density_report(proj, labels)


@query("seg3_kmeans_segments")
def seg3_kmeans_segments(spark, sf_dir):
    z = sg.standardize(clv_table(spark, sf_dir), sg.GENOME_FEATURES)
    labels, _, _ = sg.kmeans(z, sg.GENOME_FEATURES, k=5)
    return labels


@query("seg4_kmeans_quality")
def seg4_kmeans_quality(spark, sf_dir):
    z = sg.standardize(clv_table(spark, sf_dir), sg.GENOME_FEATURES)
    labels, inertia, sil = sg.kmeans(z, sg.GENOME_FEATURES, k=5)
    n = labels.groupBy("Segment").count().count()
    return spark.createDataFrame([(5, int(n), inertia, sil)], "k int, clusters bigint, inertia double, silhouette double")


@query("seg5_optimal_k")
def seg5_optimal_k(spark, sf_dir):
    z = sg.standardize(clv_table(spark, sf_dir), sg.GENOME_FEATURES).persist()
    curve = sg.inertia_curve(z, sg.GENOME_FEATURES, max_clusters=10)
    inertias = [c for _, c in curve]
    k_ref, k_elbow = sg.optimal_k(inertias, "reference"), sg.optimal_k(inertias, "elbow")
    return spark.createDataFrame([(k, c, k_ref, k_elbow) for k, c in curve],
                                 "k int, inertia double, optimal_k_reference int, optimal_k_elbow int")


def _profile_input(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    f = feat.engineer_customer_features(cat.sales_lines(), cat.customers(), with_trend=False)
    return f.select("CustomerID", F.col("TerritoryID").cast("int").alias("Label"), "TotalSpend",
                    F.col("NumOrders").alias("Frequency"), "RecencyDays")


PROFILE_SQL_BASE = with_ctes("sales", "customers") + """,
p AS (SELECT a.CustomerID, CAST(k.TerritoryID AS INTEGER) AS Label, a.TotalSpend, a.Frequency,
             datesub('day', a.LastOrder, (SELECT max(OrderDate) FROM sales)) AS RecencyDays
      FROM (SELECT CustomerID, CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS TotalSpend,
                   count(DISTINCT SalesOrderID) AS Frequency, max(OrderDate) AS LastOrder
            FROM sales GROUP BY CustomerID) a LEFT JOIN customers k ON a.CustomerID = k.CustomerID),
prof AS (SELECT CASE WHEN Label = -1 THEN 'Noise/Outliers' ELSE 'Segment ' || CAST(Label AS VARCHAR) END AS Segment,
                Label, count(*) AS Size, count(*) / (SELECT count(*) FROM p) * 100.0 AS Percentage, """ + ", ".join(
    f"avg({c}) AS {c}_mean, median({c}) AS {c}_median, stddev_samp({c}) AS {c}_std" for c in PROFILE_FEATURES) + """
         FROM p GROUP BY Label)"""

PROFILE_SPEC = {"Segment": None, "Label": None, "Size": None, "Percentage": 8,
                **{f"{c}_{s}": 6 for c in PROFILE_FEATURES for s in ("mean", "median", "std")}}


@query("seg6_segment_profiles", PROFILE_SQL_BASE + "\nSELECT " + ", ".join(
    f"round({c}, {d}) AS {c}" if d is not None else c for c, d in PROFILE_SPEC.items()) + " FROM prof")
def seg6_segment_profiles(spark, sf_dir):
    out = sg.profile_segments(_profile_input(spark, sf_dir), "Label", PROFILE_FEATURES)
    return finish(out.withColumn("Size", F.col("Size").cast("bigint")), PROFILE_SPEC)


@query("seg7_segment_names", PROFILE_SQL_BASE + """
SELECT Segment, Label, CASE
    WHEN hv AND fr AND rc THEN 'VIP Champions' WHEN hv AND fr THEN 'At-Risk VIPs' WHEN hv THEN 'Big Spenders'
    WHEN fr AND rc THEN 'Loyal Regulars' WHEN rc THEN 'New Active' WHEN fr THEN 'Loyal but Lapsing'
    ELSE 'At Risk' END AS Name
FROM (SELECT Segment, Label, TotalSpend_mean > (SELECT median(TotalSpend_mean) FROM prof) AS hv,
             Frequency_mean > (SELECT median(Frequency_mean) FROM prof) AS fr,
             RecencyDays_mean < (SELECT median(RecencyDays_mean) FROM prof) AS rc FROM prof)""")
def seg7_segment_names(spark, sf_dir):
    prof = sg.profile_segments(_profile_input(spark, sf_dir), "Label", PROFILE_FEATURES)
    return sg.assign_segment_names(prof)
