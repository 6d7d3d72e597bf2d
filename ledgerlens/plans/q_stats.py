"""Registered queries: hypothesis tests, correlations, bootstrap (STA-1..5)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ledgerlens.functions import pvalues as pv
from ledgerlens.operators import stats as st
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import clv_table, rfm_table, segmented_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes

CORR_COLS = ["Recency", "Frequency", "Monetary", "Age", "AvgOrderValue"]
TEST_SPEC = {"chi2": 8, "p_value": 8, "degrees_of_freedom": None, "significant": None}


def _typed_clv(spark, sf_dir):
    clv = clv_table(spark, sf_dir)
    k = catalog(spark, sf_dir).customers().select(
        "CustomerID", "Segment", F.when(F.col("StoreID").isNotNull(), "Store").otherwise("Individual")
        .alias("CustomerType"))
    return clv.join(k, "CustomerID", "left").withColumn("Churned", (F.col("Recency") > 365).cast("int"))


def _chi_sql(a: str, b: str, yates: bool) -> str:
    if yates:
        cell = ("(o + CASE WHEN e - o > 0 THEN least(0.5, e - o) WHEN e - o < 0 THEN -least(0.5, o - e) ELSE 0 END"
                " - e) * (o + CASE WHEN e - o > 0 THEN least(0.5, e - o) WHEN e - o < 0 THEN -least(0.5, o - e)"
                " ELSE 0 END - e) / e")
    else:
        cell = "(o - e) * (o - e) / e"
    return with_ctes("clv", "customers") + f""",
d AS (SELECT {a} AS a, {b} AS b FROM clv c LEFT JOIN customers k ON c.CustomerID = k.CustomerID),
obs AS (SELECT a, b, count(*) AS o FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
tot AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM obs),
grid AS (SELECT x.a, y.b, coalesce(obs.o, 0) AS o, CAST(x.r AS DOUBLE) * CAST(y.c AS DOUBLE) / tot.n AS e
         FROM (SELECT a, sum(o) AS r FROM obs GROUP BY a) x, (SELECT b, sum(o) AS c FROM obs GROUP BY b) y, tot
         LEFT JOIN obs ON obs.a = x.a AND obs.b = y.b),
s AS (SELECT sum({cell}) AS chi, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM grid)
SELECT round(chi, 8) AS chi2, round({pv.sql_chi2_sf('chi', 'dof')}, 8) AS p_value,
       dof AS degrees_of_freedom, {pv.sql_chi2_sf('chi', 'dof')} < 0.05 AS significant FROM s"""


@query("sta1_chi_square", _chi_sql("k.Segment", "CAST(c.Recency > 365 AS INTEGER)", False))
def sta1_chi_square(spark, sf_dir):
    return finish(st.chi_square_test(_typed_clv(spark, sf_dir), "Segment", "Churned"), TEST_SPEC)


@query("sta1_chi_square_yates", _chi_sql("CASE WHEN k.StoreID IS NOT NULL THEN 'Store' ELSE 'Individual' END",
                                         "CAST(c.Recency > 365 AS INTEGER)", True))
def sta1_chi_square_yates(spark, sf_dir):
    return finish(st.chi_square_test(_typed_clv(spark, sf_dir), "CustomerType", "Churned"), TEST_SPEC)


@query("sta1_expected_counts", with_ctes("clv", "customers") + """,
d AS (SELECT k.Segment AS a, CAST(c.Recency > 365 AS INTEGER) AS b FROM clv c LEFT JOIN customers k ON c.CustomerID = k.CustomerID),
obs AS (SELECT a, b, count(*) AS o FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b)
SELECT a AS Segment, b AS Churned, o AS observed,
       round(sum(o) OVER (PARTITION BY a)::DOUBLE * sum(o) OVER (PARTITION BY b)::DOUBLE / sum(o) OVER ()::DOUBLE, 8) AS expected
FROM obs""")
def sta1_expected_counts(spark, sf_dir):
    out = st.contingency(_typed_clv(spark, sf_dir), "Segment", "Churned")
    return finish(out, {"Segment": None, "Churned": None, "observed": None, "expected": 8})


@query("sta1_goodness_of_fit", with_ctes("customers") + f""",
o AS (SELECT Segment, count(*)::DOUBLE AS n FROM customers WHERE Segment IS NOT NULL GROUP BY Segment),
s AS (SELECT sum((n - e) * (n - e) / e) AS chi, count(*) - 1 AS dof FROM o, (SELECT avg(n) AS e FROM o))
SELECT round(chi, 8) AS chi2, round({pv.sql_chi2_sf('chi', 'dof')}, 8) AS p_value, dof AS degrees_of_freedom,
       {pv.sql_chi2_sf('chi', 'dof')} < 0.05 AS significant FROM s""")
def sta1_goodness_of_fit(spark, sf_dir):
    """Customers per market segment against equal shares."""
    counts = catalog(spark, sf_dir).customers().where(F.col("Segment").isNotNull()).groupBy("Segment").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    equal = counts.agg(F.avg("n").alias("e"))  # one row
    return finish(st.chi_square_goodness_of_fit(counts.withColumn("e", equal.scalar()), "n", "e"), TEST_SPEC)


@query("sta2_t_test", with_ctes("clv", "customers") + f""",
g AS (SELECT CASE WHEN k.StoreID IS NOT NULL THEN 'Store' ELSE 'Individual' END AS grp, c.PredictedCLV AS v
      FROM clv c LEFT JOIN customers k ON c.CustomerID = k.CustomerID WHERE c.PredictedCLV IS NOT NULL),
m AS (SELECT (SELECT count(*) FROM g WHERE grp = 'Store') AS n1, (SELECT avg(v) FROM g WHERE grp = 'Store') AS m1,
             (SELECT var_samp(v) FROM g WHERE grp = 'Store') AS s1,
             (SELECT count(*) FROM g WHERE grp = 'Individual') AS n2, (SELECT avg(v) FROM g WHERE grp = 'Individual') AS m2,
             (SELECT var_samp(v) FROM g WHERE grp = 'Individual') AS s2),
t AS (SELECT *, sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS sp FROM m),
u AS (SELECT *, (m1 - m2) / (sp * sqrt(1.0 / n1 + 1.0 / n2)) AS tstat, (m1 - m2) / sp AS d FROM t)
SELECT round(tstat, 8) AS t_statistic, round({pv.sql_t_sf_two_sided('tstat', 'n1 + n2 - 2')}, 8) AS p_value,
       {pv.sql_t_sf_two_sided('tstat', 'n1 + n2 - 2')} < 0.05 AS significant, round(d, 8) AS cohens_d,
       CASE WHEN abs(d) > 0.8 THEN 'large' WHEN abs(d) > 0.5 THEN 'medium' ELSE 'small' END AS effect_size FROM u""")
def sta2_t_test(spark, sf_dir):
    out = st.t_test(_typed_clv(spark, sf_dir), "CustomerType", "PredictedCLV", "Store", "Individual")
    return finish(out, {"t_statistic": 8, "p_value": 8, "significant": None, "cohens_d": 8, "effect_size": None})


@query("sta3_anova", with_ctes("segmented") + f""",
g AS (SELECT Segment, count(*) AS n, avg(PredictedCLV) AS mean, coalesce(var_samp(PredictedCLV), 0.0) AS var
      FROM segmented WHERE Segment IS NOT NULL AND PredictedCLV IS NOT NULL GROUP BY Segment),
a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * mean) / sum(n) AS grand FROM g),
s AS (SELECT a.n, a.k, sum(g.n * (g.mean - a.grand) * (g.mean - a.grand)) AS ssb, sum((g.n - 1) * g.var) AS ssw
      FROM g, a GROUP BY a.n, a.k),
f AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS fstat, ssb / (ssb + ssw) AS eta FROM s)
SELECT round(fstat, 8) AS f_statistic, round({pv.sql_f_sf('fstat', 'k - 1', 'n - k')}, 8) AS p_value,
       {pv.sql_f_sf('fstat', 'k - 1', 'n - k')} < 0.05 AS significant, round(eta, 10) AS eta_squared,
       CASE WHEN eta > 0.14 THEN 'large' WHEN eta > 0.06 THEN 'medium' ELSE 'small' END AS effect_size FROM f""")
def sta3_anova(spark, sf_dir):
    out = st.anova(segmented_table(spark, sf_dir), "Segment", "PredictedCLV")
    return finish(out, {"f_statistic": 8, "p_value": 8, "significant": None, "eta_squared": 10, "effect_size": None})


def _corr_sql(source: str) -> str:
    parts = []
    for a, b in list(combinations(CORR_COLS, 2)) + [(c, c) for c in CORR_COLS]:
        sel = (f"SELECT covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) AS r, count(*) AS n "
               f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
        parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, r, n FROM ({sel})")
        if a != b:
            parts.append(f"SELECT '{b}' AS var1, '{a}' AS var2, r, n FROM ({sel})")
    return "pairs AS (" + "\nUNION ALL ".join(parts) + ")"


CORR_FINAL = f"""
SELECT var1, var2, round(r, 10) AS correlation,
       round({pv.sql_betainc('(n - 2) / 2.0', '0.5', 'greatest(0.0, 1.0 - r * r)')}, 8) AS p_value, n FROM pairs"""


@query("sta4_correlation_pearson", with_ctes("rfm") + ", " + _corr_sql("rfm") + CORR_FINAL)
def sta4_correlation_pearson(spark, sf_dir):
    out = st.correlation_matrix(rfm_table(spark, sf_dir), CORR_COLS, "pearson")
    return finish(out, {"var1": None, "var2": None, "correlation": 10, "p_value": 8, "n": None})


RANKED = "ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in CORR_COLS) + " FROM rfm)"


@query("sta4_correlation_spearman", with_ctes("rfm") + ", " + RANKED + ", " + _corr_sql("ranked") + CORR_FINAL)
def sta4_correlation_spearman(spark, sf_dir):
    out = st.correlation_matrix(rfm_table(spark, sf_dir), CORR_COLS, "spearman")
    return finish(out, {"var1": None, "var2": None, "correlation": 10, "p_value": 8, "n": None})


POISSON_SQL = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in st.POISSON1_CDF)


def _bootstrap_sql(statistic: str, digits: int) -> str:
    """1,000 replicates; digest b // 4 of a row weighs it in replicate b."""
    own = {"mean": "avg(v)", "sum": "sum(v)", "std": "stddev_pop(v)", "median": "median(v)"}[statistic]
    reps = {
        "mean": "SELECT b, sum(w * v) / sum(w) AS stat FROM w GROUP BY b",
        "sum": "SELECT b, sum(w * v) / sum(w) * (SELECT count(*) FROM x) AS stat FROM w GROUP BY b",
        "std": "SELECT b, sqrt(greatest(sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) * (sum(w * d) / sum(w)), 0.0)) AS stat "
               "FROM (SELECT b, w, v - (SELECT avg(v) FROM x) AS d FROM w) GROUP BY b",
        "median": """SELECT b, (max(v) FILTER (upto >= (n + 1) // 2 AND upto - w < (n + 1) // 2) + max(v) FILTER (upto >= n // 2 + 1 AND upto - w < n // 2 + 1)) / 2 AS stat
FROM (SELECT b, v, w, sum(w) OVER (PARTITION BY b ORDER BY v, k ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY b) AS n FROM w WHERE w > 0) GROUP BY b""",
    }[statistic]
    return with_ctes("clv") + f""",
x AS (SELECT CustomerID AS k, PredictedCLV AS v FROM clv WHERE PredictedCLV IS NOT NULL),
u AS (SELECT k, v, b, CAST(('0x' || substr(md5(CAST(k AS VARCHAR) || ':' || CAST(b // 4 AS VARCHAR)), 1 + 8 * (b % 4), 8))::BIGINT AS DOUBLE)
                   / 4294967296.0::DOUBLE AS u FROM x, range(0, 1000) r(b)),
w AS (SELECT k, v, b, {POISSON_SQL} AS w FROM u),
reps AS ({reps})
SELECT round((SELECT {own} FROM x), {digits}) AS statistic, round(quantile_cont(stat, 0.025), {digits}) AS ci_lower,
       round(quantile_cont(stat, 0.975), {digits}) AS ci_upper, round(avg(stat), {digits}) AS bootstrap_mean,
       round(stddev_pop(stat), {digits}) AS bootstrap_std, 0.95::DOUBLE AS confidence_level FROM reps"""


def _bootstrap(spark, sf_dir, statistic: str, digits: int):
    out = st.bootstrap_ci(clv_table(spark, sf_dir), "CustomerID", "PredictedCLV", 1000, 0.95, statistic)
    return finish(out, {**dict.fromkeys(["statistic", "ci_lower", "ci_upper", "bootstrap_mean", "bootstrap_std"], digits), "confidence_level": None})


@query("sta5_bootstrap_ci", _bootstrap_sql("mean", 4))
def sta5_bootstrap_ci(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "mean", 4)


@query("sta5_bootstrap_median", _bootstrap_sql("median", 4))
def sta5_bootstrap_median(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "median", 4)


@query("sta5_bootstrap_sum", _bootstrap_sql("sum", 2))
def sta5_bootstrap_sum(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "sum", 2)


@query("sta5_bootstrap_std", _bootstrap_sql("std", 4))
def sta5_bootstrap_std(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "std", 4)
