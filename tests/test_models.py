"""Fitted models without a SQL oracle: invariants, brute-force optima, same seed same result."""

import itertools
import math

import numpy as np
import pytest

from ledgerlens.functions import pvalues as pv
from ledgerlens.operators import churn as ch
from ledgerlens.operators import order_stats as os_
from ledgerlens.operators import segments as sg
from ledgerlens.operators import stats as st


@pytest.fixture(scope="module")
def customers(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(240):
        x, z = r.normal(), r.normal()
        rows.append((k, float(x), float(z), float(r.random()), int(x + 0.3 * z + r.normal() > 0.4), float(r.integers(1, 40))))
    return spark.createDataFrame(rows, "CustomerID long, a double, b double, c double, Churned int, Time double").cache()


@pytest.mark.parametrize("kind", ["random_forest", "gbt"])
def test_classifier(spark, customers, kind, tmp_path):
    model = ch.ChurnClassifier(kind, features=["a", "b", "c"])
    res = model.fit(customers)
    assert 0.5 < res["roc_auc"] <= 1 and 0 <= res["accuracy"] <= 1
    confusion = res["confusion_matrix"].collect()
    report = {r["class"]: r for r in res["classification_report"].collect()}
    held = sum(r["count"] for r in confusion)
    assert held == sum(r["support"] for r in report.values()) and abs(held - 48) <= 2
    assert res["accuracy"] == pytest.approx(sum(r["count"] for r in confusion if r["label"] == r["prediction"]) / held)
    importance = [r["importance"] for r in res["feature_importance"].collect()]
    assert sum(importance) == pytest.approx(1.0) and importance == sorted(importance, reverse=True)
    probs = {r[0]: r[1] for r in model.predict_proba(customers).collect()}
    assert len(probs) == 240 and all(0 <= p <= 1 for p in probs.values())
    path = str(tmp_path / "model")
    model.save(path)
    assert {r[0]: r[1] for r in ch.ChurnClassifier(kind, features=["a", "b", "c"]).predict_proba(customers, path).collect()} == probs


def test_unsaved_model_raises(customers):
    with pytest.raises(ValueError):
        ch.ChurnClassifier("gbt", features=["a"]).predict_proba(customers, "/tmp/no-such-model-here")


def test_cox_score_is_zero_at_the_solution(customers):
    fit = ch.fit_cox(customers, feature_cols=["a", "b"])
    beta = {r["covariate"]: r["coef"] for r in fit.summary.collect()}
    rows = [(r.Time, r.Churned, np.array([r.a, r.b])) for r in customers.collect()]
    w = np.array([beta["a"], beta["b"]])
    score = np.zeros(2)
    for t in {r[0] for r in rows if r[1]}:
        dead = [x for u, e, x in rows if u == t and e]
        risk = [x for u, _, x in rows if u >= t]
        s0, s1 = sum(math.exp(w @ x) for x in risk), sum(math.exp(w @ x) * x for x in risk)
        b0, b1 = sum(math.exp(w @ x) for x in dead), sum(math.exp(w @ x) * x for x in dead)
        for k, x in enumerate(dead):
            part = k / len(dead)
            score += x - (s1 - part * b1) / (s0 - part * b0)
    assert np.abs(score).max() < 1e-5


def test_projection_and_clusters(customers):
    z = sg.standardize(customers, ["a", "b", "c"])
    proj = np.array([[r.PC1, r.PC2] for r in sg.pca_projection(z, ["a", "b", "c"]).collect()])
    data = np.array([[r.a, r.b, r.c] for r in z.collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(data.T)))[::-1]
    assert np.var(proj, axis=0, ddof=1) == pytest.approx(values[:2], rel=1e-6)
    labels, cost, sil = sg.kmeans(z, ["a", "b", "c"], k=3, n_init=3)
    again = sg.kmeans(z, ["a", "b", "c"], k=3, n_init=3)
    assert cost == pytest.approx(again[1]) and -1 <= sil <= 1
    member = {r.CustomerID: r.Segment for r in labels.collect()}
    by = {}
    for r in z.collect():
        by.setdefault(member[r.CustomerID], []).append([r.a, r.b, r.c])
    inertia = sum(((np.array(v) - np.mean(v, axis=0)) ** 2).sum() for v in by.values())
    assert inertia == pytest.approx(cost, rel=0.02) and len(by) == 3


def test_long_density_cluster_stays_whole(spark):
    rows = [(k, float(k // 10) * 0.25 + 0.1, 0.0) for k in range(400)] + [(1000 + k, 30.0 + k, 9.0) for k in range(5)]
    out = sg.grid_density_clusters(spark.createDataFrame(rows, "CustomerID long, PC1 double, PC2 double"))
    got = {r.CustomerID: r.Segment for r in out.collect()}
    assert {got[k] for k in range(400)} == {0} and {got[1000 + k] for k in range(5)} == {-1}


def test_quantiles_with_infinities(spark):
    r = np.random.default_rng(2)
    v = [*r.normal(size=6000).tolist(), math.inf, math.inf, math.inf, -math.inf, None, 1e308, -1e308]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    want = np.sort([x for x in v if x is not None])
    got = {q["p"]: q["value"] for q in os_.exact_quantiles(df, "v", [0.0, 0.5, 1.0])}
    assert got == {0.0: -math.inf, 0.5: want[len(want) // 2] if len(want) % 2 else (want[len(want) // 2 - 1] + want[len(want) // 2]) / 2, 1.0: math.inf}


def test_spearman_ranks_pairwise_complete_rows(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 5.0), (3.0, 1.0, 2.0), (4.0, 5.0, None), (5.0, 4.0, 3.0), (None, 9.0, 4.0)]
    out = {(r.var1, r.var2): r.correlation for r in st.correlation_matrix(
        spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"], "spearman").collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate("xyz"), 2):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        ranks = [np.argsort(np.argsort([p[k] for p in both])) for k in (0, 1)]
        assert out[(a, b)] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert out[("x", "x")] == pytest.approx(1.0)


def granger_brute(effect, cause, max_lag):
    """Least squares for each lag, one after the other."""
    out, n = [], len(effect)
    ssr = lambda y, x: float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))
    for lag in range(1, max_lag + 1):
        own, other = (np.column_stack([s[lag - k:n - k] for k in range(1, lag + 1)]) for s in (effect, cause))
        ones, y = np.ones((n - lag, 1)), effect[lag:]
        r, u = ssr(y, np.hstack([ones, own])), ssr(y, np.hstack([ones, own, other]))
        out.append(pv.chi2_sf((n - lag) * (r - u) / u, lag))
    return min(out)


def test_granger_against_least_squares():
    from ledgerlens.operators.timeseries import chi2_tails, granger_p
    r = np.random.default_rng(9)
    x, noise = r.normal(size=200), r.normal(size=200)
    y = np.concatenate([[0.0], x[:-1]]) + 0.3 * noise
    series = np.stack([x, y, noise, r.normal(size=200) * 1e6 + 1e7, r.gamma(0.2, 1e5, 200) * (r.random(200) < 0.1)])
    got = granger_p(series, series, 4)
    for c, e in itertools.permutations(range(len(series)), 2):
        assert got[c, e] == pytest.approx(granger_brute(series[e], series[c], 4), rel=1e-6, abs=1e-12)
    assert got[0, 1] < 1e-10
    constant = granger_p(np.stack([x, np.full(200, 5.0)]), np.stack([y, np.full(200, 3.0)]), 2)
    assert np.isnan(constant[0, 1]) and not np.isnan(constant[0, 0])
    for dof in range(1, 8):
        v = np.array([0.0, 0.3, 2.0, 11.0, 60.0])
        assert chi2_tails(v, dof) == pytest.approx([pv.chi2_sf(z, dof) if z else 1.0 for z in v], rel=1e-9)


def test_granger_blocks_change_nothing(spark):
    from ledgerlens.operators.timeseries import granger_matrix
    r = np.random.default_rng(1)
    rows = [(f"c{c}", f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 10:00:00", round(float(r.gamma(1, 100)), 4)) for c in range(7) for d in range(0, 330, 3) if r.random() < 0.9]
    sales = spark.createDataFrame(rows, "CategoryName string, d string, TotalDue double").selectExpr("CategoryName", "timestamp(d) AS OrderDate", "TotalDue")
    one = {(x.cause, x.effect): x.p_value for x in granger_matrix(sales).collect()}
    many = {(x.cause, x.effect): x.p_value for x in granger_matrix(sales, block=2).collect()}
    assert len(one) == 42 and one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)
    assert granger_matrix(sales.where("OrderDate < '2024-02-20'")).count() == 0


def test_p_values_for_many_degrees_of_freedom():
    assert pv.f_sf(1.0, 5e9, 5e9) == pytest.approx(0.5, abs=1e-9)
    assert pv.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert pv.t_sf_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, rel=1e-6)
    assert pv.betainc(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-12)


def test_fit_makes_its_rows_once(spark, customers, monkeypatch):
    """A fit reads its customers many times, but they are made one time."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    model = ch.ChurnClassifier(features=["a", "b", "c"])
    make = model._pipeline
    monkeypatch.setattr(model, "_pipeline", lambda: (p := make(), p.getStages()[-1].setNumTrees(3))[0])
    res = model.fit(customers.mapInPandas(count, customers.schema))
    assert made.value == 240
    assert sum(r["count"] for r in res["confusion_matrix"].collect()) == sum(r["support"] for r in res["classification_report"].collect())


def test_kept_nodes_give_the_same_trees(spark, customers):
    data = ch.ChurnClassifier(features=["a", "b", "c"]).prepare(customers, "Churned").cache()
    pipeline = ch.ChurnClassifier(features=["a", "b", "c"])._pipeline()
    forest = pipeline.getStages()[-1].setNumTrees(4)
    assert forest.getCacheNodeIds()
    kept = pipeline.fit(data).stages[-1].toDebugString
    forest.setCacheNodeIds(False)
    sought = pipeline.fit(data).stages[-1].toDebugString
    assert kept.split("\n")[1:] == sought.split("\n")[1:]


def test_scores_read_the_features_of_the_fit(spark, monkeypatch):
    """chn7 makes the features of all customers one time, for the fit and for the scores."""
    from ledgerlens.plans import q_churn

    class Model(ch.ChurnClassifier):
        def fit(self, df, label="Churned"):
            return {"rows": df.count()}

        def save(self, path):
            pass

        load = save

        def predict_proba(self, df, path=None):
            return df.selectExpr("CustomerID", "0.5D AS ChurnProbability")

    calls, make = [], q_churn.survival
    monkeypatch.setattr(q_churn, "survival", lambda *a, **k: calls.append(a) or make(*a, **k))
    monkeypatch.setattr(ch, "ChurnClassifier", Model)
    try:
        q_churn._classifier_metrics.cache_clear()
        scored = q_churn.chn7_churn_probability(spark, "/root/testdata/sf0.001").collect()
        assert len(scored) == len({r.CustomerID for r in scored}) > 100 and len(calls) == 1
    finally:
        q_churn._classifier_metrics.cache_clear()
