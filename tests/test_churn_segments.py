import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import churn as ch
from ledgerlens.operators import segments as sg


def test_kaplan_meier_x20(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1)], "Time int, Churned int")
    assert [r["survival"] for r in ch.kaplan_meier(df).orderBy("time").collect()] == [0.75, 0.5, 0.0]


def test_cox_x21(spark):
    df = spark.createDataFrame([(1.0, 1, 1.0), (2.0, 1, 0.0), (3.0, 1, 1.0), (4.0, 1, 0.0)],
                               "Time double, Churned int, x double")
    res = ch.fit_cox(df, feature_cols=["x"])
    coef = res.summary.collect()[0]["coef"]
    assert coef == pytest.approx(math.log((1 + math.sqrt(17)) / 2), abs=1e-8)


def test_concordance_matches_pairs(spark):
    random.seed(3)
    rows = [(float(random.randint(1, 30)), random.randint(0, 1), float(random.randint(0, 10))) for _ in range(300)]
    d = spark.createDataFrame(rows, "t double, e int, r double")
    num = den = 0.0
    for ti, ei, ri in rows:
        if ei:
            for tj, _, rj in rows:
                if tj > ti:
                    den += 1
                    num += 1.0 if ri > rj else 0.5 if ri == rj else 0.0
    assert ch.concordance_index(d, "t", "r", "e") == pytest.approx(num / den)


def test_optimal_k_x25():
    assert sg.optimal_k([100, 90, 40, 35, 33], "reference") == 2
    assert sg.optimal_k([100, 90, 40, 35, 33], "elbow") == 4
    assert sg.optimal_k([100, 90]) == 2


def test_grid_density_clusters(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(
        list(rng.normal(0, 0.1, (80, 2))) + list(rng.normal(5, 0.1, (80, 2))) + [(20.0, 20.0)])]
    df = spark.createDataFrame(pts, "CustomerID long, PC1 double, PC2 double")
    lab = {r["CustomerID"]: r["Segment"] for r in
           sg.grid_density_clusters(df, cell=0.25, min_samples=5, min_cluster_size=30).collect()}
    assert lab[160] == -1
    assert len({lab[i] for i in range(80)} - {-1}) == 1
    assert {lab[i] for i in range(80)} != {lab[i] for i in range(80, 160)}


def test_profiles_and_names(spark):
    rows = [(i, i % 3, float(i % 3) * 100 + 1, float(i % 3), float(10 - i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "CustomerID long, Label int, TotalSpend double, Frequency double, RecencyDays double")
    prof = sg.profile_segments(df, "Label", ["TotalSpend", "Frequency", "RecencyDays"])
    got = {r["Segment"]: r for r in prof.collect()}
    assert got["Segment 2"]["Size"] == 10 and got["Segment 2"]["Percentage"] == pytest.approx(100 / 3)
    names = {r["Label"]: r["Name"] for r in sg.assign_segment_names(prof).collect()}
    assert names[2] == "VIP Champions" and names[0] == "At Risk"


def test_classifier_requires_model(spark):
    clf = ch.ChurnClassifier()
    with pytest.raises(ValueError):
        clf.predict_proba(spark.createDataFrame([(1,)], "CustomerID long"))


def test_efron_ties_in_closed_form():
    import time
    r = np.random.default_rng(5)
    d = np.array([1, 2, 7, 16, 17, 40, 500, 3000, 25], dtype=float)
    b0 = r.uniform(0.5, 2.0, len(d)) * d
    s0 = b0 * np.array([1.0, 3.0, 1.0, 50.0, 1.0, 1.0001, 1.0, 200.0, 1e5])
    got = ch.efron_ties(s0, b0, d)
    for k in range(len(d)):
        f = np.arange(d[k]) / d[k]
        phi = s0[k] - f * b0[k]
        want = [np.log(phi).sum(), (1 / phi).sum(), (f / phi).sum(), (phi**-2).sum(), (f / phi**2).sum(), (f**2 / phi**2).sum()]
        assert [g[k] for g in got] == pytest.approx(want, rel=1e-9)
    begin = time.time()
    large = ch.efron_ties(np.array([2e7]), np.array([1e7]), np.array([1e7]))
    assert time.time() - begin < 1 and large[1][0] == pytest.approx(math.log(2), rel=1e-6)  # the integral of 1 / (2 - x)


def cox_brute(t, e, x):
    """Newton steps on the Efron likelihood, tie by tie."""
    x = (x - x.mean(axis=0)) / (scale := x.std(axis=0, ddof=1))
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        w, g, h = np.exp(x @ beta), np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for time in np.unique(t[e == 1]):
            risk, tied = t >= time, (t == time) & (e == 1)
            g += x[tied].sum(axis=0)
            for m in range(tied.sum()):
                weight = risk * w - m / tied.sum() * (tied * w)
                mean = weight @ x / weight.sum()
                g -= mean
                h -= (x.T * weight) @ x / weight.sum() - np.outer(mean, mean)
        beta = beta - np.linalg.solve(h, g)
    return beta / scale, np.sqrt(np.diag(np.linalg.inv(-h))) / scale


@pytest.mark.parametrize("tied", [True, False])
def test_cox_against_plain_newton(spark, tied):
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(size=150), r.gamma(2.0, size=150), r.integers(0, 2, 150)])
    t = r.exponential(np.exp(-0.5 * x[:, 0] + 0.3 * x[:, 1])) * 10
    t = np.ceil(t) if tied else t
    t[:50] = 4.0  # a third of all rows at one time
    e = (r.random(150) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), int(b), *map(float, c)) for a, b, c in zip(t, e, x)], "Time double, Churned int, x double, y double, z double")
    got = ch.fit_cox(df, feature_cols=["x", "y", "z"]).summary.collect()
    coef, se = cox_brute(t, e, x)
    assert [c.coef for c in got] == pytest.approx(coef.tolist(), rel=1e-6)
    assert [c.se_coef for c in got] == pytest.approx(se.tolist(), rel=1e-6)


def test_survival_curve_of_timestamps(spark):
    r = np.random.default_rng(7)
    t, e = r.integers(0, 10**12, 3000).tolist(), r.integers(0, 2, 3000).tolist()
    t[:1000] = [5 * 10**11] * 1000
    df = spark.createDataFrame(list(zip(t, e)), "Time long, Churned int").repartition(5)
    curve = ch.kaplan_meier(df)
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    order, s, want = sorted(set(t)), 1.0, []
    arr, ev = np.array(t), np.array(e)
    for time in order:
        risk, d = int((arr >= time).sum()), int(((arr == time) & (ev == 1)).sum())
        s *= 1 - d / risk
        want.append((time, risk, d, s))
    got = sorted((x.time, x.at_risk, x.events, x.survival) for x in curve.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


def test_prefix_sums_of_several_columns(spark):
    from ledgerlens.operators.order_stats import prefix_sums
    r = np.random.default_rng(1)
    rows = [(int(k), int(r.integers(0, 9)), None if k % 11 == 0 else float(r.normal())) for k in r.permutation(500)]
    got = sorted(map(tuple, prefix_sums(spark.createDataFrame(rows, "k long, a long, b double"), ["k"], ["a", "b"], num_partitions=6).collect()))
    a, b = np.cumsum([x[1] for x in sorted(rows)]), np.cumsum([x[2] or 0.0 for x in sorted(rows)])
    assert [x[3] for x in got] == a.tolist()
    assert [x[4] for x in got if x[4] is not None] == pytest.approx([v for v, x in zip(b, got) if x[4] is not None])


def test_density_cell_and_report(spark):
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(0, 0.1, (200, 2)), rng.normal(5, 0.1, (200, 2)), rng.uniform(-20, 20, (40, 2))])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "CustomerID long, PC1 double, PC2 double")
    cell = sg.density_cell(points)
    side = lambda k: np.ptp(xy, axis=0).max() / 2.0**k
    held = []
    for k in range(sg.CELL_STEPS):
        _, at, n = np.unique(np.floor((xy - xy.min(axis=0)) / side(k)), axis=0, return_inverse=True, return_counts=True)
        held.append((n[at] >= 10).sum())
    assert cell == side(max(k for k, h in enumerate(held) if 2 * h >= len(xy)))
    assert sg.density_cell(points.limit(0)) == 1.0
    labels = sg.grid_density_clusters(points, cell=cell, min_samples=10, min_cluster_size=30)
    got = {r.CustomerID: r.Segment for r in labels.collect()}
    row = sg.density_report(points, labels).collect()[0]
    assert row["n_noise"] == sum(v < 0 for v in got.values()) and row["n_clusters"] == len(set(got.values()) - {-1})
    own = np.array([got[i] for i in range(len(xy))])
    if row["n_clusters"] > 1:  # squared Euclidean silhouette by all pairs
        keep = own >= 0
        d = ((xy[keep][:, None] - xy[keep][None]) ** 2).sum(axis=2)
        s = []
        for i, c in enumerate(own[keep]):
            same = own[keep] == c
            a = d[i, same].sum() / (same.sum() - 1)
            b = min(d[i, own[keep] == o].mean() for o in set(own[keep]) - {c})
            s.append((b - a) / max(a, b))
        assert row["silhouette"] == pytest.approx(np.mean(s))
    assert row["n_clusters"] >= 2


def test_kmeans_passes_over_few_partitions(spark):
    """Rows dealt over many partitions are brought to few, few ones stay; the best fits are those made one after the other."""
    from pyspark.ml.clustering import KMeans
    many = spark.range(0, 60, 1, 90).selectExpr("id AS CustomerID", "double(id % 3) AS a", "double(id * id % 17) AS b")
    rows = sg._training_rows(many, ["a", "b"], "CustomerID")
    assert rows.count() == 60 and rows.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sg._training_rows(many.coalesce(2), ["a", "b"], "CustomerID").rdd.getNumPartitions() == 2
    one_by_one = [min(KMeans(k=k, seed=42 + i).fit(rows).summary.trainingCost for i in range(2)) for k in (2, 3)]
    assert [c for _, c in sg._best_fits(rows, [2, 3], 42, 2)] == pytest.approx(one_by_one)


def test_trees_pass_over_few_partitions(spark, monkeypatch):
    """Rows of many partitions come in one for each core, or more of them where there are many rows; none is lost."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, 10 * cores)
    few = ch.tree_rows(rows)
    assert few.rdd.getNumPartitions() == cores
    assert sorted(r.id for r in few.collect()) == list(range(1000))
    monkeypatch.setattr(ch, "TREE_ROWS", math.ceil(500 / cores))
    assert ch.tree_rows(rows).rdd.getNumPartitions() == 2 * cores
    assert ch.tree_rows(spark.range(0, 1000, 1, 2)).rdd.getNumPartitions() == 2
    assert ch.tree_rows(spark.range(0)).count() == 0
    # the classifier trains on them
    seen = []
    monkeypatch.setattr(ch, "tree_rows", lambda train: (seen.append(train), few.sparkSession.createDataFrame([], train.schema))[1])
    with pytest.raises(Exception):
        ch.ChurnClassifier(features=["a"]).fit(spark.range(20).selectExpr("id AS CustomerID", "id * 1.0 AS a", "id % 2 AS Churned"))
    assert len(seen) == 1
