"""Churn and survival (CHN-2..11, SNK-1).

* Kaplan-Meier and the Cox partial likelihood need per-distinct-time sums,
  which combine before the shuffle however many rows share a time, and running
  sums of those over ranges of time.  Times may be timestamps: nothing per
  distinct time reaches the driver, which gets one row for each range and does
  the k x k solve of a Newton step.
* Concordance is counted exactly without pairing rows: discordant-free
  pairs (earlier event, later time, lower risk) are a dominance count over
  positions in time order (see ``trends._count_dominated``), risk ties are
  counted per (risk, time) cell.
* Classifiers are ``pyspark.ml`` pipelines; fitted models persist with
  ``PipelineModel.save`` into the shared checkpoint folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import logistic, min_guarded
from ledgerlens.functions.pvalues import norm_sf
from ledgerlens.operators.order_stats import collect_scalars, exact_quantiles, prefix_sums, row_index
from ledgerlens.session import stored

# Fixed values (must equal the reference for equal results) -------------
RISK_WEIGHTS = (0.5, 0.3, 0.2)
RECENCY_SCALE = 180.0
VALUE_NORM = 100000.0
RISK_HIGH, RISK_MEDIUM = 0.7, 0.3
COX_EXCLUDE = ("CustomerID", "LastOrderDate", "Churned", "Time", "FirstOrder", "LastOrder")
# -----------------------------------------------------------------------


def kaplan_meier(df: DataFrame, duration_col: str = "Time", event_col: str = "Churned") -> DataFrame:
    """CHN-4: survival S(t) = prod_{t' <= t} (1 - d/n) at every distinct time."""
    per_t = df.where(F.col(duration_col).isNotNull()).groupBy(F.col(duration_col).alias("time")).agg(
        F.count(F.lit(1)).alias("removed"), F.sum(F.col(event_col).cast("long")).alias("events"))
    total = collect_scalars(per_t.agg(F.sum("removed")))[0]
    at_risk = prefix_sums(per_t, ["time"], ["removed"]).withColumn(
        "at_risk", F.lit(total) - F.col("upto_removed") + F.col("removed")).drop("upto_removed")
    # the factors as pairs: how many are zero, and the logarithms of the others
    log_term = F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(F.lit(0.0))
    zero = (F.col("events") >= F.col("at_risk")).cast("long")
    out = prefix_sums(at_risk.withColumn("_log", log_term).withColumn("_zero", zero), ["time"], ["_log", "_zero"])
    return out.select("time", "at_risk", "events", (F.col("removed") - F.col("events")).alias("censored"),
                      F.when(F.col("upto__zero") > 0, F.lit(0.0)).otherwise(F.exp("upto__log")).alias("survival"))


def churn_risk_score(churn_prob, customer_value, recency_days):
    """CHN-8: composite 0-100 risk; NULL inputs give NULL (not the cap)."""
    w1, w2, w3 = RISK_WEIGHTS
    score = (F.lit(w1) * churn_prob * 100.0
             + F.lit(w2) * logistic(recency_days.cast("double") / F.lit(RECENCY_SCALE)) * 100.0
             + F.lit(w3) * (F.log1p(customer_value) / F.lit(math.log1p(VALUE_NORM))) * 100.0)
    return min_guarded(score, 100.0)


def risk_segment(prob):
    """CHN-9 / PRJ-7: High / Medium / Low risk, else Unknown."""
    return (F.when(prob >= RISK_HIGH, "High Risk").when((prob >= RISK_MEDIUM) & (prob < RISK_HIGH), "Medium Risk")
            .when(prob < RISK_MEDIUM, "Low Risk").otherwise("Unknown"))


def retention_impact(df: DataFrame, prob_col: str, clv_col: str, cost: float = 500.0) -> DataFrame:
    """CHN-10: expected loss, ROI (+inf when cost <= 0), retain flag and
    break-even probability (1 when CLV <= 0) of each row at one retention cost."""
    out = df.withColumn("RetentionCost", F.lit(float(cost)))
    loss = F.col(prob_col) * F.col(clv_col)
    cost = F.col("RetentionCost")
    return out.withColumn("ExpectedLoss", loss).withColumn(
        "RetentionROI", F.when(cost > 0, (loss - cost) / cost * 100.0).otherwise(F.lit(float("inf")))
    ).withColumn("ShouldRetain", loss > cost).withColumn(
        "BreakEvenProbability", F.when(F.col(clv_col) > 0, cost / F.col(clv_col)).otherwise(F.lit(1.0)))


def expected_loss(df: DataFrame, prob_col: str, clv_col: str) -> DataFrame:
    """Customers, mean churn probability and expected loss (sum of probability
    times value) of each risk segment: the measured part of CHN-10."""
    return df.groupBy(risk_segment(F.col(prob_col)).alias("RiskSegment")).agg(
        F.count(F.lit(1)).alias("Customers"), F.avg(prob_col).alias("AvgProbability"),
        F.sum(F.col(prob_col) * F.col(clv_col)).alias("ExpectedLoss"))


def risk_factors(df: DataFrame, target: str = "Churned", top_n: int = 10,
                 exclude=("CustomerID", "Churned", "HighChurn")) -> DataFrame:
    """CHN-11 / TOP-5: |Pearson r| of every numeric column with the target in
    one aggregation; undefined correlations dropped; top n (ties by name)."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")
               and f.name not in exclude]
    aggs = []
    for c in numeric:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(c).cast("double")), F.when(both, F.col(target).cast("double"))
        aggs += [F.covar_samp(x, y).alias(f"cov|{c}"), F.stddev_samp(x).alias(f"sx|{c}"),
                 F.stddev_samp(y).alias(f"sy|{c}")]
    s = collect_scalars(df.agg(*aggs))
    rows = []
    for c in numeric:
        cov, sx, sy = s[f"cov|{c}"], s[f"sx|{c}"], s[f"sy|{c}"]
        if cov is None or not sx or not sy:
            continue
        rows.append((c, abs(cov / (sx * sy))))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows[:top_n], "Feature string, Correlation double")


# -- Cox proportional hazards --------------------------------------------

TIME_SUMS = "_range int, _t double, d bigint, eta_d double, sx array<double>, a array<double>, b array<double>"


def _time_sums(beta: np.ndarray, feats: list[str]):
    """Per batch and distinct time: event count, the events' sums of eta and x,
    and sums over all rows (a) and event rows (b) of e^eta, x e^eta, x x^T e^eta (upper triangle)."""
    i, j = np.triu_indices(len(feats))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, event = pdf[feats].to_numpy(float).reshape(len(pdf), -1), pdf["_ev"].to_numpy() == 1
            eta = x @ beta
            terms = np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]]) * np.exp(eta)[:, None]
            times, first, at = np.unique(pdf["_t"].to_numpy(float), return_index=True, return_inverse=True)

            def summed(values, only=None):
                out = np.zeros((len(times), values.shape[1]))
                np.add.at(out, at if only is None else at[only], values if only is None else values[only])  # noqa: B023
                return out

            yield pd.DataFrame({"_range": pdf["_range"].to_numpy()[first], "_t": times, "d": np.bincount(at, weights=event, minlength=len(times)).astype("int64"),
                                "eta_d": summed(eta[:, None], event)[:, 0], "sx": list(summed(x, event)), "a": list(summed(terms)), "b": list(summed(terms, event))})

    return run


def _gamma_differences(z0: np.ndarray, z1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log gamma, digamma and (negated) trigamma at z1 less those at z0 (1 <= z0 <= z1), without cancellation.

    Both arguments are raised by the recurrences, then the asymptotic series are
    subtracted term by term.
    """
    steps = 20
    log, psi, tri = np.zeros_like(z0), np.zeros_like(z0), np.zeros_like(z0)
    for j in range(steps):
        log -= np.log((z1 + j) / (z0 + j))
        psi += (z1 - z0) / ((z1 + j) * (z0 + j))
        tri += (z1 - z0) * (z1 + z0 + 2 * j) / ((z1 + j) * (z0 + j)) ** 2
    x, y = z0 + steps, z1 + steps
    ratio = np.log1p((y - x) / x)
    u, v = 1.0 / x, 1.0 / y
    log += (x - 0.5) * ratio + (y - x) * np.log(y) - (y - x) + (v - u) / 12 - (v**3 - u**3) / 360 + (v**5 - u**5) / 1260
    psi += ratio - (v - u) / 2 - (v**2 - u**2) / 12 + (v**4 - u**4) / 120 - (v**6 - u**6) / 252
    tri += (u - v) + (u**2 - v**2) / 2 + (u**3 - v**3) / 6 - (u**5 - v**5) / 30 + (u**7 - v**7) / 42
    return log, psi, tri


def efron_ties(s0: np.ndarray, b0: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over l < d of log phi, 1/phi, f/phi, 1/phi^2, f/phi^2, f^2/phi^2
    with f = l/d and phi = s0 - f b0, in closed form (d >= 1)."""
    c = np.maximum(s0 / b0 * d, d)
    log, psi, tri = _gamma_differences(c - d + 1.0, c + 1.0)
    unit = d / b0
    i1, i2 = unit * psi, unit * unit * tri
    few = d <= 16  # few ties are summed one by one, which keeps all digits of the small terms
    f1, f2, ff = (s0 * i1 - d) / b0, (s0 * i2 - i1) / b0, (s0 * s0 * i2 - 2 * s0 * i1 + d) / (b0 * b0)
    out = [d * np.log(b0 / d) + log, i1, f1, i2, f2, ff]
    direct = np.zeros((6, len(d)))
    for l in range(int(d[few].max(initial=0))):
        on = few & (l < d)
        f = l / d[on]
        phi = s0[on] - f * b0[on]
        direct[:, on] += [np.log(phi), 1 / phi, f / phi, 1 / phi**2, f / phi**2, (f / phi) ** 2]
    return tuple(np.where(few, y, x) for x, y in zip(out, direct))


def _range_efron(k: int, before: dict):
    """A range's part of the log-likelihood, gradient and Hessian; ``before``: the sums of all later times."""
    upper = list(zip(*np.triu_indices(k)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(-pdf["_t"].to_numpy(float), return_inverse=True)  # descending

        def merged(column):
            values = np.stack(pdf[column].to_list()).reshape(len(pdf), -1) if pdf[column].dtype == object else pdf[column].to_numpy(float)[:, None]
            out = np.zeros((len(times), values.shape[1]))
            np.add.at(out, at, values)
            return out

        s = merged("a").cumsum(axis=0) + before[int(pdf["_range"].iloc[0])]
        d = merged("d")[:, 0]
        on = d > 0
        s, b, sx = s[on], merged("b")[on], merged("sx")[on]
        lsum, i1, f1, i2, f2, ff = efron_ties(s[:, 0], b[:, 0], d[on])
        row = {"ll": float(pdf["eta_d"].sum() - lsum.sum())}
        for i in range(k):
            row[f"g_{i}"] = float((sx[:, i] - (s[:, 1 + i] * i1 - b[:, 1 + i] * f1)).sum())
        for at_, (i, j) in enumerate(upper, 1 + k):
            si, sj, bi, bj = s[:, 1 + i], s[:, 1 + j], b[:, 1 + i], b[:, 1 + j]
            row[f"h_{i}_{j}"] = float((si * sj * i2 - (si * bj + bi * sj) * f2 + bi * bj * ff - (s[:, at_] * i1 - b[:, at_] * f1)).sum())
        return pd.DataFrame([row])

    return run


def _efron(data: DataFrame, beta: np.ndarray, feats: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian (Efron ties) of rows (_range, _t, _ev, feats).

    Risk sets are suffix sums over ranges of time: each range starts from the
    totals of the later ones.  Rows of one time combine in their batch.
    """
    k = len(feats)
    sums = stored(data.mapInPandas(_time_sums(beta, feats), TIME_SUMS), "risk-sets")
    totals = sums.select("_range", F.posexplode("a").alias("at", "v")).groupBy("_range", "at").agg(F.sum("v").alias("v")).collect()
    by_range: dict = {}
    for r in totals:  # ranges x sums
        by_range.setdefault(r["_range"], {})[r["at"]] = r["v"]
    before, held = {}, np.zeros(1 + k + k * (k + 1) // 2)
    for n in sorted(by_range, reverse=True):
        before[n] = held
        held = held + np.array([v for _, v in sorted(by_range[n].items())])
    columns = ["ll"] + [f"g_{i}" for i in range(k)] + [f"h_{i}_{j}" for i, j in zip(*np.triu_indices(k))]
    parts = sums.groupBy("_range").applyInPandas(_range_efron(k, before), ", ".join(f"{c} double" for c in columns))
    r = collect_scalars(parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]))
    h = np.zeros((k, k))
    for i, j in zip(*np.triu_indices(k)):
        h[i, j] = h[j, i] = r[f"h_{i}_{j}"]
    return r["ll"], np.array([r[f"g_{i}"] for i in range(k)]), h


def _time_ranges(base: DataFrame, duration_col: str) -> Column:
    """The number of the range that a time falls into; a time is never cut."""
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(base.stat.approxQuantile(duration_col, [i / n for i in range(1, n)], 0.1 / n)))
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col(duration_col))) if bounds else F.lit(0)


class CoxResult:
    def __init__(self, summary: DataFrame, concordance: float, loglik: float, iterations: int):
        self.summary = summary
        self.concordance_index = concordance
        self.log_likelihood = loglik
        self.iterations = iterations

    @property
    def significant_features(self) -> list[str]:
        return [r["covariate"] for r in self.summary.where(F.col("p") < 0.05).collect()]


def _newton_step(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """-h step = g; a small ridge is added when the covariates are collinear."""
    for ridge in (0.0, 1e-8, 1e-6, 1e-4, 1e-2):
        m = -h + ridge * max(1.0, float(np.abs(h).max(initial=0.0))) * np.eye(len(g))
        if not len(g) or np.linalg.cond(m) < 1e14:
            return np.linalg.solve(m, g)
    raise RuntimeError("Cox fit: the covariates are collinear")


def fit_cox(df: DataFrame, duration_col: str = "Time", event_col: str = "Churned",
            feature_cols: list[str] | None = None, max_iter: int = 50, tol: float = 1e-9,
            penalizer: float = 0.0) -> CoxResult:
    """CHN-2: Cox proportional hazards by Newton-Raphson on the Efron partial
    likelihood.  Covariates are standardised for the fit (constant columns
    dropped) and coefficients reported on the original scale."""
    if feature_cols is None:
        feature_cols = [f.name for f in df.schema.fields if f.name not in COX_EXCLUDE
                        and f.dataType.typeName() in ("integer", "long", "double")]
    cols = [duration_col, event_col] + feature_cols
    base = stored(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna(), "cox-input")
    mom = collect_scalars(base.agg(*[F.avg(c).alias(f"m_{c}") for c in feature_cols],
                                   *[F.stddev_samp(c).alias(f"s_{c}") for c in feature_cols]))
    feats = [c for c in feature_cols if mom[f"s_{c}"] and mom[f"s_{c}"] > 0]
    data = base.select(_time_ranges(base, duration_col).alias("_range"), F.col(duration_col).alias("_t"), F.col(event_col).cast("int").alias("_ev"),
                       *[((F.col(c) - F.lit(mom[f"m_{c}"])) / F.lit(mom[f"s_{c}"])).alias(f"z{i}")
                         for i, c in enumerate(feats)])
    data = stored(data, "cox")
    zs = [f"z{i}" for i in range(len(feats))]
    k = len(zs)
    beta = np.zeros(k)
    ll, g, h = _efron(data, beta, zs)
    it = 0
    for it in range(1, max_iter + 1):
        hp = h - penalizer * np.eye(k)
        gp = g - penalizer * beta
        step = _newton_step(hp, gp)
        new = beta + step
        for halving in range(30):
            ll_n, g_n, h_n = _efron(data, new, zs)
            if ll_n - 0.5 * penalizer * new @ new >= ll - 0.5 * penalizer * beta @ beta - 1e-12:
                break
            if halving == 29:
                raise RuntimeError("Cox fit did not converge: no step raises the likelihood")
            step /= 2.0
            new = beta + step
        beta, ll, g, h = new, ll_n, g_n, h_n
        if np.max(np.abs(step), initial=0.0) < tol:
            break
    else:
        raise RuntimeError(f"Cox fit did not converge in {max_iter} steps")
    cov = np.linalg.inv(-(h - penalizer * np.eye(k)))
    se = np.sqrt(np.diag(cov))
    out = []
    for i, c in enumerate(feats):
        sd = mom[f"s_{c}"]
        coef, s = beta[i] / sd, se[i] / sd
        z = beta[i] / se[i]
        out.append((c, float(coef), float(math.exp(coef)), float(s), float(z), float(2 * norm_sf(abs(z)))))
    summary = df.sparkSession.createDataFrame(
        out, "covariate string, coef double, exp_coef double, se_coef double, z double, p double")
    risk = data.select("_t", "_ev", sum(F.col(z) * F.lit(float(b)) for z, b in zip(zs, beta)).alias("_risk")) \
        if k else data.select("_t", "_ev", F.lit(0.0).alias("_risk"))
    c_index = concordance_index(risk, "_t", "_risk", "_ev")
    return CoxResult(summary, c_index, ll, it)


def concordance_index(df: DataFrame, duration_col: str, risk_col: str, event_col: str) -> float:
    """CHN-3: Harrell's C.  Admissible pairs: i had the event and T_i < T_j;
    concordant if risk_i > risk_j, ties count 1/2.  Exact and distributed:

    * admissible = sum over event rows of #rows with a later time (per-time
      counts + suffix sums over distinct times);
    * concordant = pairs ordered by (time, risk) position with risk_i > risk_j
      and i an event: a weighted strict dominance count;
    * ties = per (risk, time) cells: event rows x rows of the same risk at a
      later time.
    """
    from ledgerlens.operators.trends import _count_dominated

    d = df.select(F.col(duration_col).cast("double").alias("t"), F.col(risk_col).cast("double").alias("r"),
                  F.col(event_col).cast("int").alias("e")).where(F.col("t").isNotNull() & F.col("r").isNotNull()) \
        .withColumn("_id", F.monotonically_increasing_id()).persist()
    n = collect_scalars(d.agg(F.count(F.lit(1))))[0]
    per_t = d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("ev"))
    adm = collect_scalars(prefix_sums(per_t, ["t"], ["n"]).agg(F.sum(F.col("ev") * (F.lit(n) - F.col("upto_n")))))[0] or 0
    if adm == 0:
        d.unpersist()
        return float("nan")
    cell = d.groupBy("r", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("ev"))
    # rows of a risk at later times: those up to the risk's end less those up to the cell
    upto = stored(prefix_sums(cell, ["r", "t"], ["n"]), "cells")
    ends = upto.groupBy("r").agg(F.max("upto_n").alias("end"))
    ties = collect_scalars(upto.join(ends, "r").agg(F.sum(F.col("ev") * (F.col("end") - F.col("upto_n")))))[0] or 0
    pos = row_index(d, ["t", "r", "_id"], out_col="x").select(
        F.lit(0).alias("_k"), F.lit(0).cast("long").alias("tid"), "x", F.col("r").alias("z"), "e")
    counted = _count_dominated(pos, "_k", max(1, int(n - 1).bit_length()), strict=True, weight_col="e")
    conc = collect_scalars(counted.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("c")))[0]
    d.unpersist()
    return (conc + 0.5 * ties) / adm


# -- classifiers (CHN-5..7, SNK-1) ----------------------------------------

CHURN_FEATURES = ["NumOrders", "TotalSpend", "AvgOrderValue", "SpendStd", "TotalItems", "AvgDiscount",
                  "UniqueProducts", "CustomerLifetimeDays", "PurchaseFrequency", "OrderConsistency",
                  "VolumeTrend", "CV_Spend", "ProductEntropy", "CategoryPenetration"]


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2):
    """Deterministic stratified split: within each class the rows whose key
    hash falls below the class's (1 - test_fraction) quantile train."""
    from ledgerlens.operators.reports import key_hash
    h = df.withColumn("_h", key_hash(key).cast("double"))
    qs = exact_quantiles(h, "_h", [1.0 - test_fraction], [label])
    thr = {q[label]: q["value"] for q in qs}
    cond = None
    for lab, v in thr.items():
        c = (F.col(label) == F.lit(lab)) & (F.col("_h") <= F.lit(v))
        cond = c if cond is None else cond | c
    train = h.where(cond).drop("_h")
    test = h.where(~cond).drop("_h")
    return train, test


#: Rows of a partition that the trees pass over.
TREE_ROWS = 500_000


def tree_rows(train: DataFrame) -> DataFrame:
    """The rows of many partitions in as many as there are cores, or a multiple of
    them with ``TREE_ROWS`` rows in each.  In each pass over the rows every partition
    makes, sends and adds up statistics of all nodes of a level (200 trees: some
    hundred MB), so that many small partitions cost more than the rows."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    most = cores * max(1, math.ceil(train.count() / (cores * TREE_ROWS)))
    # up to twice as many stay: merged in part, they would make some tasks twice as long as others
    return train.coalesce(most) if train.rdd.getNumPartitions() > 2 * most else train


class ChurnClassifier:
    """CHN-5 / CHN-6 / CHN-7 / SNK-1: random forest with balanced class weights, or GBT without weights.

    ``minInstancesPerNode=10`` bounds the leaves; Spark's trees have no
    minimum number of rows for a split.
    """

    def __init__(self, kind: str = "random_forest", features: list[str] | None = None, seed: int = 42):
        self.kind = kind
        self.features = features or CHURN_FEATURES
        self.seed = seed
        self.model = None

    def _pipeline(self):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
        from pyspark.ml.feature import Imputer, VectorAssembler
        imp = Imputer(inputCols=self.features, outputCols=[f"_i_{c}" for c in self.features], strategy="median")
        va = VectorAssembler(inputCols=[f"_i_{c}" for c in self.features], outputCol="features")
        if self.kind == "random_forest":
            # a row's node of each tree is kept from level to level, not sought from the root: the same trees
            clf = RandomForestClassifier(numTrees=200, maxDepth=10, minInstancesPerNode=10, seed=self.seed,
                                         labelCol="label", weightCol="weight", cacheNodeIds=True, checkpointInterval=100)
        else:
            clf = GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, seed=self.seed, labelCol="label")
        return Pipeline(stages=[imp, va, clf])

    def prepare(self, df: DataFrame, label: str) -> DataFrame:
        base = df.select("CustomerID", *[F.col(c).cast("double").alias(c) for c in self.features],
                         F.col(label).cast("double").alias("label"))
        counts = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n, k = sum(counts.values()), len(counts)
        w = None
        for lab, c in counts.items():
            e = F.when(F.col("label") == F.lit(lab), F.lit(n / (k * c)))
            w = e if w is None else w.when(F.col("label") == F.lit(lab), F.lit(n / (k * c)))
        return base.withColumn("weight", w)

    def fit(self, df: DataFrame, label: str = "Churned"):
        # tree induction makes one pass per level: cut the feature lineage
        # (written to the shared checkpoint folder) before training; a forest
        # draws rows by their position, which must not follow the order of shuffles
        rows = df.select("CustomerID", *self.features, label).sortWithinPartitions("CustomerID")
        data = self.prepare(stored(rows, "classifier"), label)
        train, test = stratified_split(data, "CustomerID", "label", 0.2)
        train, test = tree_rows(train).persist(), test.persist()
        self.model = self._pipeline().fit(train)
        return self.evaluate(test)

    def evaluate(self, test: DataFrame) -> dict:
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        from pyspark.ml.functions import vector_to_array
        pred = self.model.transform(test).select("label", "prediction", vector_to_array("probability")[1].alias("p1")).persist()
        spark = test.sparkSession
        auc = BinaryClassificationEvaluator(rawPredictionCol="p1", labelCol="label",
                                            metricName="areaUnderROC").evaluate(pred)
        conf = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))
        acc = collect_scalars(pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))))[0]
        report = pred.groupBy().agg(*[
            e for lab in (0.0, 1.0) for e in (
                F.count_if((F.col("prediction") == lab) & (F.col("label") == lab)).alias(f"tp{int(lab)}"),
                F.count_if(F.col("prediction") == lab).alias(f"pp{int(lab)}"),
                F.count_if(F.col("label") == lab).alias(f"sup{int(lab)}"))]).collect()[0]
        rows = []
        for lab in (0, 1):
            tp, pp, sup = report[f"tp{lab}"], report[f"pp{lab}"], report[f"sup{lab}"]
            prec = tp / pp if pp else 0.0
            rec = tp / sup if sup else 0.0
            f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
            rows.append((lab, prec, rec, f1, sup))
        clf = self.model.stages[-1]
        imp = sorted(zip(self.features, clf.featureImportances.toArray().tolist()), key=lambda r: (-r[1], r[0]))
        return {
            "accuracy": acc, "roc_auc": auc,
            "classification_report": spark.createDataFrame(
                rows, "class int, precision double, recall double, f1 double, support bigint"),
            "confusion_matrix": conf,
            "feature_importance": spark.createDataFrame(imp, "feature string, importance double"),
        }

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "ChurnClassifier":
        from pyspark.ml import PipelineModel
        self.model = PipelineModel.load(path)
        return self

    def predict_proba(self, df: DataFrame, path: str | None = None) -> DataFrame:
        """Churn probability per row; loads a saved model when not fitted,
        raises when there is neither (reference contract)."""
        from pyspark.ml.functions import vector_to_array
        if self.model is None:
            if not path:
                raise ValueError("Model not trained yet")
            try:  # the path may be on any file system that Spark reads
                self.load(path)
            except Exception as e:
                raise ValueError("Model not trained yet") from e
        data = df.select("CustomerID", *[F.col(c).cast("double").alias(c) for c in self.features])
        return self.model.transform(data).select("CustomerID", vector_to_array("probability")[1]
                                                 .alias("ChurnProbability"))
