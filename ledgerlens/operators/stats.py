"""Hypothesis tests, correlation and bootstrap intervals (STA-1..5).

Each test reduces the data to sufficient statistics in one distributed
aggregation (counts, sums, variances per group, covariances per column
pair); only those few numbers reach the driver, where the statistic and its
p-value are formed.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import pvalues as pv
from ledgerlens.operators.order_stats import average_ranks, collect_scalars, exact_quantile, exact_quantiles
from ledgerlens.session import stored

# Fixed values (must equal the reference for equal results) -------------
ALPHA = 0.05
COHEN_LARGE, COHEN_MEDIUM = 0.8, 0.5
ETA_LARGE, ETA_MEDIUM = 0.14, 0.06
# -----------------------------------------------------------------------


def contingency(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Observed counts per (row, col) with expected counts r_i * c_j / N.
    NULL keys are dropped (crosstab semantics)."""
    obs = df.where(F.col(row_col).isNotNull() & F.col(col_col).isNotNull()) \
        .groupBy(row_col, col_col).agg(F.count(F.lit(1)).alias("observed"))
    rt = obs.groupBy(row_col).agg(F.sum("observed").alias("_r"))
    ct = obs.groupBy(col_col).agg(F.sum("observed").alias("_c"))
    n = collect_scalars(obs.agg(F.sum("observed")))[0]
    return obs.join(rt, row_col).join(ct, col_col).withColumn(
        "expected", F.col("_r") * F.col("_c") / F.lit(float(n))).drop("_r", "_c")


def chi_square_test(df: DataFrame, row_col: str, col_col: str, correction: bool = True) -> DataFrame:
    """STA-1: chi-square test of independence (Yates correction at 1 dof).

    Cells missing from the data have observed 0 and contribute their
    expected count; sum_obs E is subtracted from N to get them without
    materialising the full r x c grid."""
    cells = contingency(df, row_col, col_col)
    s = collect_scalars(cells.agg(
        F.count_distinct(row_col).alias("r"), F.count_distinct(col_col).alias("c"),
        F.sum("observed").alias("n"), F.sum("expected").alias("se"),
        F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi")))
    dof = (s["r"] - 1) * (s["c"] - 1)
    if dof == 1 and correction:
        # 2 x 2: at most four cells, corrected one by one
        rows = cells.collect()
        rkeys = sorted({r[row_col] for r in rows})
        ckeys = sorted({r[col_col] for r in rows})
        obs = {(r[row_col], r[col_col]): r["observed"] for r in rows}
        rt = {k: sum(v for (a, _), v in obs.items() if a == k) for k in rkeys}
        ct = {k: sum(v for (_, b), v in obs.items() if b == k) for k in ckeys}
        n = s["n"]
        chi = 0.0
        for a in rkeys:
            for b in ckeys:
                e = rt[a] * ct[b] / n
                o = obs.get((a, b), 0)
                d = e - o
                o2 = o + math.copysign(min(0.5, abs(d)), d) if d != 0 else o
                chi += (o2 - e) ** 2 / e
    else:
        chi = s["chi"] + (s["n"] - s["se"])
    p = pv.chi2_sf(chi, dof) if dof > 0 else float("nan")
    return df.sparkSession.createDataFrame(
        [(float(chi), float(p), int(dof), bool(p < ALPHA))],
        "chi2 double, p_value double, degrees_of_freedom bigint, significant boolean")


def chi_square_goodness_of_fit(observed: DataFrame, value_col: str, expected_col: str) -> DataFrame:
    """STA-1 (expected given): sum (O - E)^2 / E with n - 1 dof."""
    s = collect_scalars(observed.agg(
        F.sum((F.col(value_col) - F.col(expected_col)) ** 2 / F.col(expected_col)).alias("chi"),
        F.count(F.lit(1)).alias("k")))
    dof = s["k"] - 1
    p = pv.chi2_sf(s["chi"], dof)
    return observed.sparkSession.createDataFrame(
        [(float(s["chi"]), float(p), int(dof), bool(p < ALPHA))],
        "chi2 double, p_value double, degrees_of_freedom bigint, significant boolean")


def _group_moments(df: DataFrame, group_col: str, value_col: str):
    return df.where(F.col(group_col).isNotNull() & F.col(value_col).isNotNull()).groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"), F.var_samp(value_col).alias("var"))


def t_test(df: DataFrame, group_col: str, value_col: str, group1, group2) -> DataFrame:
    """STA-2: equal-variance two-sample t-test and pooled Cohen's d."""
    m = {r[group_col]: r for r in _group_moments(df, group_col, value_col)
         .where(F.col(group_col).isin(group1, group2)).collect()}
    a, b = m[group1], m[group2]
    n1, n2 = a["n"], b["n"]
    s1, s2 = a["var"] or 0.0, b["var"] or 0.0
    sp = math.sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2))
    diff = a["mean"] - b["mean"]
    t = diff / (sp * math.sqrt(1.0 / n1 + 1.0 / n2)) if sp > 0 else float("nan")
    p = pv.t_sf_two_sided(t, n1 + n2 - 2)
    d = diff / sp if sp > 0 else 0.0
    label = "large" if abs(d) > COHEN_LARGE else "medium" if abs(d) > COHEN_MEDIUM else "small"
    return df.sparkSession.createDataFrame(
        [(float(t), float(p), bool(p < ALPHA), float(d), label)],
        "t_statistic double, p_value double, significant boolean, cohens_d double, effect_size string")


def anova(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """STA-3: one-way ANOVA from per-group n / mean / variance; eta squared."""
    g = _group_moments(df, group_col, value_col).collect()
    n = sum(r["n"] for r in g)
    k = len(g)
    grand = sum(r["n"] * r["mean"] for r in g) / n
    ssb = sum(r["n"] * (r["mean"] - grand) ** 2 for r in g)
    ssw = sum((r["n"] - 1) * (r["var"] or 0.0) for r in g)
    f = (ssb / (k - 1)) / (ssw / (n - k)) if k > 1 and n > k and ssw > 0 else float("nan")
    p = pv.f_sf(f, k - 1, n - k)
    sst = ssb + ssw
    eta = ssb / sst if sst > 0 else 0.0
    label = "large" if eta > ETA_LARGE else "medium" if eta > ETA_MEDIUM else "small"
    return df.sparkSession.createDataFrame(
        [(float(f), float(p), bool(p < ALPHA), float(eta), label)],
        "f_statistic double, p_value double, significant boolean, eta_squared double, effect_size string")


def _spearman(data: DataFrame, cols: list[str]) -> DataFrame:
    """Ranks are taken over the rows where both columns of a pair have values;
    columns without missing values share theirs."""
    whole = collect_scalars(data.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]))
    out = None
    full = [c for c in cols if whole[c] == 0]
    pairs = [p for p in combinations(cols, 2) if not set(p) <= set(full)]
    groups = ([full] if full else []) + [list(p) for p in pairs] + [[c] for c in cols if c not in full]
    for g in groups:
        both = data.select(*g).dropna()
        ranks = average_ranks(both, g, "_rank").select(*[F.col(c + "_rank").alias(c) for c in g])
        part = correlation_matrix(ranks, g)
        if g in [list(p) for p in pairs]:
            part = part.where("var1 <> var2")
        out = part if out is None else out.unionByName(part)
    return out


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """STA-4: long (var1, var2, correlation, p_value, n) over pairwise-complete
    rows; Spearman = Pearson on average-tie ranks.  NULL for a constant column."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if method == "spearman":
        return _spearman(data, cols)
    aggs = []
    for a, b in list(combinations(cols, 2)) + [(c, c) for c in cols]:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa, xb = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs += [F.covar_samp(xa, xb).alias(f"cov|{a}|{b}"), F.stddev_samp(xa).alias(f"sa|{a}|{b}"),
                 F.stddev_samp(xb).alias(f"sb|{a}|{b}"), F.count(xa).alias(f"n|{a}|{b}")]
    s = collect_scalars(data.agg(*aggs))
    rows = []
    for a, b in list(combinations(cols, 2)) + [(c, c) for c in cols]:
        cov, sa, sb, n = s[f"cov|{a}|{b}"], s[f"sa|{a}|{b}"], s[f"sb|{a}|{b}"], s[f"n|{a}|{b}"]
        r = cov / (sa * sb) if cov is not None and sa and sb else None
        p = pv.betainc((n - 2) / 2.0, 0.5, max(0.0, 1.0 - r * r)) if r is not None and n > 2 else None
        rows.append((a, b, r, p, n))
        if a != b:
            rows.append((b, a, r, p, n))
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, correlation double, p_value double, n bigint")


# Poisson(1) cumulative probabilities P(X <= k), k = 0..9 (computed, not tabled)
POISSON1_CDF = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(10)]


#: 32-bit draws of one md5 digest.
DRAWS = 4
STATISTICS = ("mean", "median", "sum", "std")


def poisson_weight(digest: Column, draw: int) -> Column:
    """The Poisson(1) weight of a digest's draw: a uniform of 8 hex digits against the cumulative probabilities."""
    u = F.conv(F.substring(digest, 1 + 8 * draw, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return sum((u >= F.lit(c)).cast("int") for c in POISSON1_CDF)


def _digests(base: DataFrame, n_boot: int) -> DataFrame:
    """Each row once for every ``DRAWS`` replicates, with the digest that weighs it in them."""
    g = base.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAWS))))
    return g.withColumn("_h", F.md5(F.concat_ws(":", F.col("_k").cast("string"), F.col("_g").cast("string"))))


def _per_replicate(grouped: DataFrame, names: list[str], n_boot: int) -> DataFrame:
    """Columns name|draw of a row per digest number -> one row per replicate ``_b``."""
    each = F.array(*[F.struct((F.col("_g") * DRAWS + d).alias("_b"), *[F.col(f"{n}|{d}").alias(n) for n in names]) for d in range(DRAWS)])
    return grouped.select(F.explode(each).alias("x")).select("x.*").where(F.col("_b") < n_boot)


def _moments(base: DataFrame, n_boot: int) -> DataFrame:
    """_b, w, wv, wvv: sums of the weights and of the weighted first and second powers."""
    aggs = []
    for d in range(DRAWS):
        w = poisson_weight(F.col("_h"), d)
        aggs += [F.sum(w).alias(f"w|{d}"), F.sum(w * F.col("_v")).alias(f"wv|{d}"), F.sum(w * F.col("_v") * F.col("_v")).alias(f"wvv|{d}")]
    return _per_replicate(_digests(base, n_boot).groupBy("_g").agg(*aggs), ["w", "wv", "wvv"], n_boot)


def _medians(base: DataFrame, n: int, n_boot: int, spread: float = 8.0) -> DataFrame:
    """_b, stat: the median of each replicate's resampled values, exactly.

    The medians of all replicates lie within a few standard errors, so a
    bracket of about ``spread`` * sqrt(n) rows around the sample median is
    sorted for each replicate, and the weights below the bracket are only
    summed.  If a replicate's median lies outside, the bracket is widened.
    """
    while True:
        half = spread / (2.0 * math.sqrt(n))
        lo, hi = (q["value"] for q in exact_quantiles(base, "_v", [max(0.0, 0.5 - half), min(1.0, 0.5 + half)]))
        aggs = []
        for d in range(DRAWS):
            w = poisson_weight(F.col("_h"), d)
            aggs += [F.sum(w).alias(f"w|{d}"), F.sum(F.when(F.col("_v") < lo, w).otherwise(0)).alias(f"below|{d}")]
        totals = _per_replicate(_digests(base, n_boot).groupBy("_g").agg(*aggs), ["w", "below"], n_boot)
        near = _digests(base.where(F.col("_v").between(lo, hi)), n_boot)
        near = near.select("_v", F.explode(F.array(*[F.struct((F.col("_g") * DRAWS + d).alias("_b"), poisson_weight(F.col("_h"), d).alias("_w"))
                                                     for d in range(DRAWS)])).alias("x")).select("_v", "x._b", "x._w")
        near = near.where((F.col("_w") > 0) & (F.col("_b") < n_boot)).groupBy("_b", "_v").agg(F.sum("_w").alias("_w"))
        upto = F.sum("_w").over(Window.partitionBy("_b").orderBy("_v"))  # a bracket's rows
        ranked = near.withColumn("_to", upto).join(totals, "_b").withColumn("_to", F.col("_to") + F.col("below"))
        first, second = F.floor((F.col("w") + 1) / 2), F.floor(F.col("w") / 2) + 1
        held = lambda r: F.max(F.when((F.col("_to") >= r) & (F.col("_to") - F.col("_w") < r), F.col("_v")))
        found = ranked.groupBy("_b").agg(((held(first) + held(second)) / 2).alias("stat"))
        found = stored(totals.where("w > 0").select("_b").join(found, "_b", "left"), "medians")
        if half >= 0.5 or found.where("stat IS NULL").isEmpty():
            return found
        spread *= 4


def bootstrap_ci(df: DataFrame, key_col: str, value_col: str, n_boot: int = 1000,
                 confidence: float = 0.95, statistic: str = "mean") -> DataFrame:
    """STA-5: percentile bootstrap of the mean, median, sum or (population)
    standard deviation with Poisson(1) resampling weights drawn from a hash of
    (row key, replicate): deterministic under any partitioning.  One digest
    weighs a row in ``DRAWS`` replicates; sums combine before the shuffle, so
    it carries tasks x replicates partial sums.  A replicate's sum is that of
    as many values as there are rows.  A replicate that draws no row has no
    statistic; without values all results are null."""
    if statistic not in STATISTICS:
        raise ValueError(f"statistic must be one of {STATISTICS}")
    base = df.select(F.col(key_col).alias("_k"), F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    seen = collect_scalars(base.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.sum("_v").alias("sum"), F.stddev_pop("_v").alias("std")))
    n, own = seen["n"], seen["mean"]
    if statistic == "median":
        reps = _medians(base, n, n_boot) if n else None
        stat = exact_quantile(base, "_v", 0.5) if n else None
    else:
        stat = seen[statistic]
        # squares of deviations from the mean keep their digits
        shifted = base.withColumn("_v", F.col("_v") - F.lit(own)) if statistic == "std" else base
        m = _moments(shifted, n_boot).where("w > 0") if n else None
        mean = F.col("wv") / F.col("w")
        of = {"mean": mean, "sum": mean * F.lit(float(n)),
              "std": F.sqrt(F.greatest(F.col("wvv") / F.col("w") - mean * mean, F.lit(0.0)))}
        reps = m.select("_b", of[statistic].alias("stat")) if n else None
    schema = "statistic double, ci_lower double, ci_upper double, bootstrap_mean double, bootstrap_std double, confidence_level double"
    if not n:
        return df.sparkSession.createDataFrame([(None, None, None, None, None, confidence)], schema)
    alpha = 1.0 - confidence
    return reps.agg(F.lit(stat).cast("double").alias("statistic"), F.percentile("stat", alpha / 2).alias("ci_lower"),
                    F.percentile("stat", 1 - alpha / 2).alias("ci_upper"), F.avg("stat").alias("bootstrap_mean"),
                    F.stddev_pop("stat").alias("bootstrap_std"), F.lit(confidence).alias("confidence_level"))
