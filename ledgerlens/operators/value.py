"""RFM, closed-form lifetime value, health scores and behaviour segments
(CUS-4 .. CUS-9).

All whole-table scalars (reference date, moments, min/max, medians) are
one-row aggregates or exact order statistics fetched as a handful of
numbers and injected as literals, so the per-customer work is a single
narrow projection over the RFM table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import (
    clamp, first_match, inf_div, money_sum, right_closed_bins, safe_div, whole_days)
from ledgerlens.operators.order_stats import collect_scalars, exact_quantiles_multi

# Fixed values (must equal the reference for equal results) -------------
HEALTH_EDGES = [0, 30, 50, 70, 100]
HEALTH_LABELS = ["Critical", "At Risk", "Stable", "Excellent"]
RECENCY_QUARTILE_LABELS = ["High", "Medium", "Low", "Very Low"]
VALUE_QUARTILE_LABELS = ["Low", "Medium", "High", "Very High"]
BETA_A, BETA_B = 1.0, 2.0
# -----------------------------------------------------------------------


def calculate_rfm(transactions: DataFrame, reference_date=None) -> DataFrame:
    """CUS-4: Recency, Frequency, Monetary, FirstPurchase, Age, AOV, PurchaseFrequency.

    ``transactions`` needs CustomerID, OrderDate, SalesOrderID, TotalDue.
    One shuffle by customer; countDistinct becomes a two-level aggregate so a
    hot customer is pre-aggregated per order before it meets its key.
    """
    if reference_date is None:  # an uncollected scalar of the same plan
        ref = transactions.agg(F.max("OrderDate").cast("timestamp")).scalar()
    else:
        ref = F.lit(reference_date).cast("timestamp")
    agg = transactions.groupBy("CustomerID").agg(
        F.max("OrderDate").alias("_last"),
        F.countDistinct("SalesOrderID").alias("Frequency"),
        money_sum("TotalDue").alias("Monetary"),
        F.min("OrderDate").alias("FirstPurchase"),
    )
    return agg.select(
        "CustomerID",
        whole_days(F.col("_last"), ref).alias("Recency"),
        "Frequency",
        "Monetary",
        "FirstPurchase",
        whole_days(F.col("FirstPurchase"), ref).alias("Age"),
        safe_div(F.col("Monetary"), F.col("Frequency")).alias("AvgOrderValue"),
        (inf_div(F.col("Frequency"), whole_days(F.col("FirstPurchase"), ref)) * F.lit(365.0))
        .alias("PurchaseFrequency"),
    )


@dataclass
class BTYDParams:
    r: float
    alpha: float
    a: float = BETA_A
    b: float = BETA_B
    clv_std: float | None = None


def btyd_parameters(rfm: DataFrame) -> BTYDParams:
    """Moment matching of the purchase-count distribution.

    Mean and sample variance are formed from exact integer sums in double
    arithmetic (the same operations any engine performs), because
    r = mean^2 / (var - mean) amplifies rounding when var is close to mean.
    """
    row = collect_scalars(rfm.agg(
        F.count("Frequency").alias("n"),
        F.sum(F.col("Frequency").cast("bigint")).alias("s1"),
        F.sum(F.col("Frequency").cast("double") * F.col("Frequency").cast("double")).alias("s2")))
    n, s1, s2 = row["n"], float(row["s1"] or 0), float(row["s2"] or 0.0)
    mean = s1 / n
    var = (s2 - s1 * s1 / n) / (n - 1) if n > 1 else float("nan")
    if var > mean:
        r = mean * mean / (var - mean)
        alpha = mean / (var - mean)
    else:
        r, alpha = mean, 1.0
    return BTYDParams(r=r, alpha=alpha)


def fit_btyd(rfm: DataFrame, params: BTYDParams | None = None) -> tuple[DataFrame, BTYDParams]:
    """CUS-5: expected transactions, CLV with +-1.96 sd band, ProbAlive."""
    p = params or btyd_parameters(rfm)
    t = F.col("Age").cast("double") / F.lit(365.0)
    scored = rfm.withColumns({
        "ExpectedFutureTransactions": (F.lit(p.r) + F.col("Frequency")) / (F.lit(p.alpha) + t),
    }).withColumn("PredictedCLV", F.col("ExpectedFutureTransactions") * F.col("AvgOrderValue").cast("double"))
    clv_std = collect_scalars(scored.agg(F.stddev_samp("PredictedCLV")))[0]
    p.clv_std = clv_std
    sd = F.lit(clv_std).cast("double")
    out = scored.withColumns({
        "CLV_Lower": F.col("PredictedCLV") - F.lit(1.96) * sd,
        "CLV_Upper": F.col("PredictedCLV") + F.lit(1.96) * sd,
        "ProbAlive": F.lit(1.0) / (F.lit(1.0) + F.lit(p.alpha) / (F.lit(p.alpha) + t)),
    })
    return out, p


def _minmax_norm(c: str, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, (F.col(c).cast("double") - lo.cast("double")) / (hi - lo).cast("double")).otherwise(F.lit(0.0))


def health_score(rfm: DataFrame, consistency: DataFrame | None = None) -> DataFrame:
    """CUS-6: 0-100 health from min-max normalised RFM (and order consistency).

    ``consistency``: CustomerID, OrderConsistency (left joined; a customer
    without a value scores 0.5 on that component).  Ranges and the largest
    consistency are uncollected scalars of the plan.
    """
    mm = rfm.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in ("Recency", "Frequency", "Monetary")
                            for n, f in (("min", F.min), ("max", F.max))])).scalar()
    df = rfm.withColumns({
        f"{c}_norm": _minmax_norm(c, mm[f"min_{c}"], mm[f"max_{c}"]) for c in ("Recency", "Frequency", "Monetary")})
    df = df.withColumns({
        "Recency_Score": F.exp(F.col("Recency_norm") * F.lit(-2.0)),
        "Frequency_Score": F.col("Frequency_norm"),
        "Monetary_Score": F.col("Monetary_norm"),
    })
    if consistency is not None:
        df = df.join(consistency.select("CustomerID", "OrderConsistency"), on="CustomerID", how="left")
        cmax = df.agg(F.max("OrderConsistency").cast("double")).scalar()
        of_max = F.coalesce(F.lit(1.0) - F.col("OrderConsistency") / cmax, F.lit(0.5))
        cs = F.when(cmax > 0, of_max).otherwise(F.lit(0.5))
        df = df.withColumn("Consistency_Score", cs)
        score = (F.lit(0.25) * F.col("Recency_Score") + F.lit(0.25) * F.col("Frequency_Score")
                 + F.lit(0.25) * F.col("Monetary_Score") + F.lit(0.25) * F.col("Consistency_Score")) * F.lit(100.0)
    else:
        score = (F.lit(0.35) * F.col("Recency_Score") + F.lit(0.30) * F.col("Frequency_Score")
                 + F.lit(0.35) * F.col("Monetary_Score")) * F.lit(100.0)
    return df.withColumn("HealthScore", score).withColumn(
        "HealthCategory", health_category(F.col("HealthScore")))


def health_category(score: Column) -> Column:
    """PRJ-2: (0,30] Critical, (30,50] At Risk, (50,70] Stable, (70,100] Excellent."""
    return right_closed_bins(score, HEALTH_EDGES, HEALTH_LABELS)


def segment_rule(freq: Column, mon: Column, rec: Column, prob_alive: Column,
                 f_med: float, m_med: float, r_med: float) -> Column:
    """CUS-7 first-match rule (strict comparisons, ProbAlive NULL -> 0.5)."""
    pa = F.coalesce(prob_alive.cast("double"), F.lit(0.5))
    fm, mm, rm = F.lit(f_med), F.lit(m_med), F.lit(r_med)
    return first_match([
        (freq == 0, "New"),
        ((pa < 0.3) & (mon > mm), "Lost VIP"),
        (pa < 0.3, "Dormant"),
        ((freq > fm) & (mon > mm) & (rec < rm), "Enterprise VIP"),
        ((freq > fm) & (mon > mm), "At Risk VIP"),
        (freq > fm, "Regular Buyer"),
        (mon > mm, "Big Spender"),
        (rec < rm, "New Active"),
    ], "Occasional")


def rfm_medians(df: DataFrame) -> dict[str, float]:
    q = exact_quantiles_multi(df, ["Frequency", "Monetary", "Recency"], [0.5])
    return {c: v[0.5] for c, v in q.items()}


def segment_customers(df: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """CUS-7: behaviour segment plus SegmentSize / SegmentRevenue / SegmentAvgCLV.

    Segment totals come from a groupBy over at most nine labels, joined back
    with a broadcast whose size is bounded by the label set.
    """
    med = medians or rfm_medians(df)
    pa = F.col("ProbAlive") if "ProbAlive" in df.columns else F.lit(None)
    seg = df.withColumn("Segment", segment_rule(
        F.col("Frequency"), F.col("Monetary"), F.col("Recency"), pa,
        med["Frequency"], med["Monetary"], med["Recency"]))
    has_clv = "PredictedCLV" in df.columns
    totals = seg.groupBy("Segment").agg(
        F.count("CustomerID").alias("SegmentSize"),
        money_sum("Monetary").alias("SegmentRevenue"),
        (F.avg("PredictedCLV") if has_clv else F.lit(0.0)).alias("SegmentAvgCLV"))
    return seg.join(F.broadcast(totals), on="Segment", how="left")


def quartile_labels(df: DataFrame) -> DataFrame:
    """CUS-8: R/F/M quartile labels (qcut; rank-percentile fallback).

    qcut edges are the exact 0/25/50/75/100 % quantiles; the first bin is
    closed on the left.  If any column has repeated edges, all three
    columns switch to percentile ranks (average ties) cut into four
    equal-width bins, as pandas does.
    """
    cols = {"Recency": RECENCY_QUARTILE_LABELS, "Frequency": VALUE_QUARTILE_LABELS,
            "Monetary": VALUE_QUARTILE_LABELS}
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    q = exact_quantiles_multi(df, list(cols), probs)
    edges = {c: [q[c][p] for p in probs] for c in cols}
    fallback = any(len(set(e)) < len(e) for e in edges.values())
    out = df
    if not fallback:
        for c, labels in cols.items():
            e = edges[c]
            x = F.col(c).cast("double")
            out = out.withColumn(f"{c[0]}_Quartile", first_match([
                ((x >= F.lit(e[0])) & (x <= F.lit(e[1])), labels[0]),
                ((x > F.lit(e[1])) & (x <= F.lit(e[2])), labels[1]),
                ((x > F.lit(e[2])) & (x <= F.lit(e[3])), labels[2]),
                ((x > F.lit(e[3])) & (x <= F.lit(e[4])), labels[3]),
            ], None))
        return out
    from ledgerlens.operators.order_stats import average_rank
    n = df.count()
    for c, labels in cols.items():
        ranked = average_rank(out, c, f"_{c}_rank")
        pct = F.col(f"_{c}_rank") / F.lit(float(n))
        mm = collect_scalars(ranked.agg(F.min(pct).alias("lo"), F.max(pct).alias("hi")))
        lo, hi = mm["lo"], mm["hi"]
        e = [lo + (hi - lo) * i / 4 for i in range(5)]
        e[0] = lo - (hi - lo) * 0.001
        out = ranked.withColumn(f"{c[0]}_Quartile", right_closed_bins(pct, e, labels)).drop(f"_{c}_rank")
    return out


def scalar_health_score(recency: Column, frequency: Column, monetary: Column,
                        weights: dict[str, float] | None = None) -> Column:
    """CUS-9: weighted sum of already-normalised inputs, clamped to [0, 100]."""
    w = weights or {"recency": 0.4, "frequency": 0.3, "monetary": 0.3}
    score = (F.lit(w["recency"]) * recency + F.lit(w["frequency"]) * frequency
             + F.lit(w["monetary"]) * monetary)
    return clamp(score, 0.0, 100.0)
