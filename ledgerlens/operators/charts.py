"""Tables behind the charts (CHT-*, WIN-8).  Drawing is not built; each
function returns the data a chart would plot, computed on Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import money_sum, month_index
from ledgerlens.operators.order_stats import collect_scalars, exact_quantiles, next_in_order, row_index

# Fixed values (must equal the reference for equal results) -------------
HIST_BINS = 50
KDE_POINTS = 100
PERCENTILES = [0.25, 0.5, 0.75, 0.9]
CUBE_SIZE_SCALE, CUBE_SIZE_BASE = 20.0, 5.0
STATE_COLOURS = [(("VIP", "Champion"), "gold"), (("Risk", "Churn"), "red"), (("Active", "Loyal"), "green"),
                 (("New",), "lightblue")]
DEFAULT_COLOUR = "gray"
# -----------------------------------------------------------------------

KDE_TERMS = 24


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """CHT-1: equal-width bins over [min, max] with probability density
    count / (n * width); the maximum falls in the last bin."""
    s = collect_scalars(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")))
    lo, hi, n = s["lo"], s["hi"], s["n"]
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "count",
                         (F.col("count") / F.lit(float(n) * width)).alias("density"))


def percentile_markers(df: DataFrame, col: str) -> DataFrame:
    """CHT-1: 25/50/75/90th percentiles (linear interpolation)."""
    q = exact_quantiles(df, col, PERCENTILES)
    return df.sparkSession.createDataFrame([(r["p"] * 100.0, r["value"]) for r in q],
                                           "percentile double, value double")


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """WIN-8: (value, i / n) over the sorted values; the position comes from
    a range-partitioned running count, not a single-partition window."""
    n = collect_scalars(df.agg(F.count(col)))[0]
    base = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value"))
    idx = row_index(base.withColumn("_id", F.monotonically_increasing_id()), ["value", "_id"], out_col="_i")
    return idx.select("value", ((F.col("_i") + 1) / F.lit(float(n))).alias("cumulative"))


def kde(df: DataFrame, col: str, points: int = KDE_POINTS) -> DataFrame:
    """CHT-2: Gaussian kernel density on ``points`` equally spaced grid
    points, Scott bandwidth n^(-1/5) * sample std, by a fast Gauss transform.

    Values are grouped into boxes of width sqrt(2) * bandwidth, and one
    aggregation sums the powers of their distances from the box's centre; a
    box's Hermite series then stands for all its values.  In units of the box
    width distances are at most 1/2, so cutting the series after ``KDE_TERMS``
    terms changes a value's kernel by less than
    1.09 * sum over later n of 2^(-n/2) / sqrt(n!), about 4e-16.  Without
    values or spread the result is empty."""
    s = collect_scalars(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"),
                               F.stddev_samp(col).alias("sd")))
    lo, hi, n, sd = s["lo"], s["hi"], s["n"], s["sd"]
    schema = "grid int, x double, density double"
    if not n or not sd:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = float(lo), float(hi)
    bw = sd * n ** (-1.0 / 5.0)
    width, step = math.sqrt(2.0) * bw, (hi - lo) / (points - 1)
    v = df.where(F.col(col).isNotNull()).select(((F.col(col).cast("double") - F.lit(lo)) / F.lit(width)).alias("v"))
    boxed = v.withColumn("box", F.floor("v")).withColumn("s", F.col("v") - F.col("box") - 0.5)
    moments = boxed.groupBy("box").agg(F.array(F.count(F.lit(1)).cast("double"), *[F.sum(F.pow("s", k)) for k in range(1, KDE_TERMS)]).alias("m"))

    def evaluated(batches):
        total = np.zeros(points)
        grid = np.arange(points) * step / width
        for pdf in batches:
            if not len(pdf):
                continue
            # h_0 = exp(-t^2), h_1 = 2 t h_0, h_(k+1) = 2 t h_k - 2 k h_(k-1), each over k! with the moment
            m = np.stack(pdf["m"].to_list())
            t = grid[None, :] - (pdf["box"].to_numpy(float) + 0.5)[:, None]
            before, h, factorial = np.zeros_like(t), np.exp(-t * t), 1.0
            for k in range(KDE_TERMS):
                total += (m[:, k] / factorial) @ h
                before, h = h, 2.0 * t * h - 2.0 * k * before
                factorial *= k + 1
        yield pd.DataFrame({"grid": np.arange(points, dtype="int32"), "part": total})

    sums = moments.mapInPandas(evaluated, "grid int, part double").groupBy("grid").agg(F.sum("part").alias("_s"))
    return sums.select("grid", (F.lit(lo) + F.col("grid") * F.lit(step)).alias("x"),
                       (F.col("_s") / F.lit(n * math.sqrt(2 * math.pi) * bw)).alias("density"))


def rfm_cube(rfm: DataFrame, color_col: str = "Monetary") -> DataFrame:
    """CHT-3: marker size M / max(M) * 20 + 5 and the category code of the
    colour column (position among its sorted distinct values)."""
    mx = collect_scalars(rfm.agg(F.max("Monetary")))[0]
    codes = row_index(rfm.select(color_col).distinct(), [color_col], out_col="ColorCode")
    out = rfm.join(codes, color_col, "left")
    return out.select("CustomerID", "Recency", "Frequency", "Monetary",
                      (F.col("Monetary") / F.lit(mx) * CUBE_SIZE_SCALE + CUBE_SIZE_BASE).alias("MarkerSize"),
                      F.col("ColorCode").cast("int").alias("ColorCode"))


def transitions(events: DataFrame, entity: str = "user_id", order=("ts", "event_id"),
                state: str = "event_type") -> DataFrame:
    """CHT-4 / CHT-5 input: counts of consecutive (from, to) states per
    entity, with the next state taken by a scale-safe lead."""
    nxt = next_in_order(events.select(entity, *order, state), [entity], list(order), [state], prefix="next_")
    return nxt.where(F.col("next_" + state).isNotNull()).groupBy(
        F.col(state).alias("source"), F.col("next_" + state).alias("target")).agg(F.count(F.lit(1)).alias("weight"))


def transition_matrix(trans: DataFrame) -> DataFrame:
    """CHT-4: row-normalised transition probabilities (states are few)."""
    tot = F.sum("weight").over(Window.partitionBy("source"))
    return trans.withColumn("probability", F.col("weight") / tot)


def state_colour(state) -> F.Column:
    expr = None
    for words, colour in STATE_COLOURS:
        cond = None
        for w in words:
            c = state.contains(w)
            cond = c if cond is None else cond | c
        expr = F.when(cond, colour) if expr is None else expr.when(cond, colour)
    return expr.otherwise(DEFAULT_COLOUR)


def journey_links(trans: DataFrame) -> DataFrame:
    """CHT-5: (source, target, weight) with node colour classes."""
    return trans.withColumn("source_colour", state_colour(F.col("source"))) \
        .withColumn("target_colour", state_colour(F.col("target")))


def streamgraph(sales: DataFrame, group_col: str = "CategoryName", value_col: str = "LineTotal") -> DataFrame:
    """CHT-6: monthly value per group and its stacked band (groups stacked in
    name order within a month; the window holds one month's groups)."""
    m = sales.where(F.col(group_col).isNotNull()).groupBy(
        month_index(F.col("OrderDate")).alias("MonthIdx"), F.col(group_col).alias("Group")).agg(
        money_sum(value_col).alias("Value"))
    w = Window.partitionBy("MonthIdx").orderBy("Group").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("Value").over(w)
    return m.withColumn("StackTop", top).withColumn("StackBase", F.col("StackTop") - F.col("Value"))


def uplift_curve(responses: DataFrame, scores: DataFrame, buckets: int = 10) -> DataFrame:
    """CHT-8: rows sorted by score (descending) and cut at score quantiles
    into ``buckets`` groups; cumulative treatment and control response
    rates up to each bucket and their difference (uplift)."""
    df = responses.join(scores.select("CustomerID", "Score"), "CustomerID", "inner")
    cuts = [r["value"] for r in exact_quantiles(df, "Score", [1.0 - k / buckets for k in range(1, buckets)])]
    b = F.lit(1)
    for c in cuts:
        b = b + (F.col("Score") < F.lit(c)).cast("int")
    per = df.withColumn("bucket", b).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("Promoted").cast("int")).alias("nt"),
        F.sum(F.when(F.col("Promoted"), F.col("Responded")).otherwise(0)).alias("rt"),
        F.sum(F.when(~F.col("Promoted"), F.col("Responded")).otherwise(0)).alias("rc"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)   # at most ``buckets`` rows
    total = collect_scalars(df.agg(F.count(F.lit(1))))[0]
    cum = per.select("bucket", *[F.sum(c).over(w).alias(c) for c in ("n", "nt", "rt", "rc")])
    tr = F.try_divide(F.col("rt"), F.col("nt"))
    cr = F.try_divide(F.col("rc"), F.col("n") - F.col("nt"))
    return cum.select("bucket", (F.col("n") / F.lit(float(total))).alias("population_fraction"),
                      tr.alias("treatment_response"), cr.alias("control_response"), (tr - cr).alias("uplift"))


def bass_diffusion(sales: DataFrame) -> DataFrame:
    """CHT-9: Bass model from monthly adoptions (first orders): regress
    s_t on N_{t-1} and N_{t-1}^2 (3 x 3 normal equations from one
    aggregation over months), then m, p, q and the fitted cumulative curve."""
    import numpy as np
    first = sales.groupBy("CustomerID").agg(F.min(month_index(F.col("OrderDate"))).alias("m"))
    months = first.groupBy("m").agg(F.count(F.lit(1)).alias("s"))
    lo = collect_scalars(months.agg(F.min("m")))[0]
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)   # one row per month (calendar-bounded)
    mt = months.withColumn("t", F.col("m") - F.lit(lo) + 1).withColumn(
        "N", F.coalesce(F.sum("s").over(w), F.lit(0)).cast("double"))
    s = collect_scalars(mt.agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.pow("N", i)).alias(f"n{i}") for i in range(1, 5)],
                               F.sum("s").alias("y0"), F.sum(F.col("s") * F.col("N")).alias("y1"),
                               F.sum(F.col("s") * F.col("N") * F.col("N")).alias("y2")))
    a_mat = np.array([[s["k"], s["n1"], s["n2"]], [s["n1"], s["n2"], s["n3"]], [s["n2"], s["n3"], s["n4"]]], float)
    y = np.array([s["y0"], s["y1"], s["y2"]], float)
    a, b, c = np.linalg.solve(a_mat, y)
    disc = b * b - 4 * a * c
    m_pot = (-b - math.sqrt(disc)) / (2 * c) if c != 0 and disc >= 0 else float("nan")
    p = a / m_pot
    q = p + b
    e = F.exp(-(F.lit(p + q)) * F.col("t"))
    fitted = F.lit(m_pot) * (F.lit(1.0) - e) / (F.lit(1.0) + F.lit(q / p) * e)
    wc = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return mt.select("t", F.sum("s").over(wc).alias("adoption"), fitted.alias("fitted_adoption"),
                     F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(q / p).alias("q_over_p"),
                     F.lit(m_pot).alias("m"))


def waterfall(values: DataFrame, category: str, value: str) -> DataFrame:
    """CHT-10: running total of relative steps in category order (the step
    list is an aggregate, one row per category)."""
    w = Window.orderBy(category).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("RunningTotal", F.sum(value).over(w)).withColumn(
        "Start", F.col("RunningTotal") - F.col(value))


def parallel_ranges(df: DataFrame, dims: list[str]) -> DataFrame:
    """CHT-11: [min, max] per dimension, one aggregation."""
    s = collect_scalars(df.agg(*[e for d in dims for e in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]))
    return df.sparkSession.createDataFrame([(d, float(s[f"lo_{d}"]), float(s[f"hi_{d}"])) for d in dims],
                                           "dimension string, min double, max double")


def geo_density(df: DataFrame, lat: str, lon: str, value: str | None = None, cell_deg: float = 0.5):
    """CHT-7: weight per lat/lon grid cell (weights default 1) and the map
    centre (mean latitude / longitude).  Returns (cells, (lat0, lon0))."""
    w = F.col(value).cast("double") if value else F.lit(1.0)
    cells = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(
        F.floor(F.col(lat) / cell_deg).alias("lat_cell"), F.floor(F.col(lon) / cell_deg).alias("lon_cell")).agg(
        F.sum(w).alias("weight"), F.count(F.lit(1)).alias("points")).select(
        (F.col("lat_cell") * cell_deg).alias("lat"), (F.col("lon_cell") * cell_deg).alias("lon"), "weight", "points")
    c = collect_scalars(df.agg(F.avg(lat).alias("a"), F.avg(lon).alias("b")))
    return cells, (c["a"], c["b"])
