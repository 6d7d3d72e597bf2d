"""Registered queries: chart tables (CHT-*), ECDF, weekly series and Granger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import pvalues as pv
from ledgerlens.functions.exprs import money_sum
from ledgerlens.operators import charts as chx
from ledgerlens.operators import reports as rep
from ledgerlens.operators import timeseries as ts
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.q_value import clv_table, rfm_table, segmented_table
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes

WEEK_SQL = "CAST(OrderDate AS DATE) + CAST((7 - isodow(OrderDate)) % 7 AS INTEGER)"


@query("cht1_clv_histogram", with_ctes("clv") + """,
s AS (SELECT min(PredictedCLV) AS lo, max(PredictedCLV) AS hi, count(PredictedCLV) AS n FROM clv),
w AS (SELECT lo, n, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 END AS width FROM s)
SELECT CAST(bin AS INTEGER) AS bin, round(w.lo + bin * w.width, 6) AS bin_start,
       round(w.lo + (bin + 1) * w.width, 6) AS bin_end, count(*) AS count,
       round(count(*) / (w.n * w.width), 16) AS density
FROM (SELECT least(floor((PredictedCLV - (SELECT lo FROM w)) / (SELECT width FROM w)), 49) AS bin FROM clv
      WHERE PredictedCLV IS NOT NULL) b, w
GROUP BY bin, w.lo, w.width, w.n""")
def cht1_clv_histogram(spark, sf_dir):
    out = chx.histogram(clv_table(spark, sf_dir), "PredictedCLV")
    return finish(out, {"bin": None, "bin_start": 6, "bin_end": 6, "count": None, "density": 16})


@query("cht1_clv_percentiles", with_ctes("clv") + "\n" + "\nUNION ALL ".join(
    f"SELECT {p * 100.0}::DOUBLE AS percentile, round(quantile_cont(PredictedCLV, {p}), 4) AS value FROM clv"
    for p in chx.PERCENTILES))
def cht1_clv_percentiles(spark, sf_dir):
    return finish(chx.percentile_markers(clv_table(spark, sf_dir), "PredictedCLV"), {"percentile": None, "value": 4})


@query("win8_clv_ecdf", with_ctes("clv") + """
SELECT round(PredictedCLV, 4) AS value, round(row_number() OVER (ORDER BY PredictedCLV) / count(*) OVER (), 12)
       AS cumulative FROM clv WHERE PredictedCLV IS NOT NULL""")
def win8_clv_ecdf(spark, sf_dir):
    return finish(chx.ecdf(clv_table(spark, sf_dir), "PredictedCLV"), {"value": 4, "cumulative": 12})


@query("cht2_clv_kde", with_ctes("clv") + """,
s AS (SELECT min(PredictedCLV) AS lo, max(PredictedCLV) AS hi, count(PredictedCLV) AS n,
             stddev_samp(PredictedCLV) * pow(count(PredictedCLV), -1.0 / 5.0) AS bw FROM clv),
g AS (SELECT r.grid, s.lo + r.grid * ((s.hi - s.lo) / 99) AS x FROM range(0, 100) r(grid), s)
SELECT CAST(g.grid AS INTEGER) AS grid, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - c.PredictedCLV) / s.bw) * ((g.x - c.PredictedCLV) / s.bw)))
             / (s.n * sqrt(2 * pi()) * s.bw), 16) AS density
FROM g, clv c, s WHERE c.PredictedCLV IS NOT NULL GROUP BY g.grid, g.x, s.n, s.bw""")
def cht2_clv_kde(spark, sf_dir):
    return finish(chx.kde(clv_table(spark, sf_dir), "PredictedCLV"), {"grid": None, "x": 6, "density": 16})


@query("cht3_rfm_cube", with_ctes("rfm") + """
SELECT CustomerID, Recency, Frequency, round(Monetary, 4) AS Monetary,
       round(Monetary / (SELECT max(Monetary) FROM rfm) * 20.0 + 5.0, 8) AS MarkerSize,
       CAST(dense_rank() OVER (ORDER BY Monetary) - 1 AS INTEGER) AS ColorCode FROM rfm""")
def cht3_rfm_cube(spark, sf_dir):
    return finish(chx.rfm_cube(rfm_table(spark, sf_dir)), {
        "CustomerID": None, "Recency": None, "Frequency": None, "Monetary": 4, "MarkerSize": 8, "ColorCode": None})


TRANS_SQL = """trans AS (
  SELECT event_type AS source, nxt AS target, count(*) AS weight FROM (
    SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
  WHERE nxt IS NOT NULL GROUP BY event_type, nxt)"""


@query("cht4_transition_matrix", "WITH " + TRANS_SQL + """
SELECT source, target, weight, round(weight / sum(weight) OVER (PARTITION BY source), 12) AS probability FROM trans""")
def cht4_transition_matrix(spark, sf_dir):
    out = chx.transition_matrix(chx.transitions(catalog(spark, sf_dir).events()))
    return finish(out, {"source": None, "target": None, "weight": None, "probability": 12})


def _colour_sql(c: str) -> str:
    parts = []
    for words, colour in chx.STATE_COLOURS:
        cond = " OR ".join(f"contains({c}, '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{colour}'")
    return f"CASE {' '.join(parts)} ELSE '{chx.DEFAULT_COLOUR}' END"


@query("cht5_journey_links", with_ctes("segmented", "segmented_prev") + f""",
trans AS (SELECT p.Segment AS source, c.Segment AS target, count(*) AS weight
          FROM segmented_prev p JOIN segmented c ON p.CustomerID = c.CustomerID GROUP BY 1, 2)
SELECT source, target, weight, {_colour_sql('source')} AS source_colour, {_colour_sql('target')} AS target_colour
FROM trans""")
def cht5_journey_links(spark, sf_dir):
    import datetime as dt
    from ledgerlens.operators import value as val
    from ledgerlens.operators.order_stats import collect_scalars
    og = catalog(spark, sf_dir).order_grain()
    last = collect_scalars(og.agg(F.max("OrderDate")))[0]
    ref = last - dt.timedelta(days=365)
    prev_clv, _ = val.fit_btyd(val.calculate_rfm(og.where(F.col("OrderDate") <= F.lit(ref)), reference_date=ref))
    prev = val.segment_customers(prev_clv).select("CustomerID", F.col("Segment").alias("source"))
    cur = segmented_table(spark, sf_dir).select("CustomerID", F.col("Segment").alias("target"))
    trans = prev.join(cur, "CustomerID").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return chx.journey_links(trans)


@query("cht6_streamgraph", with_ctes("sales") + """
SELECT MonthIdx, "Group", round(Value, 4) AS Value,
       round(sum(Value) OVER (PARTITION BY MonthIdx ORDER BY "Group" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4)
         AS StackTop,
       round(sum(Value) OVER (PARTITION BY MonthIdx ORDER BY "Group" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - Value, 4) AS StackBase
FROM (SELECT year(OrderDate) * 12 + month(OrderDate) AS MonthIdx, CategoryName AS "Group",
             CAST(sum(CAST(LineTotal AS DECIMAL(18,4))) AS DOUBLE) AS Value
      FROM sales WHERE CategoryName IS NOT NULL GROUP BY 1, 2)""")
def cht6_streamgraph(spark, sf_dir):
    out = chx.streamgraph(catalog(spark, sf_dir).sales_lines())
    return finish(out, {"MonthIdx": None, "Group": None, "Value": 4, "StackTop": 4, "StackBase": 4})


def _uplift_sql() -> str:
    cuts = ", ".join(f"quantile_cont(Score, {1.0 - k / 10}) AS q{k}" for k in range(1, 10))
    bucket = " + ".join(f"CAST(Score < q.q{k} AS INTEGER)" for k in range(1, 10))
    return with_ctes("order_resp", "clv") + f""",
d AS (SELECT r.*, c.PredictedCLV AS Score FROM order_resp r JOIN clv c ON r.CustomerID = c.CustomerID),
q AS (SELECT {cuts} FROM d),
per AS (SELECT 1 + {bucket} AS bucket, count(*) AS n, sum(CAST(Promoted AS INTEGER)) AS nt,
               sum(CASE WHEN Promoted THEN Responded ELSE 0 END) AS rt,
               sum(CASE WHEN NOT Promoted THEN Responded ELSE 0 END) AS rc FROM d, q GROUP BY 1),
cum AS (SELECT bucket, sum(n) OVER w AS n, sum(nt) OVER w AS nt, sum(rt) OVER w AS rt, sum(rc) OVER w AS rc
        FROM per WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(bucket AS INTEGER) AS bucket, round(n / (SELECT count(*) FROM d), 12) AS population_fraction,
       round(CASE WHEN nt = 0 THEN NULL ELSE rt / nt END, 12) AS treatment_response,
       round(CASE WHEN n - nt = 0 THEN NULL ELSE rc / (n - nt) END, 12) AS control_response,
       round(CASE WHEN nt = 0 OR n - nt = 0 THEN NULL ELSE rt / nt - rc / (n - nt) END, 12) AS uplift FROM cum"""


@query("cht8_uplift_curve", _uplift_sql())
def cht8_uplift_curve(spark, sf_dir):
    resp = rep.order_responses(catalog(spark, sf_dir).sales_lines())
    scores = clv_table(spark, sf_dir).select("CustomerID", F.col("PredictedCLV").alias("Score"))
    out = chx.uplift_curve(resp, scores, 10)
    return finish(out.withColumn("bucket", F.col("bucket").cast("int")),
                  {"bucket": None, "population_fraction": 12, "treatment_response": 12, "control_response": 12,
                   "uplift": 12})


def _det(a, b, c, d, e, f, g, h, i):
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_BASS_DET = _det("k", "n1", "n2", "n1", "n2", "n3", "n2", "n3", "n4")
_BASS_SUMS = ", ".join(f"sum(CAST(pow(N, {i}) AS DOUBLE)) AS n{i}" for i in range(1, 5))


@query("cht9_bass_diffusion", with_ctes("sales") + f""",
f AS (SELECT CustomerID, min(year(OrderDate) * 12 + month(OrderDate)) AS m FROM sales GROUP BY CustomerID),
mt AS (SELECT m - min(m) OVER () + 1 AS t, s, coalesce(sum(s) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS N
       FROM (SELECT m, count(*) AS s FROM f GROUP BY m)),
x AS (SELECT count(*)::DOUBLE AS k, {_BASS_SUMS}, sum(s)::DOUBLE AS y0, sum(s * N) AS y1, sum(s * N * N) AS y2 FROM mt),
c AS (SELECT {_det("y0", "n1", "n2", "y1", "n2", "n3", "y2", "n3", "n4")} / {_BASS_DET} AS a,
             {_det("k", "y0", "n2", "n1", "y1", "n3", "n2", "y2", "n4")} / {_BASS_DET} AS b,
             {_det("k", "n1", "y0", "n1", "n2", "y1", "n2", "n3", "y2")} / {_BASS_DET} AS c FROM x),
d AS (SELECT a, b, (-b - sqrt(b * b - 4 * a * c)) / (2 * c) AS m FROM c),
p AS (SELECT m, a / m AS p, a / m + b AS q FROM d)
SELECT CAST(t AS BIGINT) AS t, CAST(sum(s) OVER (ORDER BY t) AS BIGINT) AS adoption,
       round(p.m * (1 - exp(-(p.p + p.q) * t)) / (1 + p.q / p.p * exp(-(p.p + p.q) * t)), 2) AS fitted_adoption,
       round(p.p, 6) AS p, round(p.q, 6) AS q, round(p.q / p.p, 3) AS q_over_p, round(p.m, 2) AS m FROM mt, p""")
def cht9_bass_diffusion(spark, sf_dir):
    out = chx.bass_diffusion(catalog(spark, sf_dir).sales_lines())
    return finish(out, {"t": None, "adoption": None, "fitted_adoption": 2, "p": 6, "q": 6, "q_over_p": 3, "m": 2})


@query("cht10_waterfall", with_ctes("sales") + """
SELECT Category, round(Value, 4) AS Value,
       round(sum(Value) OVER (ORDER BY Category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS RunningTotal,
       round(sum(Value) OVER (ORDER BY Category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - Value, 4) AS Start
FROM (SELECT CategoryName AS Category, CAST(sum(CAST(LineTotal AS DECIMAL(18,4))) AS DOUBLE) AS Value
      FROM sales WHERE CategoryName IS NOT NULL GROUP BY CategoryName)""")
def cht10_waterfall(spark, sf_dir):
    vals = catalog(spark, sf_dir).sales_lines().where(F.col("CategoryName").isNotNull()).groupBy(
        F.col("CategoryName").alias("Category")).agg(money_sum("LineTotal").alias("Value"))
    return finish(chx.waterfall(vals, "Category", "Value"),
                  {"Category": None, "Value": 4, "RunningTotal": 4, "Start": 4})


@query("cht11_parallel_ranges", with_ctes("clv") + "\n" + "\nUNION ALL ".join(
    f"SELECT '{d}' AS dimension, round(CAST(min({d}) AS DOUBLE), 6) AS min, round(CAST(max({d}) AS DOUBLE), 6) AS max "
    f"FROM clv" for d in ["Recency", "Frequency", "Monetary", "PredictedCLV"]))
def cht11_parallel_ranges(spark, sf_dir):
    out = chx.parallel_ranges(clv_table(spark, sf_dir), ["Recency", "Frequency", "Monetary", "PredictedCLV"])
    return finish(out, {"dimension": None, "min": 6, "max": 6})


@query("agg8_weekly_category_sales", with_ctes("sales") + f"""
SELECT {WEEK_SQL} AS week, CategoryName AS category,
       round(CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE), 4) AS value
FROM sales WHERE CategoryName IS NOT NULL GROUP BY 1, 2""")
def agg8_weekly_category_sales(spark, sf_dir):
    return finish(ts.weekly_category_sales(catalog(spark, sf_dir).sales_lines()),
                  {"week": None, "category": None, "value": 4})


@query("win7_lagged_series", with_ctes("sales") + f""",
wk AS (SELECT {WEEK_SQL} AS week, CategoryName AS category,
              CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS value
       FROM sales WHERE CategoryName IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT w.week, c.category, coalesce(wk.value, 0.0) AS value
         FROM (SELECT DISTINCT week FROM wk) w CROSS JOIN (SELECT DISTINCT category FROM wk) c
         LEFT JOIN wk ON wk.week = w.week AND wk.category = c.category)
SELECT week, category, round(value, 4) AS value, """ + ", ".join(
    f"round(lag(value, {k}) OVER (PARTITION BY category ORDER BY week), 4) AS lag{k}" for k in range(1, 5)) + " FROM grid")
def win7_lagged_series(spark, sf_dir):
    series = ts.filled_series(ts.weekly_category_sales(catalog(spark, sf_dir).sales_lines()))
    return finish(ts.lagged(series, 4), {"week": None, "category": None, "value": 4,
                                         **{f"lag{k}": 4 for k in range(1, 5)}})


GRANGER_LAGS = 4


def _granger_sql() -> str:
    """The normal equations of each pair and lag as rows (i, j, v), eliminated one column after the other."""
    head = with_ctes("sales") + f""",
wk AS (SELECT {WEEK_SQL} AS week, CategoryName AS category, CAST(sum(CAST(TotalDue AS DECIMAL(18,4))) AS DOUBLE) AS value
       FROM sales WHERE CategoryName IS NOT NULL GROUP BY 1, 2),
weeks AS (SELECT week, row_number() OVER (ORDER BY week) AS t FROM (SELECT DISTINCT week FROM wk)),
cats AS (SELECT DISTINCT category AS c FROM wk),
z AS MATERIALIZED (SELECT c, t, v - avg(v) OVER (PARTITION BY c) AS v
       FROM (SELECT c, t, coalesce(wk.value, 0.0) AS v FROM weeks CROSS JOIN cats LEFT JOIN wk ON wk.week = weeks.week AND wk.category = c)),
q AS MATERIALIZED (SELECT c, k, t + k AS t, v FROM z, range({GRANGER_LAGS + 1}) r(k) UNION ALL SELECT '' AS c, 0 AS k, t, 1.0 AS v FROM weeks),
g AS MATERIALIZED (SELECT a.c AS c1, a.k AS k1, b.c AS c2, b.k AS k2, l, sum(a.v * b.v) AS v
       FROM q a JOIN q b ON a.t = b.t, range(1, {GRANGER_LAGS + 1}) r(l)
       WHERE a.t > l AND a.k <= l AND b.k <= l AND a.t <= (SELECT count(*) FROM weeks) GROUP BY ALL),
pl AS (SELECT x.c AS cause, y.c AS effect, l FROM cats x, cats y, range(1, {GRANGER_LAGS + 1}) r(l) WHERE x.c <> y.c),
var AS (SELECT cause, effect, l, 0 AS i, '' AS c, 0 AS k FROM pl
        UNION ALL SELECT cause, effect, l, k, effect, k FROM pl, range(1, {GRANGER_LAGS + 1}) r(k) WHERE k <= l
        UNION ALL SELECT cause, effect, l, l + k, cause, k FROM pl, range(1, {GRANGER_LAGS + 1}) r(k) WHERE k <= l
        UNION ALL SELECT cause, effect, l, 2 * l + 1, effect, 0 FROM pl),
e0 AS MATERIALIZED (SELECT x.cause, x.effect, x.l, x.i, y.i AS j, g.v FROM var x
       JOIN var y ON x.cause = y.cause AND x.effect = y.effect AND x.l = y.l
       JOIN g ON g.c1 = x.c AND g.k1 = x.k AND g.c2 = y.c AND g.k2 = y.k AND g.l = x.l)"""
    steps = ""
    for s in range(2 * GRANGER_LAGS + 1):
        same = "a.cause = {0}.cause AND a.effect = {0}.effect AND a.l = {0}.l"
        steps += f""",
e{s + 1} AS MATERIALIZED (SELECT a.cause, a.effect, a.l, a.i, a.j, a.v - b.v * c.v / d.v AS v FROM e{s} a
       JOIN e{s} b ON {same.format("b")} AND b.i = a.i AND b.j = {s}
       JOIN e{s} c ON {same.format("c")} AND c.i = {s} AND c.j = a.j
       JOIN e{s} d ON {same.format("d")} AND d.i = {s} AND d.j = {s}
       WHERE a.i > {s} AND a.j > {s})"""
    last = lambda s, l: f"SELECT cause, effect, l, v FROM e{s} WHERE l = {l} AND i = {2 * l + 1} AND j = {2 * l + 1}"
    lags = range(1, GRANGER_LAGS + 1)
    tails = ""
    for dof in lags:
        tails += f" WHEN {dof} THEN {pv.sql_chi2_sf('stat', str(dof), 400)}"
    return head + steps + f""",
r AS ({" UNION ALL ".join(last(l + 1, l) for l in lags)}),
u AS ({" UNION ALL ".join(last(2 * l + 1, l) for l in lags)}),
st AS (SELECT r.cause, r.effect, r.l, ((SELECT count(*) FROM weeks) - r.l) * (r.v - u.v) / u.v AS stat
       FROM r JOIN u ON r.cause = u.cause AND r.effect = u.effect AND r.l = u.l),
p AS (SELECT cause, effect, min(CASE l{tails} END) AS p FROM st GROUP BY cause, effect)
SELECT cause, effect, round(p, 8) AS p_value, round(1.0 / (p + 1e-10), 4) AS score FROM p"""


@query("sta6_granger_causality", _granger_sql())
def sta6_granger_causality(spark, sf_dir):
    return finish(ts.granger_matrix(catalog(spark, sf_dir).sales_lines(), max_lag=GRANGER_LAGS),
                  {"cause": None, "effect": None, "p_value": 8, "score": 4})
