"""Weekly category series and pairwise Granger causality (AGG-8, WIN-7, SET-5, STA-6).

Weekly sums per category are a native aggregation; a series is bounded by the
calendar.  Granger tests need the cross products of all lags of all pairs of
categories: categories are dealt to blocks, each pair of blocks is one row of
work, and a product of the two blocks' lagged series gives all their
cross-product sums at once.  Restricted and unrestricted sums of squared
residuals are then pivots of one elimination of the normal equations, for all
pairs of a block together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import money_sum, week_end_sunday

P_EPS = 1e-10
#: Categories of a block.
BLOCK = 64
#: A pivot below this share of its diagonal entry is a column that depends on others.
DEPENDENT = 1e-10


def weekly_category_sales(sales: DataFrame, category_col: str = "CategoryName", date_col: str = "OrderDate",
                          value_col: str = "TotalDue") -> DataFrame:
    """AGG-8: (week ending Sunday, category, value) for weeks with sales."""
    return sales.where(F.col(category_col).isNotNull()).groupBy(
        week_end_sunday(F.col(date_col)).alias("week"), F.col(category_col).alias("category")).agg(
        money_sum(value_col).alias("value"))


def filled_series(weekly: DataFrame) -> DataFrame:
    """SET-5: weeks with any sales x all categories, missing cells 0 (weeks
    without sales are not inserted).  The categories, a taxonomy, are an
    uncollected array that each week expands."""
    every = weekly.agg(F.array_sort(F.collect_set("category"))).scalar()
    grid = weekly.select("week").distinct().select("week", F.explode(every).alias("category"))
    return grid.join(weekly, ["week", "category"], "left").select(
        "week", "category", F.coalesce("value", F.lit(0.0)).alias("value"))


def lagged(series: DataFrame, max_lag: int = 4) -> DataFrame:
    """WIN-7: value lags 1..max_lag per category in week order (each window
    partition is one category's weekly series, bounded by the calendar)."""
    w = Window.partitionBy("category").orderBy("week")
    return series.select("week", "category", "value",
                         *[F.lag("value", k).over(w).alias(f"lag{k}") for k in range(1, max_lag + 1)])


def chi2_tails(x: np.ndarray, dof: int) -> np.ndarray:
    """Upper chi-square tails for a whole number of degrees of freedom, by the recurrence in steps of two."""
    h = np.maximum(x, 0.0) / 2.0
    odd = dof % 2
    tail = np.vectorize(lambda v: math.erfc(math.sqrt(v)))(h) if odd else np.exp(-h)
    for k in range(2 - odd, dof, 2):
        tail = tail + np.exp(-h) * h ** (k / 2.0) / math.gamma(k / 2.0 + 1.0)
    return tail


def granger_p(effects: np.ndarray, causes: np.ndarray, max_lag: int) -> np.ndarray:
    """Minimum over lags 1..max_lag of the chi-square (SSR-based) Granger p-value,
    cause by effect: nobs * (ssr_r - ssr_u) / ssr_u with ``lag`` dof; NaN where a fit fails.

    Series are rows.  The normal equations [1, own lags, cause lags, effect] of
    all pairs are eliminated together: after the own lags the last entry is the
    restricted sum of squares, after the cause lags the unrestricted one.
    """
    effects, causes = (x - x.mean(axis=1, keepdims=True) for x in (effects, causes))
    n, best = effects.shape[1], np.full((len(causes), len(effects)), np.inf)
    for lag in range(1, max_lag + 1):
        rows, m = n - lag, 2 * lag + 2
        lags = lambda s: np.stack([s[:, lag - k:n - k] for k in range(1, lag + 1)], axis=1)  # noqa: B023, E731
        own = np.concatenate([np.ones((len(effects), 1, rows)), lags(effects), effects[:, None, lag:]], axis=1)
        other = lags(causes)
        base = own @ own.transpose(0, 2, 1)
        cross = (other.reshape(-1, rows) @ own.reshape(-1, rows).T).reshape(len(causes), lag, len(effects), lag + 2).transpose(0, 2, 1, 3)
        g = np.zeros((len(causes), len(effects), m, m))
        first, last = np.arange(lag + 1), np.arange(lag + 1, m - 1)
        place = np.append(first, m - 1)
        g[:, :, place[:, None], place] = base[None]
        g[:, :, last[:, None], last] = (other @ other.transpose(0, 2, 1))[:, None]
        g[:, :, last[:, None], place] = cross
        g[:, :, place[:, None], last] = cross.transpose(0, 1, 3, 2)
        size = np.einsum("ceii->cei", g).copy()
        for k in range(m - 1):
            if k == lag + 1:
                restricted = g[:, :, -1, -1].copy()
            pivot = g[:, :, k, k]
            usable = pivot > DEPENDENT * size[:, :, k]
            row = np.where(usable[:, :, None], g[:, :, k] / np.where(usable, pivot, 1.0)[:, :, None], 0.0)
            g -= g[:, :, :, k, None] * row[:, :, None]
        full = g[:, :, -1, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            statistic = np.where(full > DEPENDENT * size[:, :, -1], rows * (restricted - full) / full, np.nan)
        best = np.minimum(best, chi2_tails(statistic, lag))  # NaN stays
    return best


def granger_matrix(sales: DataFrame, category_col: str = "CategoryName", date_col: str = "OrderDate",
                   max_lag: int = 4, block: int = BLOCK) -> DataFrame:
    """STA-6 / JOIN-10: long (cause, effect, p_value, score = 1/(p + 1e-10));
    without more than max_lag + 5 weeks there are no rows (undefined in the
    reference); a failed fit gives score 0 and p 1."""
    weekly = weekly_category_sales(sales, category_col, date_col)
    weeks = weekly.select("week").distinct().withColumn("at", F.row_number().over(Window.orderBy("week")) - 1)  # bounded by the calendar
    series = weekly.join(weeks, "week").groupBy("category").agg(F.collect_list(F.struct("at", "value")).alias("cells"))
    n_weeks = weeks.agg(F.count(F.lit(1))).scalar()
    blocks = series.agg(F.ceil(F.count(F.lit(1)) / block)).scalar()
    dealt = series.select("category", "cells", n_weeks.alias("weeks"), blocks.alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("category"), F.col("blocks")))
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "category", "cells", "weeks")

    def per_pair_of_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["weeks"].iloc[0])
        if n <= max_lag + 5:
            return pd.DataFrame(columns=["cause", "effect", "p_value", "score"])
        values = np.zeros((len(pdf), n))
        for k, cells in enumerate(pdf["cells"]):
            for c in cells:
                values[k, c["at"]] = c["value"]
        names, low = pdf["category"].to_numpy(), (pdf["own"] == pdf["i"]).to_numpy()
        sides = [(low, low)] if pdf["i"].iloc[0] == pdf["j"].iloc[0] else [(low, ~low), (~low, low)]
        out = []
        for causes, effects in sides:
            if causes.any() and effects.any():
                p = granger_p(values[effects], values[causes], max_lag)
                out.append(pd.DataFrame({"cause": np.repeat(names[causes], effects.sum()), "effect": np.tile(names[effects], causes.sum()), "p_value": p.ravel()}))
        if not out:
            return pd.DataFrame(columns=["cause", "effect", "p_value", "score"])
        found = pd.concat(out)
        found = found[found["cause"] != found["effect"]]
        failed = found["p_value"].isna()
        found["score"] = np.where(failed, 0.0, 1.0 / (found["p_value"] + P_EPS))
        found["p_value"] = found["p_value"].where(~failed, 1.0)
        return found

    return rows.groupBy("i", "j").applyInPandas(per_pair_of_blocks, "cause string, effect string, p_value double, score double")
