"""Pure Column helpers that pin down pandas-style semantics on Spark.

Each helper returns a ``Column``; they stay inside whole-stage codegen.
The rules (see README, "semantics"):

* division never raises: ``safe_div`` is NULL on a zero divisor;
* day differences are whole elapsed days, not calendar boundaries;
* fixed-edge bins are right-closed with the lowest edge excluded;
* missing values are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(col(a), col(b))


def inf_div(a: str | Column, b: str | Column) -> Column:
    """a / b with float semantics for a zero divisor: +-Infinity, NaN for 0/0.

    Only used where the reference keeps the infinity (RFM purchase frequency
    with Age = 0, acquisition cost with no new customers).
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    return (
        F.when(b != 0, a / b)
        .when(a > 0, F.lit(float("inf")))
        .when(a < 0, F.lit(float("-inf")))
        .otherwise(F.lit(None).cast("double"))
    )


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed days from start to end (23:00 -> 01:00 next day is 0)."""
    return F.timestamp_diff("DAY", col(start), col(end))


def week_end_sunday(ts: str | Column) -> Column:
    """Sunday that ends the week containing ts (a Sunday maps to itself)."""
    return F.next_day(F.date_sub(F.to_date(col(ts)), 1), "Sun")


def month_start(ts: str | Column) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def month_index(ts: str | Column) -> Column:
    """Months since year 0: differences give pandas period differences."""
    d = col(ts)
    return (F.year(d) * 12 + F.month(d)).cast("bigint")


def is_weekend(ts: str | Column) -> Column:
    """Saturday or Sunday (weekday(): Monday = 0)."""
    return F.weekday(col(ts)).isin(5, 6)


def right_closed_bins(x: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """pd.cut semantics: (e0, e1], (e1, e2], ...; outside or NULL -> NULL."""
    assert len(edges) == len(labels) + 1
    x = col(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


def min_guarded(x: str | Column, cap: float) -> Column:
    """min(x, cap) that keeps NULL (Spark's least() would return cap)."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(x, F.lit(cap)))


def clamp(x: str | Column, lo: float, hi: float) -> Column:
    x = col(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def logistic(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def finite_or(x: str | Column, nan: float = 0.0, posinf: float = 1e6, neginf: float = -1e6) -> Column:
    """numpy nan_to_num: NULL/NaN -> nan, +inf -> posinf, -inf -> neginf."""
    x = col(x).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(nan))
        .when(x == F.lit(float("inf")), F.lit(posinf))
        .when(x == F.lit(float("-inf")), F.lit(neginf))
        .otherwise(x)
    )


def first_match(cases: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Chained when(): the first true condition wins."""
    expr = None
    for cond, lab in cases:
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(default).cast("string"))


# Money is summed exactly: the source type is a fixed-point amount, and an
# exact decimal sum does not depend on the order partial sums are combined.
MONEY = "decimal(18,4)"


def money_sum(x: str | Column) -> Column:
    return F.sum(col(x).cast(MONEY)).cast("double")
