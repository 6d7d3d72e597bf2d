"""Survival functions of the chi-square, t, F and normal distributions.

Used on a handful of aggregated statistics on the driver (no scipy here).
The regularised incomplete gamma and beta functions are the power series
P(a, x) = p(a, x) * sum x^n / ((a + 1) ... (a + n)) / a and the continued
fractions DLMF 8.9.2 and 8.17.22.  Their leading factors are written as
deviances from the mean, so they keep their digits for millions of degrees of
freedom.  Expansions run until they converge (about sqrt(degrees of freedom)
terms) or raise.  ``sql_*`` return DuckDB expressions evaluating the same
quantities by power series, for the oracle queries.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

EPS = 1e-15
MOST_TERMS = 50_000_000


def _fraction(terms: Iterable[tuple[float, float]]) -> float:
    """n1 / (d1 + n2 / (d2 + ...)) for (n, d) terms, by products of the ratios of successive convergents."""
    tiny = 1e-300
    value, up, down = tiny, tiny, 0.0
    for n, d in itertools.islice(terms, MOST_TERMS):
        down = 1.0 / ((d + n * down) or tiny)
        up = (d + n / up) or tiny
        value *= up * down
        if abs(up * down - 1.0) < EPS:
            return value
    raise ArithmeticError("a continued fraction did not converge")


def _stirling_rest(z: float) -> float:
    """log gamma(z) - ((z - 1/2) log z - z + log(2 pi) / 2)."""
    if z < 15.0:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
    q = 1.0 / (z * z)
    return (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / z


def _deviance(u: float) -> float:
    """u - log(1 + u), without cancellation near 0."""
    if abs(u) > 0.01:
        return u - math.log1p(u)
    return sum((-u) ** n / n for n in range(2, 12))


def _gamma_factor(a: float, x: float) -> float:
    """x^a e^-x / gamma(a)."""
    return math.sqrt(a / (2 * math.pi)) * math.exp(-a * _deviance((x - a) / a) - _stirling_rest(a))


def _beta_factor(a: float, b: float, x: float) -> float:
    """x^a (1 - x)^b / B(a, b)."""
    off = x * (a + b) - a
    log = -a * _deviance(off / a) - b * _deviance(-off / b)  # the linear parts cancel
    log += _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    return math.sqrt(a * b / (2 * math.pi * (a + b))) * math.exp(log)


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        term = total = 1.0 / a
        n = 0
        while term > total * EPS:
            n += 1
            term *= x / (a + n)
            total += term
        return 1.0 - _gamma_factor(a, x) * total
    later = ((-k * (k - a), x + 2 * k + 1 - a) for k in itertools.count(1))
    return _gamma_factor(a, x) * _fraction(itertools.chain([(1.0, x + 1 - a)], later))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x >= (a + 1.0) / (a + b + 2.0):  # the fraction converges fast on the other side
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    return _beta_tail(a, b, x)


def _beta_tail(a: float, b: float, x: float) -> float:
    def terms():
        yield 1.0, 1.0
        for m in itertools.count():
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            k = m + 1
            yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    return _beta_factor(a, b, x) / a * _fraction(terms())


def chi2_sf(x: float, dof: float) -> float:
    if x is None or math.isnan(x):
        return float("nan")
    return gammaincc(dof / 2.0, x / 2.0)


def t_sf_two_sided(t: float, df: float) -> float:
    if t is None or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


# -- DuckDB twins (power series; exact enough for the value ranges used) ----

def sql_chi2_sf(x: str, k: str, terms: int = 4000) -> str:
    """Q(k/2, x/2) = 1 - P(k/2, x/2) by the lower series; 0 beyond the series' reach."""
    a, h = f"(({k}) / 2.0)", f"(({x}) / 2.0)"
    series = (f"(SELECT sum(exp(-{h} + ({a} + _i) * ln({h}) - lgamma({a} + _i + 1))) "
              f"FROM range(0, {terms}) _series(_i))")
    return (f"(CASE WHEN ({x}) <= 0 THEN 1.0 WHEN {h} > {terms} / 2 THEN 0.0 "
            f"ELSE greatest(1.0 - {series}, 0.0) END)")


def sql_betainc(a: str, b: str, x: str, terms: int = 60000) -> str:
    """I_x(a, b) by the series in x (or 1 - I_{1-x}(b, a) when x is large)."""
    def series(aa: str, bb: str, xx: str) -> str:
        return (f"(exp(({aa}) * ln({xx}) + ({bb}) * ln(1.0 - ({xx})) + lgamma(({aa}) + ({bb})) - lgamma({aa}) "
                f"- lgamma({bb})) / ({aa}) * (1.0 + (SELECT sum(exp(lgamma(({aa}) + ({bb}) + _i + 1) "
                f"+ lgamma(({aa}) + 1) - lgamma(({aa}) + ({bb})) - lgamma(({aa}) + _i + 2) + (_i + 1) * ln({xx}))) "
                f"FROM range(0, {terms}) _series(_i))))")
    return (f"(CASE WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) >= 1 THEN 1.0 "
            f"WHEN ({x}) < (({a}) + 1.0) / (({a}) + ({b}) + 2.0) THEN {series(a, b, x)} "
            f"ELSE 1.0 - {series(b, a, f'(1.0 - ({x}))')} END)")


def sql_t_sf_two_sided(t: str, df: str) -> str:
    return sql_betainc(f"(({df}) / 2.0)", "0.5", f"(({df}) / (({df}) + ({t}) * ({t})))")


def sql_f_sf(f: str, d1: str, d2: str) -> str:
    return f"(CASE WHEN ({f}) <= 0 THEN 1.0 ELSE {sql_betainc(f'(({d2}) / 2.0)', f'(({d1}) / 2.0)', f'(({d2}) / (({d2}) + ({d1}) * ({f})))')} END)"
