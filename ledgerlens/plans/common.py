"""Shared plumbing for the registered queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import Catalog


def finish(df: DataFrame, spec: dict[str, int | None]) -> DataFrame:
    """Select ``spec`` columns in order; doubles rounded to the given digits."""
    cols = []
    for name, digits in spec.items():
        c = F.col(name)
        cols.append(round_half(c, digits).alias(name) if digits is not None else c.alias(name))
    return df.select(*cols)


def round_half(c, digits: int):
    """Round at ``digits`` decimals by scaling first: round(x * 10^d) / 10^d.

    Both engines then round the same binary double the same way (half away
    from zero), whereas rounding the decimal representation directly differs
    between engines on exact halves.
    """
    scale = F.lit(float(f"1e{digits}"))
    return F.round(c * scale, 0) / scale


def sql_round(sql: str) -> str:
    """Rewrite every ``round(expr, d)`` in oracle SQL to ``round(expr * 1ed, 0) / 1ed``."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 5, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + 6:comma] if comma > 0 else sql[j + 6:k]
        digits = sql[comma + 1:k].strip() if comma > 0 else "0"
        inner = sql_round(inner)
        out.append(sql[i:j])
        out.append(f"(round(({inner}) * 1e{digits}, 0) / 1e{digits})" if digits != "0" else f"round({inner}, 0)")
        i = k + 1


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sf_dir)
