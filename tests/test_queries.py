"""Registered queries against DuckDB on the smallest tables (the driver's
correctness gate runs the same comparison at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ledgerlens.sources.tables import TABLES

SMOKE = "/root/testdata/sf0.001"
FAST = ["set1_order_grain", "cus4_rfm", "cus5_clv", "cus6_health", "cus7_segments", "dsh7_clv_by_segment",
        "dsh1_kpi_row", "dsh10_promotion_effectiveness", "met4_cohort_value_retention", "mbk3_association_rules",
        "sta3_anova", "chn4_kaplan_meier", "cht1_clv_histogram", "cus2_volume_trend", "src1_parametrized_sql"]


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else
                          str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "Segment" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    s = entry.queries()[key](spark, SMOKE).toPandas()
    d = con.sql(entry.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert norm(s).equals(norm(d))
