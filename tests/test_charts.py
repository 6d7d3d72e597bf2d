import math

import numpy as np
import pytest

from ledgerlens.operators import charts as chx


@pytest.mark.parametrize("kind", ["normal", "skewed", "far", "two"])
def test_kernel_density_against_direct_sums(spark, kind):
    r = np.random.default_rng(6)
    v = {"normal": r.normal(100, 15, 900), "skewed": r.gamma(0.4, 1e5, 900), "far": np.append(r.normal(0, 1, 500), [1e6, -1e5]),
         "two": np.array([1.0, 3.0])}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
    got = sorted(map(tuple, chx.kde(df, "v", 40).collect()))
    bw = v.std(ddof=1) * len(v) ** -0.2
    grid = v.min() + np.arange(40) * (v.max() - v.min()) / 39
    want = np.exp(-0.5 * ((grid[:, None] - v[None]) / bw) ** 2).sum(axis=1) / (len(v) * math.sqrt(2 * math.pi) * bw)
    assert [g[0] for g in got] == list(range(40))
    assert [g[1] for g in got] == pytest.approx(grid.tolist())
    assert [g[2] for g in got] == pytest.approx(want.tolist(), rel=1e-10, abs=1e-14 / bw)


def test_kernel_density_without_spread(spark):
    assert chx.kde(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), "v").count() == 0
    assert chx.kde(spark.createDataFrame([], "v double"), "v").count() == 0
