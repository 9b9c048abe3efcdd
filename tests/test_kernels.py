"""Long windows in numpy against pandas, and the vector's plan: rows move by ticker only."""

import re

import numpy as np
import pandas as pd
import pytest
from tidemark.operators import kernels as K
from tidemark.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_frames_with_gaps_and_constants():
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=400)
    x[rng.random(400) < 0.2] = np.nan
    x[150:260] = 0.1
    s, y = pd.Series(x), pd.Series(rng.normal(size=400))
    z, rho = np.full(400, np.nan), np.full(400, np.nan)
    for i in range(400):
        at = np.arange(max(0, i - 49), i + 1)
        at = at[~np.isnan(x[at])]
        if len(at) >= 10 and len(set(x[at])) > 1:
            z[i] = (x[i] - x[at].mean()) / x[at].std(ddof=1)
            rho[i] = np.corrcoef(x[at], y[at])[0, 1]
    with np.errstate(all="ignore"):
        assert np.allclose(K.z(x, 50, 10), z, rtol=1e-6, equal_nan=True) and np.isnan(z[205:260]).all()
        assert np.allclose(K.corr(x, y.to_numpy(), 50, 10), rho, rtol=1e-6, equal_nan=True)
    assert np.allclose(K.shape(y.to_numpy(), 60, 20)[1], y.rolling(60, min_periods=20).kurt(), equal_nan=True)
    assert np.allclose(K.rank_pct(x), s.rank(pct=True), equal_nan=True) and np.allclose(K.ffill(x), s.ffill(), equal_nan=True)
    so_far = [np.nan if np.isnan(v) else s[: i + 1].rank(pct=True).iloc[-1] for i, v in enumerate(x[:60])]
    assert np.allclose(K.rank_pct_so_far(x[:60]), so_far, equal_nan=True)
    there = s.dropna().reset_index(drop=True)
    rho = there.corr(there.shift())
    assert K.persistence(x, False)[0] == pytest.approx(rho) and K.persistence(x, True)[-1] == pytest.approx(rho)


def test_groups_over_many_batches(spark):
    rows = spark.range(3000).selectExpr("id % 3 as k", "id as t", "cast(id as double) as x", "cast(id as double) as _y")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = K.by_group(rows, "k", "t", ["x", "_y"], ["n", "total"], lambda x, y: (np.arange(len(x)), np.cumsum(y))).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = got.sort_values(["k", "t"])
    assert list(got.columns) == ["k", "t", "x", "n", "total"] and (got.n == got.t // 3).all()
    assert (got.total == got.groupby("k").x.cumsum()).all()


def test_the_vector_moves_rows_by_ticker_only(spark):
    plan = QUERIES["state_vector"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"(ticker|date)#\d+", k) for k in keys)
    # What moves by day is the macro series, a row a day.
    assert sum(k.startswith("date") for k in keys) <= 9
