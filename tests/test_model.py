import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from tidemark.operators.rolling import Series
from tidemark.plans import model, vector


def test_pca_ignores_the_holdout(spark):
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2020-01-01", periods=200).date
    names = [f"x{i}" for i in range(6)]
    base = rng.normal(size=(1600, 6)) @ rng.normal(size=(6, 6))
    rows = pd.DataFrame(base, columns=names)
    rows.insert(0, "ticker", np.repeat([f"t{k}" for k in range(8)], 200))
    rows.insert(1, "date", list(days) * 8)
    late = rows["date"] >= days[-1] - dt.timedelta(days=30)
    rows.loc[late, names] *= 100
    rows.loc[5, "x2"] = np.nan
    df = spark.createDataFrame(rows)
    fit = model.fit_pca(df, names, components=4)
    train = rows[~late].dropna()[names].to_numpy()
    assert fit["train_rows"] == len(train) and np.allclose(fit["mean"], train.mean(0)) and np.allclose(fit["std"], train.std(0))
    z = (train - train.mean(0)) / train.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs((vt[:4] @ np.array(fit["loadings"])).diagonal()), 1) and np.allclose(fit["explained_ratio"], (s**2 / (s**2).sum())[:4])
    out = model.transform_pca(df, fit).toPandas().sort_values(["ticker", "date"])
    full = np.nan_to_num((rows[names].to_numpy() - fit["mean"]) / fit["std"])
    assert np.allclose(out[[f"pc0{k}" for k in range(1, 5)]].to_numpy(), full @ np.array(fit["loadings"]))
    with pytest.raises(ValueError):
        model.fit_pca(df.limit(50), names)


def test_folds(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=500)]
    rows = spark.createDataFrame([(d,) for d in days + days[:7]] + [(None,)], "date date")
    folds = model.embargoed_folds(rows).orderBy("fold").collect()
    for k, f in enumerate(folds):
        end = 500 - 71 * k
        assert (f.fold, f.train_start, f.test_start, f.test_end) == (k, days[0], days[end - 71], days[end - 1]) and (f.test_start - f.train_before).days == 21
    assert len(folds) == 5
    assert [f.fold for f in model.embargoed_folds(rows.filter("date < '2020-04-01'")).orderBy("fold").collect()] == [0, 1]
    assert model.embargoed_folds(rows.filter("date < '2020-02-01'")).count() == 0 and model.embargoed_folds(rows.filter("false")).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(1.0, -0.5), (0.3, 0.2)], "a double, b double")
    got = model.dual_scores(df, {"features": ["a", "b"], "mean": [0.0, 0.0], "std": [1.0, 1.0], "weights": [0.8, 0.6]}).collect()
    assert [r.additive for r in got] == pytest.approx([0.5, 0.36]) and [r.route_energy for r in got] == pytest.approx([0.85440037, 0.26832816], abs=1e-6)


def test_ridge_and_selection(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=180).date
    n = 40
    x = rng.normal(size=(180, n, 3))
    drift = x @ np.array([0.02, -0.01, 0.0]) + rng.normal(0, 0.004, (180, n))
    spot = 100 * np.cumprod(1 + np.vstack([np.zeros((1, n)), drift[:-1]]), axis=0)
    rows = pd.DataFrame({"ticker": np.tile([f"t{k:02d}" for k in range(n)], 180), "date": np.repeat(days, n), "a": x[..., 0].ravel(), "b": x[..., 1].ravel(), "c": x[..., 2].ravel(), "spot": spot.ravel()})
    df = spark.createDataFrame(rows)
    fwd = model.forward_returns(df, 1)
    train = df.join(fwd, ["ticker", "date"]).filter("fwd is not null")
    fit = model.ridge_weights(train, ["a", "b", "c"])
    p = train.toPandas()
    z = ((p[["a", "b", "c"]] - p[["a", "b", "c"]].mean()) / p[["a", "b", "c"]].std()).to_numpy()
    w = np.linalg.solve(z.T @ z + 1e-3 * np.eye(3), z.T @ p["fwd"].to_numpy())
    assert fit["weights"] == pytest.approx(w / np.linalg.norm(w), abs=1e-9)
    out = model.select_formulation(df, df, ["a", "b", "c"], horizon=1, folds=2)
    assert out["additive"]["mean"] > 0.5 and out["additive"]["p"] < 1e-6 and out["selected"] in ("additive", "route_energy")


def test_forward_returns(spark):
    days = [dt.date(2024, 1, k) for k in range(1, 6)]
    df = spark.createDataFrame([("X", d, s) for d, s in zip(days, (100.0, 101.0, 103.0, 102.0, 105.0))], "ticker string, date date, spot double")
    got = [r.fwd for r in model.forward_returns(df, 1).orderBy("date").collect()]
    assert got[:4] == pytest.approx([0.01, 103 / 101 - 1, 102 / 103 - 1, 105 / 102 - 1]) and got[4] is None


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(5)
    n = 700
    p = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "x": rng.normal(size=n)})
    p.loc[rng.choice(n, 40, replace=False), "x"] = np.nan
    p.loc[300:320, "x"] = 1.0
    s = Series.of("ticker", "date")
    df = spark.createDataFrame(p).selectExpr("ticker", "date", "case when not isnan(x) then x end as x").withColumn("lag", s.lag("x"))
    got = df.select("date", s.z("x").alias("z"), s.kurt("x").alias("k"), s.skew("x").alias("s"), s.corr("x", "lag").alias("c"), s.rank_pct("x").alias("r"), s.mean("x", 20).alias("m"), s.rank_pct_so_far("x").alias("rp")).toPandas().sort_values("date").reset_index(drop=True)
    x = p["x"]
    roll = x.rolling(504, min_periods=120)
    want = {"z": (x - x.rolling(252, min_periods=60).mean()) / x.rolling(252, min_periods=60).std(), "k": roll.kurt(), "s": roll.skew(), "c": roll.corr(x.shift(1)), "r": x.rank(pct=True), "m": x.rolling(20).mean(), "rp": x.expanding().rank(pct=True)}
    for name, w in want.items():
        assert np.allclose(got[name].astype(float), w, atol=1e-9, equal_nan=True), name


def test_constant_frames_do_not_raise(spark):
    s = Series.of("ticker", "date")
    df = spark.range(200).selectExpr("'A' as ticker", "id as date", "1.0D as x").withColumn("lag", s.lag("x"))
    r = df.select(s.z("x").alias("z"), s.corr("x", "lag", 50, 10).alias("c"), s.kurt("x", 50, 10).alias("k")).distinct().collect()
    assert [tuple(x) for x in r] == [(None, None, None)]


def test_running_product_with_total_loss(spark):
    s = Series.of("k", "t")
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (1, 2, -3.0), (1, 3, -1.0), (1, 4, 0.1)], "k int, t int, r double")
    assert [r[0] for r in df.orderBy("t").select(s.running_product("r")).collect()] == pytest.approx([1.5, 1.5, -3.0, 0.0, 0.0])


def test_kalman_skips_nulls(spark):
    df = spark.createDataFrame([("A", k, v) for k, v in enumerate([None, 100.0, None, 110.0, 0.0, 121.0])], "ticker string, date int, x double")
    got = {r.date: r.i for r in vector.kalman(df, "x", "i").collect()}
    level, var, want = math.log(100), 1.0, {}
    for k, v in ((3, 110.0), (5, 121.0)):
        var += 1e-4
        want[k] = (math.log(v) - level) / math.sqrt(var + 1e-2)
        level += var / (var + 1e-2) * (math.log(v) - level)
        var *= 1 - var / (var + 1e-2)
    assert got[0] is None and got[1] is None and got[2] is None and got[4] is None
    assert got[3] == pytest.approx(want[3]) and got[5] == pytest.approx(want[5])
