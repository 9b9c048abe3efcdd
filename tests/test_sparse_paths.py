"""Backtests from returns that aren't 0 and a calendar: the paths of the whole grid."""

import datetime as dt
import json

import numpy as np
import pytest
from tidemark.plans import backtest as B

DAYS = [dt.date(2024, 1, 20) + dt.timedelta(days=k) for k in range(30)]
COLUMNS = ("ret", "gross", "turnover", "invested")


@pytest.fixture(scope="module")
def prices(spark):
    """Closes with gaps, a missing close, a leg that never moves and one that has a single day."""
    rng = np.random.default_rng(3)
    rows = [(t, d, float(50 * np.exp(rng.normal(0, 0.05)))) for t in "ABCDE" for d in DAYS if rng.random() < 0.7]
    rows += [("FLAT", d, 10.0) for d in DAYS] + [("ONCE", DAYS[7], 3.0)]
    rows[3] = (*rows[3][:2], None)
    return spark.createDataFrame(rows, "ticker string, date date, close double").repartition(3).cache()


@pytest.fixture(scope="module")
def books(spark):
    rows = [(b, t, w) for b, legs in {"x": {"A": 0.4, "B": 0.3, "FLAT": 0.2, "GONE": 0.1}, "y": {"C": 0.5, "ONCE": 0.25, B.CASH: 0.25}, "z": {"FLAT": 1.0}, "none": {"GONE": 1.0}}.items() for t, w in legs.items()]
    return spark.createDataFrame(rows, "book string, ticker string, weight double")


@pytest.fixture
def small_batches(spark):
    """So that a day's rows, a book's legs and a decision's are cut by ends of batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 2)
    yield
    spark.conf.set(name, before)


def same(got, want):
    got, want = ({(r.book, r.date): [r[c] for c in COLUMNS] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(got) > 0
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_sparse_returns_are_those_of_the_grid(prices):
    grid = {(r.ticker, r.date): r.ret for r in B.leg_returns(prices).collect()}
    rows = B.sparse_returns(prices).collect()
    sparse = {(r.ticker, r.date): r.ret for r in rows}
    assert len(sparse) == len(rows) < len(grid) / 2 and {t for t, _ in sparse} == {t for t, _ in grid}
    assert all(sparse.get(k, 0.0) == v for k, v in grid.items()) and sparse.keys() <= grid.keys()


@pytest.mark.parametrize("frequency", ["none", "weekly", "daily"])
def test_static_paths(prices, books, small_batches, frequency):
    days = prices.select("date").distinct()
    got = B.static_paths(books, B.sparse_returns(prices), frequency, days=days)
    same(got, B.static_paths(books, B.leg_returns(prices), frequency))
    # A plain loop over the grid.
    grid = B.leg_returns(prices).toPandas().pivot(index="date", columns="ticker", values="ret")
    want = B.walk_static(list(grid.index), grid[["A", "B", "FLAT"]].to_numpy(), np.array([0.4, 0.3, 0.2]), np.full(3, 0.001), frequency)
    own = got.filter("book = 'x'").orderBy("date").toPandas()
    assert np.allclose(own[list(COLUMNS)], want[list(COLUMNS)], atol=1e-12)


def test_series_paths(spark, prices, small_batches):
    moves = [("p", DAYS[0] - dt.timedelta(days=2), {"A": 0.5, "B": 0.5}), ("p", DAYS[4], {"C": 1.0, "GONE": 0.5}), ("p", DAYS[9], None), ("p", DAYS[12], {}), ("p", DAYS[15], {"A": 0.1, "D": 0.2, "E": 0.7}), ("p", DAYS[-1] + dt.timedelta(days=1), {"A": 1.0}), ("q", DAYS[3], {"FLAT": 0.5, B.CASH: 0.5})]
    moves = spark.createDataFrame(moves, "book string, date date, weights map<string,double>")
    got = B.series_paths(moves, B.sparse_returns(prices), days=prices.select("date").distinct())
    same(got, B.series_paths(moves, B.leg_returns(prices)))
    path = {r.date: r for r in got.filter("book = 'p'").collect()}
    assert len(path) == len(DAYS) and path[DAYS[0]].turnover == pytest.approx(1.0) and path[DAYS[12]].invested == 0 and path[DAYS[15]].invested == pytest.approx(1.0) and path[DAYS[9]].turnover == 0


def test_a_row_a_record(spark):
    def record(k, **change):
        at = lambda h: f"2024-01-{k + 1:02d}T{h:02d}:00:00Z"
        return {"schema_version": "1.0", "decision_id": k, "information_cutoff": at(0), "decision_time": at(1), "execution_time": at(2), "action": "rebalance", "target_holdings": [{"ticker": t, "weight": 0.2} for t in "ABCDE"]} | change

    lists = {"good": [record(1), record(2)], "falls": [record(2), record(1)], "twice": [record(1), record(2, execution_time="2024-01-02T02:00:00Z")], "sum": [record(1), record(2, target_holdings=[])]}
    whole = B.decisions(spark.createDataFrame([(b, json.dumps(x)) for b, x in lists.items()], "book string, records string"))
    apart = B.decisions(spark.createDataFrame([(b, k, json.dumps(r)) for b, x in lists.items() for k, r in enumerate(x)], "book string, k int, records string"), record="k")
    for a, b in zip(whole, apart):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []


def test_metrics_walk_the_paths_once(prices, books):
    paths = B.static_paths(books, B.sparse_returns(prices), days=prices.select("date").distinct())
    metrics = B.performance(paths)
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    ret = {r.book: [] for r in metrics.collect()}
    for r in paths.collect():
        ret[r.book].append(r.ret)
    assert all(r.var_95 == pytest.approx(abs(np.percentile(ret[r.book], 5))) for r in metrics.collect())
